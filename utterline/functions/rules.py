"""Rule tables of the report: labels of codes, classes of themes, groups of next actions, names of extra items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cascade, fold

# Allowed codes, their labels, and rules in the order in which they are tried.
INTENTS = ["покупка", "уточнение", "запись", "гарантия"]
CATEGORIES = ["Шины", "Диски", "АКБ", "Масла/Жидкости", "Услуги", "Другое"]
AVAILABILITY = {"in_stock": "в наличии", "backorder": "под заказ", "unknown": "неизвестно", "n/a": "н/д"}
SEASONS = {"летняя": "летняя", "зимняя": "зимняя", "всесезонная": "всесезонная"}
OBJECTION_STATUS = {"ignored": "проигнорировано", "unresolved": "не решено", "partially_resolved": "частично решено", "resolved": "решено"}
OBJECTION_TYPE = {
    "price": "цена",
    "availability": "наличие",
    "time_sla": "сроки/запись",
    "trust": "доверие",
    "warranty_claim": "гарантия",
    "fitment": "подбор/совместимость",
    "location_logistics": "локация/логистика",
    "process": "процесс/оформление",
}
OWNERS = {"client": "клиент", "sales": "оператор"}
YES, NO = "да", "нет"
THEMES = [("возврат", "Возврат"), ("жалоб|претенз", "Жалоба"), ("вопрос", "Вопрос"), ("покупка|продаж|sale", "Покупка")]
OTHER_ACTION = "Прочее/Не указано"
ACTIONS = [
    (r"\bоформ(ить)?\s+претензи", "Оформить претензию"),
    (r"\bзапис(ать|ь)\s+на\s+шин|\bзапись\s+на\s+шин|\bзапис(ь|ать)\b", "Запись на шиномонтаж"),
    (r"\bпереоформ", "Переоформить заказ"),
    (r"\bоформ(ить)?\s+заявк|\bзаказа?ть\b|\bоформ(ить)?\s+заказ", "Оформить заказ"),
    (r"\bзарезерв|\bрезервирован|\bрезервироват|\bзаброниров|\bрезерв\b", "Забронировать"),
    (r"\bперезвон|\bс\s+вами\s+свяжутс", "Перезвонить"),
    (r"\bсамовывоз\b|\bзабрать\b", "Самовывоз"),
    (r"\bприехат\w*", "Приехать"),
    (r"\bдостав(ка|ить|им)\b", "Доставка"),
]
ITEMS = [
    (r"\bпакет(ы)?\s*(для)?\s*(шин|кол(е|ё)с)\b", "Пакеты для шин"),
    (r"\bсезонн\w*\s+хранен", "Сезонное хранение"),
    (r"\bхранен", "Сезонное хранение"),
    (r"\bшиномонта?ж\b", "Шиномонтаж"),
    (r"\bбесплатн\w*\s+(шиномонта?ж|переобув)", "Шиномонтаж (акция)"),
    (r"\bкупон\w*\s+на\s+бесплатн\w*\s+шиномонта?ж", "Шиномонтаж (акция)"),
    (r"\bшиномонта?ж\s+подар", "Шиномонтаж (акция)"),
    (r"\bакци(я|и)\b", "Акции/купоны"),
    (r"\bтехн(ологическ\w*\s+)?мойк\w*\s*(кол(е|ё)с)?", "Мойка колёс"),
    (r"\bмойк\w*\s*(кол(е|ё)с)?", "Мойка колёс"),
    (r"\bдемонтаж[-\s]*монтаж[-\s]*балансиров", "Комплекс ДМБ"),
    (r"\bсняти?е?\s*(и|/)?\s*установ", "Снятие/установка"),
    (r"\bмонтаж(?!.*балансиров)", "Монтаж"),
    (r"\bдемонтаж\b", "Демонтаж"),
    (r"\bбалансиров", "Балансировка"),
    (r"\bгруз(ы|иков)?\b", "Балансировочные грузики"),
    (r"\bустановк\w*\s+грузик", "Балансировочные грузики"),
    (r"\bвентил(ь|я|и)\b", "Вентили"),
    (r"\bдатчик(ов)?\b", "Датчики давления (TPMS)"),
    (r"\bустановк\w*\s+датчик", "Датчики давления (TPMS)"),
    (r"\b(доп(\.|олнительн\w*)?\s+)?расширенн\w*\s+гарант", "Доп. гарантия (расширенная)"),
    (r"\bдоп(\.|олнительн\w*)?\s+гарант", "Доп. гарантия (расширенная)"),
    (r"\bрезервирован|резервировани|резерв\b", "Резервирование"),
    (r"\bутилиз(аци|ация)\s+шин", "Утилизация шин"),
    (r"\bонлайн\s+оплат", "Онлайн оплата"),
    (r"\bподарочн\w*\s+литр\w*\s+бензин", "Подарочные литры бензина"),
    (r"\bтрейд[-\s]*ин\b", "Трейд-ин"),
    (r"\bкреп(е|ё)ж\b", "Крепёж"),
    (r"\bпроставк\w+", "Проставки"),
    (r"\bколпак\w+", "Колпаки"),
    (r"\bкомпрессор\b", "Компрессор"),
    (r"\bкол(е|ё)са\b", "Колёса/комплекты"),
    (r"\bшины\b", "Шины"),
    (r"\bошиповк", "Ошиповка"),
    (r"\bпакет", "Пакеты для шин"),
]


def theme_class(c: Column) -> Column:
    """The class of a theme's text; empty if no rule fits."""
    return F.coalesce(cascade(fold(c), THEMES), F.lit(""))


def action_group(c: Column) -> Column:
    """The group of a next action."""
    return F.coalesce(cascade(F.lower(F.trim(c)), [(f"(?U){p}", label) for p, label in ACTIONS]), F.lit(OTHER_ACTION))


def item_name(c: Column) -> Column:
    """The common name of an extra item; without a rule the text itself, capitalised; empty for a blank one."""
    raw = F.trim(c)
    return F.when(F.coalesce(raw, F.lit("")) == "", "").otherwise(F.coalesce(cascade(fold(c), [(f"(?iU){p}", label) for p, label in ITEMS]), F.concat(F.upper(F.substring(raw, 1, 1)), F.lower(F.substring(raw, 2, 1 << 30)))))


def item_names(items: Column) -> Column:
    """Common names of an array's items, each once, in order."""
    return F.array_distinct(F.filter(F.transform(items, item_name), lambda x: x != ""))


def label(c: Column, labels: dict[str, str]) -> Column:
    """The label of a code; empty for any other value."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), c), F.lit(""))

