import random
import re

import pandas as pd
from pyspark.sql import functions as F

from utterline.functions import fuzzy, jsons, rules, text
from utterline.operators import sequence


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_partial_ratio_equals_every_window():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        s, t = (a, b) if len(a) <= len(b) else (b, a)
        parts = [t[max(0, i) : i + len(s)] for i in range(1 - len(s), len(t))]
        want = max(200 * _lcs(s, p) / (len(s) + len(p)) for p in parts)
        assert abs(fuzzy.partial_ratio(a, b) - (100 if s in t else want)) < 1e-9


def test_json_repair():
    cases = {None: "{}", "": "{}", "x {'a': None,} y": '{"a": null}', "```json\n{\"a\": 1}\n```": '{"a": 1}', "[1, 2]": '{"data": [1, 2]}', "nothing": "{}"}
    for given, want in cases.items():
        assert jsons.repair_text(given) == want


def test_batched_scores_equal_single_ones():
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    for at_least in (0, 60, 80, 95):
        texts = [word(rng.randrange(0, 40)) for _ in range(60)]
        for p in [word(rng.randrange(1, 20)) for _ in range(10)] + ["a" * 70, texts[5][:9] or "x"]:
            got = fuzzy.scores(p, texts, at_least)
            for t, g in zip(texts, got, strict=True):
                want = fuzzy.partial_ratio(p, t)
                assert abs(g - want) < 1e-9 or (want < at_least and g < at_least), (p, t, g, want)


def test_phrases_of_lists(spark):
    df = spark.createDataFrame([("good mornin to you",), ("good bye now",), ("",), (None,)], "t string")
    best, first = (f(F.col("t"), ["good evening", "good morning", "good bye"], 60) for f in (fuzzy.best_phrase, fuzzy.first_phrase))
    assert [tuple(r) for r in df.select(best, first).collect()] == [("good morning", "good evening"), ("good bye", "good evening"), (None, None), (None, None)]
    sells = fuzzy.any_block_phrase(F.col("t"), ["good bye", "x" * 40])
    assert [r[0] for r in df.select(sells).collect()] == [False, True, False, False]
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    pairs = [(word(12), word(30)) for _ in range(80)]
    pairs += [(a, b[:5] + a[:6] + a[7:] + b[5:]) for a, b in pairs]
    for a, b in pairs:
        got = spark.createDataFrame([(b,)], "t string").select(fuzzy.any_block_phrase(F.col("t"), [a])).first()[0] if fuzzy.block_ratio(a, b) >= 95 else None
        assert got is None or got == (fuzzy.block_ratio(a, b) >= 97)


def test_token_sets(spark):
    assert fuzzy.token_set_ratio("fuzzy was a bear", "a bear was fuzzy fuzzy") == 100.0
    assert fuzzy.token_set_ratio("a b", "c d") < 70 and fuzzy.token_set_ratio("", "x") == 0
    df = spark.createDataFrame([("we place the order now",), ("nothing",)], "t string")
    assert [r[0] for r in df.select(fuzzy.best_token_set(F.col("t"), ["order the place", "pay"])).collect()] == ["order the place", None]


def test_first_blob_and_quotes():
    assert jsons.first_blob('note {"a": "x]"} end') == '{"a": "x]"}' and jsons.first_blob("x [1, {2] y") == "[1, {2]" and jsons.first_blob("none") is None
    assert jsons.repair_text('note {"a": "x]"} end') == '{"a": "x]"}'
    assert jsons.repair_text("{'said': 'it's fine', 'ok': True, 'n': None,}") == '{"said": "it\'s fine", "ok": true, "n": null}'
    assert jsons.repair_text('Here: ```json\n[{"a": 1,}]\n```') == '{"data": [{"a": 1}]}'
    assert jsons.fixed_text("```json\n{a: 1, b: [2,],}\n```") == '{"a": 1, "b": [2]}' and jsons.fixed_text(" plain ") == '{"content": "plain"}'


def _plain_clean(t):
    """The transcript's clean-up with Python's patterns."""
    t = re.sub(r"\s+\n", "\n", t).strip()
    was = None
    while was != t:
        was, t = t, re.sub(r"(?iu)\b(\w+)(?:[\s,\-–—.?!…]+\1\b){2,}", lambda m: f"{m[1]} {m[1]}", t)
    t = re.sub(r"(?iu)(\w)\1{5,}", lambda m: m[1] * 3, t)
    t = re.sub(r"(?iu)\b([a-zа-яё0-9]{2,10})\1{3,}\b", lambda m: m[1] * 2, t)
    return re.sub(r"(?iu)\b\w{41,}\b", lambda m: "" if len(m[0]) >= 80 else m[0][:40] + "…", t)


def test_cleaning_equals_plain_patterns(spark):
    rng = random.Random(6)
    parts = ["да", "Да", "нет", ", ", " ", "... ", "!", "ааааааа", "хаха", "абабабабаб", "long" * 11, "x1" * 45, "\n", "— ", "ok"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(text.clean_line(F.col("t"))).collect()]
    for t, g in zip(texts, got, strict=True):
        assert g.strip() == _plain_clean(t).strip(), t


def test_normalisation(spark):
    df = spark.createDataFrame([("Здрасьте, ДОБРОГО ДНЯ т.е. Ёж", "ﬁne–Ёлка, CAP x")], "a string, b string")
    assert tuple(df.select(text.normalize(F.col("a")), text.norm_ru(F.col("b")), text.clock(F.lit(-3)), text.clock(F.lit(125.9)), text.row_line(F.lit(1.0), F.lit(2.345), F.lit("A"), F.lit("hi"))).first()) == (
        "здравствуйте, добрый день то есть ёж", "finе елка сар х", "00:00", "02:05", "1.00:2.35: [A] hi")
    assert df.select(text.fold(F.col("a"))).first()[0].endswith("еж")
    assert df.select(text.without(F.lit("a Продолжение следует..."), text.BOILERPLATE), text.theme_saved(F.lit("[Тема диалога: Во-прос]")), text.preview(F.lit("abcdef"), 3)).first()[0:] == ("a ", "вопрос", "abc…")


def test_lexicons(spark):
    df = spark.createDataFrame([("Anna met BOB, bob and x-ray",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.first_hit(F.col("t"), ["bob", "Carl"])).collect()] == ["BOB", None, None]
    low = F.lower("t")
    assert [r[0] for r in df.select(text.matched(low, ["bob", "x-ray", "ann"], ["and"])).collect()] == [["bob", "x-ray"], None, None]
    assert [r[0] for r in df.select(text.matched(low, ["x-ray", "and", "met", "bob"], ["and"], as_listed=True)).collect()] == [["x-ray", "met", "bob"], None, None]
    assert [r[0] for r in df.select(text.matched(low, [], as_listed=True)).collect()] == [None, None, None]
    assert text.variants({"a": ["X", "y"], "b": ["z"]}) == ["x", "y", "z"]
    kinds = {"pick": ["met bob", "x ray"], "other": ["nobody"]}
    assert [r[0] for r in df.select(text.labels_of(F.col("t"), kinds)).collect()] == ["pick", None, None] and df.select(text.labels_of(F.col("t"), kinds, F.lit(" "))).first()[0] is None
    rus = spark.createDataFrame([("домик и стульчик, Мячик",), ("кот",)], "t string")
    assert [r[0] for r in rus.select(text.diminutives(F.col("t"), lambda w: ({"домик": "домик"}.get(w, "x"), w == "мячик"))).collect()] == ["стульчик", None]
    assert [r[0] for r in df.select(text.names_by(F.col("t"), lambda t: [w for w in t.replace(",", "").split() if w.istitle()])).collect()] == ["Anna", None, None]


def test_rule_tables(spark):
    themes = ["Оформление возврата", "Жалоба на товар", "вопрос о продаже", "Покупка шин", "иное", None]
    actions = ["Оформить претензию", "запись на шиномонтаж", "Перезвонить завтра", "", None, "самовывоз"]
    items = ["пакеты для шин", "Сезонное хранение", "бесплатный шиномонтаж", "монтаж колес", "демонтаж-монтаж-балансировка", "чехол Люкс", " ", None]
    one = lambda xs, f: [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]
    assert one(themes, rules.theme_class) == ["Возврат", "Жалоба", "Вопрос", "Покупка", "", ""]
    assert one(actions, rules.action_group) == ["Оформить претензию", "Запись на шиномонтаж", "Перезвонить", rules.OTHER_ACTION, rules.OTHER_ACTION, "Самовывоз"]
    plain = lambda x: next((n for p, n in rules.ITEMS if re.search(f"(?i){p}", x.lower().replace("ё", "е"))), x.strip().capitalize()) if x and x.strip() else ""
    assert one(items, rules.item_name) == [plain(x) for x in items] and one(["price", "x", None], lambda c: rules.label(c, rules.OBJECTION_TYPE)) == ["цена", "", ""]
    assert spark.range(1).select(rules.item_names(F.array(F.lit("Хранение"), F.lit("сезонное хранение"), F.lit("")))).first()[0] == ["Сезонное хранение"]


def test_viterbi_equals_all_paths(spark):
    from itertools import product

    rng = random.Random(5)
    rows = [(g, i, rng.random(), rng.random()) for g in range(4) for i in range(7)]
    got = sequence.viterbi(spark.createDataFrame(rows, "g int, i int, a double, b double"), "g", "i", ["a", "b"], 0.3).toPandas()
    for g in range(4):
        x = [r[2:] for r in rows if r[0] == g]
        score = lambda p, x=x: sum(x[k][s] for k, s in enumerate(p)) - 0.3 * sum(p[k] != p[k - 1] for k in range(1, len(p)))
        own = got[got.g == g].sort_values("i").label.tolist()
        assert abs(score(own) - max(score(p) for p in product((0, 1), repeat=7))) < 1e-9
    assert isinstance(got, pd.DataFrame)
