"""A model's JSON answer about a dialog as flat columns, read through VARIANT, so one odd field can't spoil the rest."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .jsons import repair
from .text import present

#: Flags that hold only for a JSON true; the others hold for anything that isn't empty, zero or false. Field names of the answer are fixed values.
STRICT = {"obj_detected": "$.objection.detected", "wrap_up": "$.wrap_up"}
LOOSE = {"obj_ack": "$.objection.handling.acknowledge", "obj_sol": "$.objection.handling.solution", "obj_check": "$.objection.handling.check_close",
         "next_set": "$.next_set.set", "addon_offered": "$.add_on_sale.offered", "addon_accepted": "$.add_on_sale.accepted"}
TEXTS = {"category_detail": "$.category_detail", "next_action": "$.next_set.action", "next_datetime": "$.next_set.datetime", "next_place": "$.next_set.place"}
ENUMS = {"intent": "$.intent", "category": "$.category", "availability": "$.availability", "season": "$.season", "obj_type": "$.objection.type", "obj_status": "$.objection.status", "next_owner": "$.next_set.owner"}


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))


def truthy(v: Column, path: str) -> Column:
    return ~F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")).isin("", "0", "0.0", "false", "[]", "{}")


def is_true(v: Column, path: str) -> Column:
    at = F.try_variant_get(v, path, "variant")
    return F.coalesce((F.schema_of_variant(at) == "BOOLEAN") & F.try_variant_get(v, path, "boolean"), F.lit(False))


def flatten(answer: Column, allowed: Mapping[str, Collection[str]], names: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, Column]:
    """Columns of an answer (JSON text) for ``withColumns``.

    ``allowed`` gives the values of each enumeration; any other becomes empty. ``names`` gives, for some of them, the labels of
    their values, as a column ``<field>_label``. Without an objection its type and status are empty. Text that isn't JSON, or no
    object, has empty fields and flags of 0.
    """
    v = F.try_parse_json(answer)
    flags = {n: is_true(v, p) for n, p in STRICT.items()} | {n: truthy(v, p) for n, p in LOOSE.items()}
    out = {n: _text(v, p) for n, p in TEXTS.items()} | {"tire_rim": F.try_variant_get(v, "$.tire_rim", "double")}
    for n, p in ENUMS.items():
        x = _text(v, p)
        known = x.isin(*allowed[n]) if n in allowed else F.lit(True)
        out[n] = F.when(known & (flags["obj_detected"] if n in ("obj_type", "obj_status") else F.lit(True)), x).otherwise("")
        if names and n in names:
            labels = F.create_map(*(F.lit(s) for pair in names[n].items() for s in pair))
            out[f"{n}_label"] = F.coalesce(F.try_element_at(labels, out[n]), F.lit(""))
    items = F.try_variant_get(v, "$.add_on_sale.items", "array<string>")
    one = _text(v, "$.add_on_sale.items")
    out["addon_items"] = F.filter(F.coalesce(items, F.when(one != "", F.array(one)), F.array().cast("array<string>")), lambda i: F.trim(F.coalesce(i, F.lit(""))) != "")
    return out | {n: c.cast("int") for n, c in flags.items()}


def yes_no(flag: Column, yes: str = R.YES, no: str = R.NO) -> Column:
    return F.when(flag > 0, yes).otherwise(no)


def report_columns(answer: Column) -> dict[str, Column]:
    """An answer's 32 report columns, and its items as an array: codes outside their lists are empty, labels and yes or no beside codes and flags."""
    allowed = {"intent": R.INTENTS, "category": R.CATEGORIES, "availability": list(R.AVAILABILITY), "season": list(R.SEASONS), "obj_type": list(R.OBJECTION_TYPE), "obj_status": list(R.OBJECTION_STATUS), "next_owner": list(R.OWNERS)}
    flat = flatten(repair(answer), allowed)
    out = {f"llm_{n}": c for n, c in flat.items() if n != "addon_items"}
    for n, labels in (("availability", R.AVAILABILITY), ("season", R.SEASONS), ("obj_type", R.OBJECTION_TYPE), ("obj_status", R.OBJECTION_STATUS), ("next_owner", R.OWNERS)):
        out[f"llm_{n}_ru"] = R.label(flat[n], labels)
    for n in ("obj_detected", "obj_ack", "obj_sol", "obj_check", "addon_offered", "addon_accepted"):
        out[f"llm_{n}_text"] = F.when(present(answer), yes_no(flat[n]))
    return out | {"llm_addon_items_json": F.to_json(flat["addon_items"]), "llm_addon_items": flat["addon_items"]}
