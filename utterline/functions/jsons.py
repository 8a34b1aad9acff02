"""Tolerant JSON: repair of model output, flattening, shallow merge."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship


def first_blob(text: str) -> str | None:
    """The first balanced object or array: only brackets of its own kind count, and none within double quotes."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    opener, closer = text[start], "}" if text[start] == "{" else "]"
    for quoted in (True, False):  # quotes that don't pair up are ignored
        depth, inside, i = 0, False, start
        while i < len(text):
            c = text[i]
            if inside:
                i += c == "\\"
                inside = c != '"'
            elif c == '"' and quoted:
                inside = True
            elif c == opener:
                depth += 1
            elif c == closer:
                depth -= 1
                if not depth:
                    return text[start : i + 1]
            i += 1
    return None


def _tokens(text: str) -> Iterator[str]:
    """Strings in either quotes, words, and single signs. A quote within words is a letter; one ends a string only before a sign or the end."""
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c in "\"'":
            end = i + 1
            while end < n and not (text[end] == c and re.match(r"\s*([,:}\]]|$)", text[end + 1 :])):
                end += 2 if text[end] == "\\" else 1
            yield text[i : end + 1]
            i = end + 1
        elif m := re.compile(r"\w+").match(text, i):
            yield m[0]
            i = m.end()
        else:
            yield c
            i += 1


def mended(text: str) -> str:
    """Python's words as JSON's, single quotes as double ones, and no comma before a closing bracket."""
    words = {"None": "null", "True": "true", "False": "false"}
    out: list[str] = []
    for t in _tokens(text):
        if len(t) > 1 and t[0] == "'" == t[-1]:
            t = json.dumps(t[1:-1].replace("\\'", "'"), ensure_ascii=False)
        elif t in "}]":
            while out and (not out[-1].strip() or out[-1] == ","):
                out.pop()
        out.append(words.get(t, t))
    return "".join(out)


def repair_text(text: str | None) -> str:
    """A JSON object for any text: as it is, without fences, its first blob, with Python's words, quotes and commas mended; an array goes under "data"; else {}."""
    if not text:
        return "{}"
    bare = re.sub(r"(?im)^\s*```(?:json)?\s*|\s*```\s*$", "", text).strip()
    blob = first_blob(bare)
    for candidate in (text, bare, blob, mended(blob) if blob else None):
        try:
            value = json.loads(candidate) if candidate else None
        except ValueError:
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False)
        if isinstance(value, list):
            return json.dumps({"data": value}, ensure_ascii=False)
    return "{}"


def fixed_text(text: str | None) -> str:
    """JSON as it is; else without fences and commas before a bracket and with bare keys quoted; else the text as ``content``."""
    text = text or ""
    fixed = re.sub(r"(\w+):", r'"\1":', text.replace(",}", "}").replace(",]", "]").replace("```json", "").replace("```", "").strip())
    for candidate in (text, fixed):
        try:
            return json.dumps(json.loads(candidate), ensure_ascii=False)
        except ValueError:
            continue
    return json.dumps({"content": text.strip()}, ensure_ascii=False)


def fixed(c: Column) -> Column:
    ship()
    return F.pandas_udf(lambda texts: texts.map(fixed_text), "string")(c)


def repair(c: Column | str) -> Column:
    ship()
    return _repair(c)


@F.pandas_udf(T.StringType())
def _repair(texts: pd.Series) -> pd.Series:
    return texts.map(repair_text)


def shallow_merge(old: Column, new: Column) -> Column:
    """Top-level keys of ``new`` win; values are kept as JSON text. Needs spark.sql.mapKeyDedupPolicy=LAST_WIN only for repeated keys within one document."""
    a, b = (F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")) for c in (old, new))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)
