"""Quality rules: learned decision lists as Spark conditional expressions. DataFrame operations only.

``measures`` counts what the rules look at, with built-in functions, in one pass and without a shuffle. ``learn`` grows
and prunes rules by sequential covering on labelled statistics: the measures' shares are cut at quantiles of
the good and of the bad rows, the labelled rows are counted in the cells of those cuts, and from the counts each rule
grows condition by condition (FOIL's gain), loses the last ones while that helps on the pruning part, and takes
what it covers out of the rest. A list is a Python value of thresholds, printable and storable; ``verdict`` turns it
into ``CASE WHEN`` branches in the learned order.

Nulls: a null or empty text has no words; all measures are 0 and the basic test fails. Null labels and doc_ids are not
learned from, of several labels of a doc_id the lowest counts. Without labelled rows the list is empty and keeps
everything. Rows are never joined to others, so repeated rows and columns of any name don't matter to ``measures``: it
returns doc_id and its own columns only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: The labelled rows that are learned from: at most so many, those of least hash.
MOST_LABELLED = 50_000
#: Shares that conditions test, from the measures.
SHARES = {
    "symbols_per_word": "n_symbols",
    "repeat_share": "n_repeat_words",
    "same_next_share": "n_same_next",
    "capital_share": "n_capital_words",
    "dup_lines_per_word": "n_dup_lines",
    "exclamations_per_word": "n_exclamations",
    "chars_per_word": "word_chars",
}
_QUANTILES = [0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98]
_SPACE = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


def _count(text: Column, chars: str) -> Column:
    """How often ASCII characters stand in a text."""
    total = F.lit(0)
    for c in chars:
        total = total + (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))))
    return total.cast("long")


def _windows(words: Column) -> Column:
    """64-bit hashes of a text's 5-word windows, by place."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n >= WINDOW, hashes)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_same_next, n_capital_words, n_exclamations."""
    t, ws = F.col("_t"), F.col("_w")
    spaced = F.col("_t")
    for c in _SPACE[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    blank = F.lit("".join(_SPACE))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, blank) != "")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    df = df.withColumn("_w", F.array_remove(F.split(spaced, " "), "")).withColumn("_l", lines)
    df = df.select(
        "doc_id", "_w",
        F.size(ws).cast("long").alias("n_words"),
        F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        _count(t, SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(ws, lambda w, i: (i > 0) & (w == F.get(ws, i - 1)))).cast("long").alias("n_same_next"),
        F.size(F.filter(ws, lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.char_length(w) > 1))).cast("long").alias("n_capital_words"),
        _count(t, "!").alias("n_exclamations"))
    df = df.withColumn("_h", _windows(ws))
    # most texts repeat no window; only the others' windows are sorted by (hash, place). Those with an equal neighbour are
    # repeated; sorted again by place, each covers as many words as lie before the next one, five at most
    df = df.withColumn("_p", F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    p = F.col("_p")
    at = lambda i: F.get(p, i)["h"]
    twice = F.filter(F.transform(p, lambda x, k: F.when((x["h"] == at(k - 1)) | (x["h"] == at(k + 1)), x["i"])), lambda i: i.isNotNull())
    df = df.withColumn("_d", F.sort_array(twice))
    d = F.col("_d")
    covered = F.aggregate(F.transform(d, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(d, k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "n_same_next", "n_capital_words", "n_exclamations")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def share(name: str) -> Column:
    """A share of SHARES; 0 without words."""
    return F.coalesce(F.try_divide(F.col(SHARES[name]).cast("double"), F.col("n_words")), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    share: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        return share(self.share) >= self.threshold if self.at_least else share(self.share) < self.threshold

    def __str__(self) -> str:
        return f"{self.share} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions; with the labelled counts it had on the pruning part."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def __str__(self) -> str:
        return f"reject if {' and '.join(map(str, self.conditions))}  ({self.bad} bad, {self.good} good)"


def verdict(rules: list[Rule]) -> Column:
    """True (kept) unless a rule rejects: one branch for each rule, in their order."""
    out = None
    for r in rules:
        test = None
        for c in r.conditions:
            test = c.column() if test is None else test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn(measured: DataFrame, labels: DataFrame, label: str = "quality", most_labelled: int = MOST_LABELLED, most_rules: int = 12, precision: float = 0.8) -> list[Rule]:
    """A decision list for ``label`` 0 from the measures of labelled rows."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("_label"))
    rows = measured.join(known, "doc_id").where(~base_failed())
    shares = rows.select("doc_id", "_label", *(share(s).alias(s) for s in SHARES))
    shares = shares.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    cuts: dict[str, list[float]] = {s: [] for s in SHARES}
    for r in shares.groupBy("_label").agg(*(F.percentile_approx(s, _QUANTILES, 1000).alias(s) for s in SHARES)).collect():
        for s in SHARES:
            cuts[s] += r[s] or []
    cuts = {s: sorted({x for x in v if x > 0}) for s, v in cuts.items()}
    cell = [sum(((F.col(s) >= c).cast("int") for c in cuts[s]), F.lit(0)).alias(s) for s in SHARES]
    counted = shares.select("_label", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0).alias("prune"), *cell)
    cells = counted.groupBy("prune", *SHARES).agg(F.count_if(F.col("_label") == 0).alias("bad"), F.count_if(F.col("_label") != 0).alias("good")).collect()
    return cover([tuple(r[s] for s in SHARES) for r in cells], [(r["bad"], r["good"]) for r in cells], [r["prune"] for r in cells], cuts, most_rules, precision)


def cover(cells: list[tuple], counts: list[tuple], prune: list[bool], cuts: dict[str, list[float]], most_rules: int, precision: float) -> list[Rule]:
    """Sequential covering of the bad rows in counted cells (for each share how many cuts lie at or below it)."""
    names = list(cuts)
    x, (bad, good) = np.array(cells, int).reshape(-1, len(names)), np.array(counts, float).reshape(-1, 2).T
    late, left, rules = np.array(prune, bool), np.ones(len(x), bool), []
    tests = [(s, up, k, (x[:, j] > k) == up) for j, s in enumerate(names) for k in range(len(cuts[s])) for up in (True, False)]
    while len(rules) < most_rules and bad[left & ~late].sum() > 0:
        inside, chosen = left & ~late, []
        while good[inside].sum() > 0 and len(chosen) < 4:
            p, n = bad[inside].sum(), good[inside].sum()
            best = (1e-9, None)
            for t in tests:
                now = inside & t[3]
                q, m = bad[now].sum(), good[now].sum()
                if q and (gain := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > best[0] + 1e-9:
                    best = (gain, t)
            if best[1] is None:
                break
            chosen.append(best[1])
            inside = inside & best[1][3]
        if not chosen:
            break

        def worth(k: int, chosen=chosen) -> tuple[float, float, float]:
            now = left & late
            for t in chosen[:k]:
                now = now & t[3]
            p, n = bad[now].sum(), good[now].sum()
            return ((p - n) / (p + n + 1), p, n)

        k = max(range(1, len(chosen) + 1), key=lambda k: (worth(k)[0], -k))
        _, p, n = worth(k)
        if p < precision * (p + n) or not p:
            break
        rules.append(Rule(tuple(Condition(s, up, float(cuts[s][c])) for s, up, c, _ in chosen[:k]), int(p), int(n)))
        gone = left.copy()
        for t in chosen[:k]:
            gone &= t[3]
        left &= ~gone
    return rules
