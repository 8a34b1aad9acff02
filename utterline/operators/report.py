"""Aggregates and report blocks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import phrases, present


def mode_nonempty(c: Column, allowed: list[str] | None = None) -> Column:
    """The most frequent value that isn't empty, the least of equals."""
    ok = ~F.lower(F.coalesce(F.trim(c), F.lit(""))).isin("", "nan", "none", "null")
    return F.mode(F.when(ok & c.isin(allowed) if allowed else ok, c), True)


def any_flag(c: Column) -> Column:
    return F.coalesce(F.max(c.try_cast("double")) > 0, F.lit(False)).cast("int")


def ordered_distinct(c: Column, order: Column, separator: str = ", ") -> Column:
    """Distinct values in order of first appearance, joined."""
    rows = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(order.alias("o"), c.alias("v")))))
    return F.array_join(F.array_distinct(F.transform(rows, lambda r: r["v"])), separator)


def transcript(line: Column, order: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("v")))), lambda r: r["v"]), "\n")


def shares(df: DataFrame, value: Column, keep_empty: str | None = None) -> DataFrame:
    """value, n, share of all rows; empties are named ``keep_empty`` or dropped (but stay in the denominator)."""
    v = F.nullif(F.trim(value.cast("string")), F.lit(""))
    total = df.agg(F.count("*").alias("total"))
    counts = df.groupBy((F.coalesce(v, F.lit(keep_empty)) if keep_empty else v).alias("value")).agg(F.count("*").alias("n")).where(F.col("value").isNotNull())
    return counts.join(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def funnel(df: DataFrame, item: str, offered: Column, accepted: Column, dialog: str, least: int = 2) -> DataFrame:
    """item, total, offered, accepted, share of all dialogs, conversion."""
    dialogs = df.agg(F.countDistinct(dialog).alias("dialogs"))
    per = df.groupBy(dialog, item).agg(F.max(offered.cast("int")).alias("o"), F.max(accepted.cast("int")).alias("a"))
    out = per.groupBy(item).agg(F.count("*").alias("total"), F.sum("o").alias("offered"), F.sum("a").alias("accepted")).where(F.col("total") >= least)
    return out.join(F.broadcast(dialogs)).select(item, "total", "offered", "accepted", F.round(F.col("total") / F.col("dialogs"), 6).alias("share"), F.round(F.coalesce(F.try_divide("accepted", "offered"), F.lit(0.0)), 6).alias("conversion"))


def correlations(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """metric_a, metric_b, r of all pairs, in one pass; null where a metric is constant."""
    m = df.select(*(c.cast("double").alias(n) for n, c in metrics.items()))
    pairs = list(combinations(metrics, 2))
    r = lambda a, b: F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
    one = m.agg(F.array(*(F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.round(r(a, b), 3).alias("r")) for a, b in pairs)).alias("x"))
    return one.select(F.inline("x"))


def most_correlated(pairs: DataFrame, most: int = 8) -> DataFrame:
    """The pairs of ``correlations`` with the greatest r, whatever its sign, with a line of text; pairs without r are left out."""
    sign = F.when(F.col("r") > 0, "↑").otherwise("↓")
    line = F.concat(sign, F.format_string(" r=%+.2f  →  ", "r"), "metric_a", F.lit(" ↔ "), "metric_b")
    return pairs.where("r IS NOT NULL").orderBy(F.abs("r").desc(), "metric_a", "metric_b").limit(most).withColumn("line", line)


def with_dummies(metrics: dict[str, Column], values: dict[str, tuple[Column, list[str]]]) -> dict[str, Column]:
    """Metrics and, for each named column, one metric for each of its values."""
    return metrics | {f"{n}_{v}": F.coalesce(c == v, F.lit(False)).cast("int") for n, (c, vs) in values.items() for v in vs}


def totals(df: DataFrame, dialog: str, seconds: str) -> DataFrame:
    """dialogs, rows, hours; what isn't a number counts as 0 seconds."""
    return df.agg(F.countDistinct(dialog).alias("dialogs"), F.count("*").alias("rows"), (F.coalesce(F.sum(F.coalesce(F.col(seconds).try_cast("double"), F.lit(0.0))), F.lit(0.0)) / 3600).alias("hours"))


def rates(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """n and the mean of each metric, where null and what isn't a number is 0."""
    return df.agg(F.count("*").alias("n"), *(F.coalesce(F.round(F.avg(F.coalesce(c.try_cast("double"), F.lit(0.0))), 6), F.lit(0.0)).alias(n) for n, c in metrics.items()))


def grouped_rates(df: DataFrame, group: str, means: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """n, means and sums by a group, null a group of its own."""
    zero = lambda c, t: F.coalesce(c.cast(t), F.lit(0).cast(t))
    return df.groupBy(group).agg(F.count("*").alias("n"), *(F.round(F.avg(zero(c, "double")), 6).alias(n) for n, c in means.items()), *(F.sum(zero(c, "long")).alias(n) for n, c in sums.items()))


def coverage(df: DataFrame, present_: dict[str, Column], flags: dict[str, Column] | None = None) -> DataFrame:
    """criterion, n, share of all rows: how many rows have a value that isn't blank, or a flag over 0. One pass."""
    hits = {n: ~F.lower(F.coalesce(F.trim(c.cast("string")), F.lit(""))).isin("", "nan") for n, c in present_.items()}
    hits |= {n: F.coalesce(c.try_cast("double") > 0, F.lit(False)) for n, c in (flags or {}).items()}
    one = df.agg(F.count("*").alias("total"), F.array(*(F.struct(F.lit(n).alias("criterion"), F.count_if(h).alias("n")) for n, h in hits.items())).alias("x"))
    return one.select("total", F.inline("x")).select("criterion", "n", F.round(F.coalesce(F.try_divide("n", "total"), F.lit(0.0)), 6).alias("share"))


def top_phrases(df: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """phrase, n: the most frequent phrases of some columns, each split as ``phrases`` splits; the least of equals first."""
    parts = F.flatten(F.array(*(phrases(F.col(c)) for c in columns)))
    return df.select(F.explode(parts).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(most)


def speaker_totals(df: DataFrame, group: str, speaker: str, default: str = "Speaker 1") -> DataFrame:
    """group, speaker, n, seconds spoken: no row counts less than 0; no speaker is ``default``."""
    length = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    who = F.when(present(F.col(speaker)), F.col(speaker)).otherwise(default)
    return df.groupBy(group, who.alias(speaker)).agg(F.count("*").alias("n"), F.round(F.sum(length), 3).alias("seconds"))


def usage(df: DataFrame, user: str, at: str) -> DataFrame:
    """user, usage_count, last_used, the most frequent first."""
    return df.groupBy(user).agg(F.count("*").alias("usage_count"), F.max(at).alias("last_used")).orderBy(F.desc("usage_count"), user)


def stage_counts(df: DataFrame, done: Column) -> DataFrame:
    """total, processed, pending and coverage in per cents, of rows that are or aren't ``done``."""
    n = F.count_if(done)
    return df.agg(F.count("*").alias("total"), n.alias("processed"), (F.count("*") - n).alias("pending"), F.round(F.coalesce(F.try_divide(100 * n, F.count("*")), F.lit(0.0)), 4).alias("coverage"))


def level_stats(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Count, mean, greatest, least, deviation, range and percentiles of a value by group."""
    q = F.percentile(value, F.array(F.lit(0.95), F.lit(0.75), F.lit(0.25)))
    return df.groupBy(group).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("most"), F.min(value).alias("least"), F.round(F.stddev_pop(value), 6).alias("deviation"), F.round(F.max(value) - F.min(value), 6).alias("range"),
                                 F.round(F.get(q, 0), 6).alias("p95"), F.round(F.get(q, 1), 6).alias("p75"), F.round(F.get(q, 2), 6).alias("p25"))


def exact_quantiles(df: DataFrame, value: str, shares: list[float], accuracy: int = 2000) -> list[float | None]:
    """Exact quantiles, linear between neighbours; null for no values.

    An approximate quantile brackets each place, rows under the bracket are counted, and only those inside it (four in ``accuracy`` of all)
    are ordered, so no task holds all values.
    """
    v = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    n = v.count()
    if not n:
        return [None] * len(shares)
    slack = 2 / accuracy
    ends = [max(0.0, p - slack) for p in shares] + [min(1.0, p + slack) for p in shares]
    found = v.agg(F.percentile_approx("v", F.array(*map(F.lit, ends)), accuracy).alias("q")).first()["q"]
    brackets = list(zip(found[: len(shares)], found[len(shares) :], strict=True))
    below = v.agg(*(F.count_if(F.col("v") < lo).alias(f"b{i}") for i, (lo, _) in enumerate(brackets))).first()
    out: list[float | None] = []
    for i, (p, (lo, hi)) in enumerate(zip(shares, brackets, strict=True)):
        place = p * (n - 1)
        first, last = int(place), min(int(place) + 1, n - 1)
        counts = v.where((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy("v").agg(F.count("*").alias("k"))
        upto = counts.withColumn("upto", F.sum("k").over(W.orderBy("v")) + below[f"b{i}"])
        at = upto.agg(F.min(F.when(F.col("upto") > first, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > last, F.col("v"))).alias("b")).first()
        out.append(at["a"] if at["a"] == at["b"] or at["b"] is None else at["a"] + (at["b"] - at["a"]) * (place - first))
    return out


def classification(df: DataFrame, truth: Column, found: Column, labels: list[str]) -> DataFrame:
    """label, precision, recall, f1, support of arrays of labels, in one pass; 0 where there is nothing to divide by."""
    has = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))
    zero = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    rows = []
    for x in labels:
        t, f, b = F.count_if(has(truth, x)), F.count_if(has(found, x)), F.count_if(has(truth, x) & has(found, x))
        rows.append(F.struct(F.lit(x).alias("label"), zero(b, f).alias("precision"), zero(b, t).alias("recall"), zero(2 * b, t + f).alias("f1"), t.alias("support")))
    return df.agg(F.array(*rows).alias("x")).select(F.inline("x"))


def threshold_f1(df: DataFrame, score: Column, truth: Column, thresholds: list[float]) -> DataFrame:
    """threshold, f1 of ``score >= threshold`` against a 0/1 truth, in one pass."""
    hit = lambda t: score >= t
    f1 = [F.try_divide(2.0 * F.count_if(hit(t) & (truth == 1)), F.count_if(hit(t)) + F.sum(truth)) for t in thresholds]
    return df.agg(F.array(*(F.struct(F.lit(t).alias("threshold"), F.round(f, 6).alias("f1")) for t, f in zip(thresholds, f1, strict=True))).alias("x")).select(F.inline("x"))
