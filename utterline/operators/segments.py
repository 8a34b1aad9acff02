"""Clean-up of time segments within a file: rounding, dwell, cut points, centroids, first-speaker names.

Where each row depends on what became of the one before, a file's rows go through one Arrow group; a file is one
recording, so its size is bounded by its length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship


def snap_spans(df: DataFrame, first: float = 0.15, least: float = 0.30) -> DataFrame:
    """Starts no earlier than ``first``; spans shorter than ``least`` go."""
    return df.withColumn("start", F.greatest(F.lit(first), F.col("start"))).where(F.round(F.col("end") - F.col("start"), 9) >= least)


def extend_back(df: DataFrame, group: str) -> DataFrame:
    """Adds ``extended_start``: the end of the segment before, 0 for a file's first."""
    return df.withColumn("extended_start", F.coalesce(F.lag("end").over(W.partitionBy(group).orderBy("start", "end")), F.lit(0.0)))


def encode_labels(df: DataFrame, group: str, label: str, most: int = 5) -> DataFrame:
    """Adds ``code``: the place of the label among the file's first ``most`` sorted labels, from 0; -1 for the rest and for null."""
    rank = F.dense_rank().over(W.partitionBy(group).orderBy(F.asc_nulls_last(label)))
    return df.withColumn("code", F.when(F.col(label).isNotNull() & (rank <= most), rank - 1).otherwise(-1))


def join_adjacent(df: DataFrame, group: str, speaker: str, text: str, gap: float = 0.0) -> DataFrame:
    """Phrases of one speaker that follow within ``gap`` become one: group, speaker, start, end, text, n_rows."""
    w = W.partitionBy(group).orderBy("start", "end")
    same = F.lag(speaker).over(w).eqNullSafe(F.col(speaker)) & (F.round(F.col("start") - F.lag("end").over(w), 9) <= gap)
    numbered = df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("start", "end", F.col(text).alias("t"))))
    out = numbered.groupBy(group, "_run", speaker).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias(text), F.count("*").alias("n_rows"))
    return out.drop("_run")


def copies_of_previous(df: DataFrame, group: str, speaker: str, text: str) -> DataFrame:
    """Adds ``copied``: text and speaker are those of the row before."""
    w = W.partitionBy(group).orderBy("start", "end")
    return df.withColumn("copied", F.coalesce((F.lag(speaker).over(w) == F.col(speaker)) & (F.lag(text).over(w) == F.col(text)), F.lit(False)))


def first_speakers(df: DataFrame, group: str, speaker: str, window: float = 12.0, names: tuple[str, str] = ("Speaker 1", "Speaker 2")) -> DataFrame:
    """Adds ``named``: who speaks longest before ``window`` has the first name, the next to start the second; others keep theirs."""
    inside = F.greatest(F.lit(0.0), F.least(F.col("end"), F.lit(window)) - F.greatest(F.col("start"), F.lit(0.0)))
    spoken = df.groupBy(group, speaker).agg(F.round(F.sum(inside), 6).alias("_spoken"), F.min("start").alias("_from"))
    lead = F.row_number().over(W.partitionBy(group).orderBy(F.desc("_spoken"), "_from", speaker))
    rest = F.row_number().over(W.partitionBy(group).orderBy(F.col("_lead") == 1, "_from", speaker))
    ranked = spoken.withColumn("_lead", lead).withColumn("_rest", rest)
    named = ranked.select(group, speaker, F.when(F.col("_lead") == 1, names[0]).when(F.col("_rest") == 1, names[1]).otherwise(F.col(speaker)).alias("named"))
    return df.join(named, [group, speaker], "left")


def centroids(df: DataFrame, group: str, embedding: str, labels: list | None = None) -> DataFrame:
    """group, centroid: the mean of a label's vectors, scaled to length 1. Summed by position, so no vectors are collected.

    A label of ``labels`` without vectors gets the vector that lies farthest from the mean of all, the least of equals.
    """
    at = df.select(group, F.posexplode(embedding).alias("_i", "_x"))
    whole = lambda d: d.agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda p: p["_m"]).alias("_v"))
    mean = whole(at.groupBy(group, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m")).groupBy(group))
    if labels is not None:
        middle = whole(at.groupBy("_i").agg(F.avg(F.col("_x").cast("double")).alias("_m")).groupBy())
        apart = F.aggregate(F.zip_with(embedding, "_v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        plain = F.transform(embedding, lambda x: x.cast("double"))
        far = df.join(F.broadcast(middle)).agg(F.min(F.struct((-apart).alias("d"), plain.alias("v")))["v"].alias("_far"))
        known = df.sparkSession.createDataFrame([(x,) for x in labels], df.select(group).schema)
        mean = known.join(mean, group, "left").join(F.broadcast(far)).select(group, F.coalesce("_v", "_far").alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    return mean.withColumn("_n", norm).select(group, F.transform("_v", lambda x: F.coalesce(F.try_divide(x, F.col("_n")), F.lit(0.0))).alias("centroid"))


def round_out(start: Column, end: Column, step: float = 0.05) -> tuple[Column, Column]:
    """Start down and end up to multiples of ``step``."""
    return F.round(F.floor(start / step + 1e-9) * step, 6), F.round(F.ceil(end / step - 1e-9) * step, 6)


def keep_on_small_margin(labels: np.ndarray, scores: np.ndarray, tau: float = 0.025) -> np.ndarray:
    """Where the two best scores of a row lie less than ``tau`` apart, the label before goes on."""
    top = np.sort(scores, axis=1)
    labels = np.array(labels)
    sure = top[:, -1] - top[:, -2] >= tau if scores.shape[1] > 1 else np.ones(len(labels), bool)
    if len(labels):
        sure[0] = True
    return labels[np.maximum.accumulate(np.where(sure, np.arange(len(labels)), 0))]


def min_dwell(labels: np.ndarray, start: np.ndarray, end: np.ndarray, least: float = 1.0, passes: int = 5) -> np.ndarray:
    """Runs under ``least`` seconds take the label of their longer neighbour, the earlier of equals.

    A pass goes over the runs it begins with from left to right; what a run takes on is seen by those behind it. A run lasts from
    its first start to its last end. Ends after ``passes`` or when no run is short.
    """
    y = np.array(labels)
    for _ in range(passes):
        cuts = np.flatnonzero(y[1:] != y[:-1]) + 1
        first, last = np.r_[0, cuts], np.r_[cuts, len(y)] - 1
        if len(first) <= 1:
            break
        length = end[last] - start[first]
        short = np.flatnonzero(length < least - 1e-6)
        for k in short.tolist():
            before = length[k - 1] if k else -1.0
            after = length[k + 1] if k + 1 < len(length) else -1.0
            y[first[k] : last[k] + 1] = y[first[k] - 1] if before >= after else y[last[k] + 1]
        if not len(short):
            break
    return y


def enforce_dwell(df: DataFrame, group: str, order: str, label: str, least: float = 1.0) -> DataFrame:
    """group, order, ``label`` after ``min_dwell`` on the rows' ``start`` and ``end``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return pd.DataFrame({group: pdf[group], order: pdf[order], label: min_dwell(pdf[label].to_numpy(), pdf["start"].to_numpy(float), pdf["end"].to_numpy(float), least)})

    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    return df.select(group, order, label, "start", "end").groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, {label} {kinds[label]}")


def phrase_numbers(df: DataFrame, group: str) -> DataFrame:
    """Adds ``phrase_id``: the place within the file, from 1."""
    return df.withColumn("phrase_id", F.row_number().over(W.partitionBy(group).orderBy("start", "end")))


def transcript_lines(df: DataFrame, group: str, speaker: str, text: str, gap: float = 0.35, least: float = 0.35) -> DataFrame:
    """Rows of ``join_adjacent`` without segments under ``least`` seconds."""
    return join_adjacent(df.where(F.round(F.col("end") - F.col("start"), 9) >= least), group, speaker, text, gap)


def two_clusters(x: np.ndarray, least: float = 0.15) -> np.ndarray:
    """Labels 0 and 1 by average linkage on cosine distances; the first row has label 0.

    If one side has under ``least`` of the rows, rows are split at the middle of their order along the line between the two means.
    Uses nearest-neighbour chains: time grows as the square of the rows, and so does memory (4 bytes a pair).
    """
    n = len(x)
    if n < 2:
        return np.zeros(n, int)
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(alive.argmax()))
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((float(d[a, b]), a, b))
        row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a], d[b], d[:, b] = row, row, np.inf, np.inf
        d[a, a] = np.inf
        size[a] += size[b]
        alive[b] = False
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    top = max(range(len(merges)), key=lambda k: (merges[k][0], k))
    for k, (_, a, b) in enumerate(merges):
        if k != top:
            parent[root(a)] = root(b)
    roots = np.array([root(i) for i in range(n)])
    labels = (roots != roots[0]).astype(int)
    if not least <= labels.mean() <= 1 - least:
        line = unit[labels == 1].mean(0) - unit[labels == 0].mean(0)
        labels = np.zeros(n, int)
        labels[np.argsort(unit @ line, kind="stable")[n // 2 :]] = 1
    return labels


def speaker_clusters(df: DataFrame, group: str, order: str, embedding: str, least: float = 0.15) -> DataFrame:
    """group, order, ``label``: a file's windows in two clusters. All of a file's windows meet in one task, so groups must be files."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return pd.DataFrame({group: pdf[group], order: pdf[order], "label": two_clusters(np.stack(pdf[embedding].map(np.asarray)), least)})

    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    return df.where(F.col(embedding).isNotNull()).select(group, order, embedding).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, label int")
