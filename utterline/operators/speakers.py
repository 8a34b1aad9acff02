"""Who speaks: roles from phrases, and which rows are looked at for it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fuzzy, text
from .sequence import await_relabel


def by_score(rows: DataFrame, dialog: str, order: str, speaker: str, sells: Column, buys: Column) -> DataFrame:
    """Adds ``role``: SALES for the speaker with most selling less buying rows, CLIENT for the others; the speaker's own label in a dialog without either.

    Of equals the one who had a selling row first, then a buying one.
    """
    s, b = (F.coalesce(c, F.lit(False)) for c in (sells, buys))
    scores = rows.groupBy(dialog, speaker).agg(F.sum(s.cast("int") - b.cast("int")).alias("_score"), F.min(F.when(s, F.col(order))).alias("_sold"), F.min(F.when(b, F.col(order))).alias("_bought"))
    hit = scores.where("_sold IS NOT NULL OR _bought IS NOT NULL")
    best = F.row_number().over(W.partitionBy(dialog).orderBy(F.desc("_score"), F.asc_nulls_last("_sold"), F.asc_nulls_last("_bought"), speaker))
    first = hit.withColumn("_r", best).where("_r = 1").select(dialog, F.col(speaker).alias("_seller"), F.lit(True).alias("_any"))
    out = rows.join(first, dialog, "left")
    return out.withColumn("_role", F.when(F.col("_any").isNull(), F.col(speaker)).when(F.col(speaker).eqNullSafe(F.col("_seller")), "SALES").otherwise("CLIENT")).drop("_seller", "_any", "role").withColumnRenamed("_role", "role")


def detected(rows: DataFrame, dialog: str, order: str, speaker: str, sells: Column, await_: Column, greeting: Column) -> DataFrame:
    """Adds ``detected_speaker_id``: SALES where a selling phrase is found, else the speaker; then rows between an await and the next greeting are SHOULD_BE_CLIENT."""
    marked = await_relabel(rows, dialog, order, await_.isNotNull(), greeting.isNotNull())
    return marked.withColumn("detected_speaker_id", F.when(F.col("should_be_client"), "SHOULD_BE_CLIENT").when(F.coalesce(sells, F.lit(False)), "SALES").otherwise(F.col(speaker))).drop("should_be_client")


def without_clients(rows: DataFrame, speaker: str, nulls: bool = True) -> DataFrame:
    """Rows that aren't the client's; those without a speaker stay unless ``nulls`` is off, as in SQL."""
    other = F.col(speaker) != "CLIENT"
    return rows.where(F.coalesce(other, F.lit(True)) if nulls else other)


def without_criteria(rows: DataFrame, criteria: DataFrame, key: str, foreign: str, speaker: str) -> DataFrame:
    """Rows that have no criteria yet and whose speaker is known not to be the client."""
    return without_clients(rows, speaker, nulls=False).join(criteria.select(F.col(foreign).alias(key)), key, "left_anti")


def speaker_column(df: DataFrame, names: Iterable[str] = ("speaker_id", "detected_speaker_id")) -> str | None:
    """The first of ``names`` that there is."""
    return next((n for n in names if n in df.columns), None)


def speaker_name(label: Column) -> Column:
    """Speaker_1 for label 0, and so on."""
    return F.concat(F.lit("Speaker_"), (label + 1).cast("string"))


def searched(rows: DataFrame, column: str, words: str) -> DataFrame:
    """Rows whose text has the words, whatever their case."""
    return rows.where(F.contains(F.lower(column), F.lit(words.lower())))


def nearest_pattern(embedding: Column, patterns: Mapping[str, list[float]], threshold: float = 0.95) -> Column:
    """The pattern of the greatest cosine similarity, the first of equals; null under the threshold. ``patterns`` are a lexicon's vectors."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    known = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(-k).alias("place"), F.array(*map(F.lit, map(float, v))).alias("v")) for k, (n, v) in enumerate(patterns.items())))
    sims = F.transform(known, lambda p: F.struct(F.try_divide(dot(embedding, p["v"]), F.sqrt(dot(embedding, embedding) * dot(p["v"], p["v"]))).alias("sim"), p["place"].alias("place"), p["name"].alias("name")))
    best = F.array_max(sims)
    return F.when(best["sim"] >= threshold, best["name"])


def subset_or_nearest(c: Column, phrases: Iterable[str], embedding: Column | None = None, patterns: Mapping[str, list[float]] | None = None, threshold: float = 0.95) -> Column:
    """The first phrase whose words are all among the text's; else the nearest by embedding; else, without embeddings, by token sets."""
    phrases = list(phrases)
    exact = text.word_subset(F.split(F.trim(c), r"\s+"), phrases)
    rest = nearest_pattern(embedding, patterns, threshold) if embedding is not None and patterns else fuzzy.best_token_set(c, phrases, 100 * threshold)
    return F.coalesce(exact, rest)
