"""A training corpus from raw documents: five stages, each on all that the one before it kept.

Nulls, in every stage: a null or empty text is a document without words. The classifier scores it as such; it has no near copy and
no repeat, keeps its text as it is, and is packed as its end id alone. Rows without doc_id are scored, never near copies, come first among
repeats, and are packed. Rows that repeat a doc_id and its text are near copies of each other, so one stays; without words all do.
Columns beyond doc_id and text pass through unchanged, whatever their names, but for n_chars, which follows the text where there is such a column; the last
stage returns pieces. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterline.llm import ngram_join, packing, pii, quality, substrings
from utterline.llm.common import discard, fresh, mark, read_table, release, staged_path, write_out


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, with n_chars of the text as it is now."""
    kind = dict(docs.dtypes).get("n_chars")
    return (docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))) if kind else docs).select(*columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), training=~quality.held_out())
    return quality.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays."""
    return ngram_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that came before are cut out; documents of which nothing is left go."""
    counts = tuple(fresh(n, docs) for n in substrings.COUNTS)
    cut = substrings.remove_repeats(docs, counts=counts)
    return _counted(cut.where((F.col(counts[1]) == 0) | (F.trim("text") != "")), docs.columns)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of their format, with the key of the session's setting ``spark.utterline.pii.key``."""
    return _counted(pii.pseudonymize(docs, pii.session_key(spark), counts=False), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in windows of 2048: doc_id, start, length, doc_tokens, sequence_id, offset and ids of each piece."""
    return packing.pack(docs)


STAGES = [("quality_classifier", drop_low_quality), ("ngram_jaccard_join", drop_near_copies), ("suffix_array_dedup", cut_repeats), ("pii", pseudonymize), ("packing", pack)]
#: The classifier, the pseudonyms and the tokenizer can't be written in SQL; tests/llm/test_pipeline.py has a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stages goes once it is written, and its own table once the next one is."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = staged_path(spark, name)
        since = mark()
        write_out(stage(spark, docs, sf_dir), path)
        release(since)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
