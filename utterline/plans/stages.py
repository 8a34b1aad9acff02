"""The stages of a run over a folder of tables, each written as a new version that later stages read.

Tables of the folder: ``dialogs`` (id, file_name, duration, status, answer), ``rows`` (id, dialog_id, row_num, row_text, speaker_id,
start, end). Written: ``criteria`` (appended: rows that have none), ``answers`` (appended: dialogs that have none), ``summary`` (whole).
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, fuzzy, jsons, text
from ..operators import dialogs
from ..sources.tables import require_columns, unprocessed

STAGES = ("detect-criteria", "llm-process", "report")


@dataclass(frozen=True)
class Config:
    """Lexicons by kind: ``words`` stand alone in a row, ``fuzzy`` phrases need a score of ``threshold``. ``off`` names detectors that don't run."""

    words: Mapping[str, list] = field(default_factory=dict)
    fuzzy: Mapping[str, list] = field(default_factory=dict)
    threshold: float = 80
    off: tuple = ()
    enums: Mapping[str, list] = field(default_factory=dict)
    least_length: int = 5

    @staticmethod
    def read(path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                found = yaml.safe_load(f) or {}
            else:
                found = json.load(f)
        if unknown := sorted(set(found) - {x.name for x in fields(Config)}):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return Config(**found)

    def detectors(self, column: str) -> dict[str, Column]:
        low = F.lower(F.col(column))
        found = {n: F.array_join(text.matched(low, w), ", ") for n, w in self.words.items()} | {n: fuzzy.best_phrase(low, p, self.threshold) for n, p in self.fuzzy.items()}
        return {n: c for n, c in found.items() if n not in self.off}


def read(spark: SparkSession, folder: str, name: str, needed: tuple = ()) -> DataFrame:
    return require_columns(spark.read.parquet(f"{folder}/{name}"), needed)


def read_if_there(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def detect_criteria(spark: SparkSession, folder: str, config: Config) -> None:
    """Run the detectors on rows with a text that have no criteria yet; a second run adds nothing."""
    rows = read(spark, folder, "rows", ("id", "row_text"))
    done = read_if_there(spark, folder, "criteria")
    fresh = rows.where(text.present(F.col("row_text"))) if done is None else unprocessed(rows, done, "id", "row_text")
    fresh.select("id", *(c.alias(n) for n, c in config.detectors("row_text").items())).write.mode("append").parquet(f"{folder}/criteria")


def llm_process(spark: SparkSession, folder: str, config: Config, provider: Callable[[DataFrame], DataFrame]) -> None:
    """Ask ``provider`` about dialogs without an answer: it gets id and transcript and gives id and answer (any text, mended here)."""
    rows = read(spark, folder, "rows", ("dialog_id", "row_num", "row_text", "speaker_id"))
    said = dialogs_of(rows).where(F.char_length("transcript") >= config.least_length)
    done = read_if_there(spark, folder, "answers")
    asked = said if done is None else said.join(done.where("answer <> '{}'").select("id"), "id", "left_anti")
    provider(asked).select("id", jsons.repair("answer").alias("answer")).where("answer <> '{}'").write.mode("append").parquet(f"{folder}/answers")


def dialogs_of(rows: DataFrame) -> DataFrame:
    from ..operators.report import transcript

    return rows.groupBy(F.col("dialog_id").alias("id")).agg(transcript(F.concat_ws(": ", "speaker_id", "row_text"), F.col("row_num")).alias("transcript"))


def report(spark: SparkSession, folder: str, config: Config) -> None:
    """One row for each dialog with an answer: criteria phrases, loudness aside, and the answer's fields."""
    criteria, found = read(spark, folder, "criteria"), read_if_there(spark, folder, "answers")
    names = [c for c in criteria.columns if c != "id"]
    rows = read(spark, folder, "rows", ("id", "dialog_id", "row_num", "speaker_id")).join(criteria, "id")
    per = dialogs.summary(rows, "dialog_id", "row_num", "speaker_id", criteria=names)
    if found is not None:
        flat = answers.flatten(F.col("answer"), config.enums)
        per = per.join(found.select(F.col("id").alias("dialog_id"), *(c.alias(f"llm_{n}") for n, c in flat.items())), "dialog_id")
    per.write.mode("overwrite").parquet(f"{folder}/summary")


def status(spark: SparkSession, folder: str) -> dict:
    """Rows, rows with criteria, dialogs with answers, and the share of rows that are done."""
    n = read(spark, folder, "rows").count()
    have = {t: 0 if (df := read_if_there(spark, folder, t)) is None else df.select("id").distinct().count() for t in ("criteria", "answers")}
    return {"rows": n, **have, "coverage": round(100 * have["criteria"] / n, 2) if n else 0.0}


def run_all(spark: SparkSession, folder: str, config: Config, provider: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """All stages in order; without a provider no answers are asked for."""
    detect_criteria(spark, folder, config)
    if provider is not None:
        llm_process(spark, folder, config, provider)
    report(spark, folder, config)
    return status(spark, folder)


def provider_of(name: str) -> Callable[[DataFrame], DataFrame]:
    """The function ``module:function``."""
    import importlib

    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def validate(path: str) -> Config:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return Config.read(path)
