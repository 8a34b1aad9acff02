"""Models of the caller's as functions over Arrow-batched rows: retries, and the rules around what they return.

A provider is any function; each worker makes its own by calling ``make()`` once a task, so clients and models are never pickled.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import audio
from ..functions.jsons import repair_text
from ..shipping import ship, spread

#: Fields of a call's analysis, and outcomes and moods that count. Fixed values.
OUTCOMES = ("next_step_set", "resolved", "unresolved", "followup_needed")
MOODS = ("positive", "neutral", "negative")


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows with plain Python values in columns that aren't seconds: empty Arrow-backed strings don't pass into Spark."""
    return pd.DataFrame(rows, columns=columns, dtype=object).astype({"start": float, "end": float})


def tried(ask: Callable[[Any], Any], x: Any, tries: int = 3, backoff: float = 1.8, warm_up: Callable[[], Any] | None = None, sleep: Callable[[float], None] = time.sleep) -> tuple[Any, str | None]:
    """(answer, None), or (None, the last error) after ``tries``; waits ``backoff`` to the power of the failures so far, after a warm-up that may fail."""
    error = None
    for k in range(tries):
        try:
            return ask(x), None
        except Exception as e:  # noqa: BLE001 - whatever a provider raises is its answer
            error = f"{type(e).__name__}: {e}"
            if k + 1 < tries:
                if warm_up:
                    try:
                        warm_up()
                    except Exception:  # noqa: BLE001
                        pass
                sleep(backoff**k)
    return None, error


def answers(rows: DataFrame, key: str, said: str, make: Callable[[], Callable[[str], str | None]], prompt: str = "{}", tries: int = 3, backoff: float = 1.8) -> DataFrame:
    """key, answer (a JSON object, mended; {} for what isn't one), error: what a language model says to ``prompt`` with each text in it."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for pdf in batches:
            got = [tried(ask, prompt.replace("{}", t or ""), tries, backoff) for t in pdf[said]]
            yield pd.DataFrame({key: pdf[key], "answer": [repair_text(a) if e is None else None for a, e in got], "error": [e for _, e in got]})

    ship(rows.sparkSession)
    return spread(rows.select(key, said), key).mapInPandas(run, f"{key} {kind}, answer string, error string")


def call_analysis(rows: DataFrame, key: str, said: str, make: Callable[[], Callable[[str], str | None]], prompt: str = "{}") -> DataFrame:
    """key, topic, outcome, sentiment, summary, action_items of each transcript; empty where an answer lacks them or says what isn't allowed."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for pdf in batches:
            found = [json.loads(repair_text(tried(ask, prompt.replace("{}", t or ""), 1)[0])) for t in pdf[said]]
            text = lambda a, f: a.get(f) if isinstance(a.get(f), str) else ""
            yield pd.DataFrame({
                key: pdf[key], "topic": [text(a, "topic") for a in found], "outcome": [text(a, "outcome") if a.get("outcome") in OUTCOMES else "" for a in found],
                "sentiment": [text(a, "sentiment") if a.get("sentiment") in MOODS else "" for a in found], "summary": [text(a, "summary") for a in found],
                "action_items": [[str(i) for i in a["action_items"]] if isinstance(a.get("action_items"), list) else [] for a in found]})

    ship(rows.sparkSession)
    return spread(rows.select(key, said), key).mapInPandas(run, f"{key} {kind}, topic string, outcome string, sentiment string, summary string, action_items array<string>")


def recognised(files: DataFrame, spans: DataFrame, make: Callable[[], Callable[[np.ndarray, int], str]], rate: int = audio.RATE, least: float = 0.29, boilerplate: Iterable[str] = ()) -> DataFrame:
    """file_name, start, end, text of each span (file_name, start, end): what a recogniser makes of its samples at ``rate``.

    Spans under ``least`` seconds aren't asked about and have an empty text. A file's sound is decoded once, for all of its spans.
    """
    drop = list(boilerplate)

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _frame([], ["file_name", "start", "end", "text"])
        hear = make()
        x, own = audio.decode(left["content"].iloc[0])
        x = audio.resample(x, own, rate)
        out = []
        for s, e in sorted(zip(right["start"], right["end"], strict=True)):
            said = hear(x[int(s * rate) : int(e * rate)], rate) if e - s >= least - 1e-9 else ""
            for b in drop:
                said = said.replace(b, "")
            out.append((key[0], s, e, said.strip()))
        return _frame(out, ["file_name", "start", "end", "text"])

    ship(files.sparkSession)
    return files.select("file_name", "content").groupBy("file_name").cogroup(spans.select("file_name", "start", "end").groupBy("file_name")).applyInPandas(run, "file_name string, start double, end double, text string")


def voiced(files: DataFrame, make: Callable[[], Callable[[np.ndarray, int], list[tuple[float, float]]]], rate: int = audio.RATE, most: float | None = None) -> DataFrame:
    """file_name, start, end of what a voice activity detector finds; ``most`` seconds of each file are looked at, all if none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = make()
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["file_name"], pdf["content"], strict=True):
                x, own = audio.decode(content)
                x = audio.resample(x, own, rate)
                rows += [(name, float(s), float(e)) for s, e in find(x if most is None else x[: int(most * rate)], rate)]
            yield _frame(rows, ["file_name", "start", "end"])

    ship(files.sparkSession)
    return files.select("file_name", "content").mapInPandas(run, "file_name string, start double, end double")


def embedded(files: DataFrame, windows: DataFrame, make: Callable[[], Callable[[np.ndarray, int], np.ndarray]], rate: int = audio.RATE, seconds: float = 1.0) -> DataFrame:
    """file_name, start, end, embedding (of length 1) of each window's samples, repeated or cut to ``seconds``."""
    n = int(seconds * rate)

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _frame([], ["file_name", "start", "end", "embedding"])
        see = make()
        x, own = audio.decode(left["content"].iloc[0])
        x = audio.resample(x, own, rate)
        out = []
        for s, e in sorted(zip(right["start"], right["end"], strict=True)):
            v = np.asarray(see(audio.cmvn(audio.fit_length(x[int(s * rate) : int(e * rate)], n)), rate), float)
            out.append((key[0], s, e, (v / (np.linalg.norm(v) + 1e-12)).tolist()))
        return _frame(out, ["file_name", "start", "end", "embedding"])

    ship(files.sparkSession)
    return files.select("file_name", "content").groupBy("file_name").cogroup(windows.select("file_name", "start", "end").groupBy("file_name")).applyInPandas(run, "file_name string, start double, end double, embedding array<double>")


def with_fallback(first: Callable[[Any], Any], second: Callable[[Any], Any]) -> Callable[[Any], Any]:
    """Ask the second where the first fails."""

    def ask(x):
        try:
            return first(x)
        except Exception:  # noqa: BLE001
            return second(x)

    return ask


def timed(segments: list[tuple[float, float, str]], least: float = 0.1) -> list[tuple[float, float, str]]:
    """Segments of a recogniser's answer in order; one that doesn't last gets ``least`` seconds."""
    return [(s, e if e > s else s + least, t) for s, e, t in sorted(segments)]
