"""Topics of a text, several at once: weighted n-grams and one logistic regression for each topic."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Generator, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse_space
from ..shipping import give_back, ship, spread
from ..streaming.files import shared_folder
from . import grams


#: While blocks are read: slices of each pass don't stay on disk, and one block is in memory at a time, on its way through the JVM too.
_PASS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.columnarReaderBatchSize": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
#: For Parquet: a group of rows ends once it has so many bytes, looked at after each row.
_FILES = {"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
SPEAKERS = ("sales", "client", "user", "assistant")


def _unled(c: Column, speakers: Sequence[str]) -> Column:
    """Lower-case lines without the speaker before a colon."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?im)^\s*(?:{'|'.join(speakers)})\s*:\s*", ""))


def clean(c: Column, speakers: Sequence[str] = SPEAKERS) -> Column:
    """Lower-case lines without the speaker before a colon, on one line."""
    return collapse_space(_unled(c, speakers))


def _words(text: str) -> Column:
    """Words of letters and digits between single blanks."""
    return F.trim(F.regexp_replace(_unled(F.col(text), speakers=SPEAKERS), r"[^\p{L}\p{N}]+", " "))


@dataclass
class Features:
    """What an n-gram weighs, by the bucket it is hashed to."""

    idf: np.ndarray


@dataclass
class Model:
    """A logistic regression over the buckets."""

    weights: np.ndarray
    intercept: float


@contextlib.contextmanager
def _passing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _PASS}
    try:
        for k, v in _PASS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _each(rows: DataFrame, size: int, of: Callable[[dict], np.ndarray], slices: int = 12) -> np.ndarray:
    """The sum over all blocks of what ``of`` gives of one. Executors sum it too, slice by slice, so the driver gets one array, however many tasks there are."""
    ship()
    names, cuts = rows.columns, [size * i // slices for i in range(slices + 1)]

    def part(place, v):
        return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["place", "v"])

    def run(batches):
        out = np.zeros(size)
        for x in batches:
            for i in range(x.num_rows):
                out += of({k: np.frombuffer(x.column(j)[i].as_buffer(), grams.TYPES[k]) for j, k in enumerate(names)}).ravel()
        for i in range(slices):
            yield part(i, out[cuts[i] : cuts[i + 1]])

    def added(batches):
        out: dict[int, np.ndarray] = {}
        for x in batches:
            for place, v in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                v = np.frombuffer(v.as_buffer(), np.float64)
                out[place] = out[place] + v if place in out else v.copy()
        for place, v in out.items():
            yield part(place, v)

    kind, out = "place int, v binary", np.zeros(size)
    with _passing(rows.sparkSession):
        for r in rows.mapInArrow(run, kind).repartition(slices, "place").mapInArrow(added, kind).collect():
            out[cuts[r.place] : cuts[r.place + 1]] = np.frombuffer(r.v, np.float64)
    return out


def _written(df: DataFrame, names: Sequence[str], make: Callable, path: str) -> DataFrame:
    """Blocks that ``make`` yields of batches, as files that every later pass reads; a row is one block."""
    ship()

    def run(batches):
        for x in batches:
            for b in make(x):
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(b[k], grams.TYPES[k]).tobytes()], pa.binary()) for k in names], list(names))
                give_back()

    kind = ", ".join(f"{k} binary" for k in names)
    df.mapInArrow(run, kind).write.options(**_FILES).parquet(path)
    return df.sparkSession.read.schema(kind).parquet(path)


def _descent(x: np.ndarray, iterations: int, enough: float = 1e-6, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS: yields where it wants the function and its slope, and gets them; returns where it ends."""
    f, g = yield x
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(iterations):
        if not np.abs(g).max() > 0:
            break
        d, back = -g, []
        for s, y, sy in reversed(past):
            back.append(s @ d / sy)
            d = d - back[-1] * y
        d = d * (past[-1][2] / (past[-1][1] @ past[-1][1]) if past else 1 / np.linalg.norm(g))
        for (s, y, sy), a in zip(past, reversed(back), strict=True):
            d = d + s * (a - y @ d / sy)
        slope, step = g @ d, 1.0
        for _ in range(20):
            tf, tg = yield x + step * d
            if tf <= f + 1e-4 * step * slope:
                break
            a, b = slope + tg @ d - 3 * (tf - f) / step, tg @ d  # where the cubic with both values and both slopes is least
            c = np.sqrt(max(a * a - slope * b, 0.0))
            step *= min(max(1 - (b + c - a) / (b - slope + 2 * c), 0.05), 0.7) if b > slope else 0.5
        else:
            break
        s, y = step * d, tg - g
        settled = abs(f - tf) <= enough * max(abs(f), abs(tf))
        x, f, g = x + s, tf, tg
        if settled:
            break
        if s @ y > 1e-12 * (y @ y):
            s, y = s.astype(np.float32), y.astype(np.float32)
            past = [*past, (s, y, float(s @ y))][-memory:]
    return x


def _minimise(evaluate: Callable[[np.ndarray, list[int]], Iterable[tuple[float, np.ndarray]]], x: np.ndarray, iterations: int) -> np.ndarray:
    """Rows of ``x``, each at the least of its own smooth function; one call of ``evaluate`` serves all that aren't there yet."""
    runs = [_descent(own, iterations) for own in x]
    asked, best = {t: next(run) for t, run in enumerate(runs)}, x.copy()
    while asked:
        on = list(asked)
        for t, got in zip(on, evaluate(np.stack([asked[t] for t in on]), on), strict=True):
            try:
                asked[t] = runs[t].send(got)
            except StopIteration as end:
                best[t] = end.value
                del asked[t]
    return best


def fit(df: DataFrame, text: str, labels: str, topics: Sequence[str], buckets: int = 1 << 17, least: int = 3, iterations: int = 200) -> tuple[Features, dict[str, Model]]:
    """Features, and a model for each topic that some rows have and some lack, its classes weighted to be even.

    N-grams are hashed into ``buckets``, so no vocabulary is gathered, whatever the corpus; buckets of fewer than ``least`` rows
    weigh nothing. A model is learnt until its loss settles (``_descent``), or for 200 ``iterations`` as in the reference. Counts are not dampened, and n-grams that most rows have are left to their low weights.

    A text is a vector of length 1. Rows are kept as counts of words (``grams``) in the shared folder while the models learn, all
    topics in one pass; weights are held small (1e-3) over each bucket's deviation.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/topics-{uuid.uuid4().hex}"
    has = F.transform(F.array(*map(F.lit, topics)), lambda t: F.coalesce(F.array_contains(labels, t), F.lit(False)).cast("int"))
    k, m = buckets, len(topics)
    base = [n for n in grams.TYPES if n != "norm"]

    def remove(path):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def made(x):
        texts, truth = x.column(0), np.array(x.column(1).to_pylist(), np.uint8).reshape(x.num_rows, m)
        for a, b in grams.cuts(pc.binary_length(texts).to_pylist()):
            yield grams.block(texts.slice(a, b - a).to_pylist(), k) | {"truth": truth[a:b]}

    def counted(b):
        y = b["truth"].reshape(-1, m)
        return np.concatenate([grams.rows_with(b, k), [len(y)], y.sum(0, dtype=np.int64)]).astype(np.float64)

    def normed(x):
        for i in range(x.num_rows):
            b = {n: np.frombuffer(x.column(j)[i].as_buffer(), grams.TYPES[n]) for j, n in enumerate(base)}
            yield b | {"norm": grams.norms(b, idf)}

    def moments(b):
        """Sums by bucket, of all rows and of each topic's, and those of the squares."""
        y = np.concatenate([np.ones((len(b["norm"]), 1), np.uint8), b["truth"].reshape(-1, m)], 1)
        two = np.zeros((m + 1, k))
        found = grams.squares(b, idf)
        for i in range(0, len(y), 64):
            idx, square = zip(*((idx, s / n**2) for n, (idx, s) in zip(b["norm"][i : i + 64], found)), strict=True)  # noqa: B905 - the norms end first
            own = np.repeat(y[i : i + 64], list(map(len, idx)), axis=0).T > 0
            idx, square = np.concatenate(idx), np.concatenate(square)
            for t in range(m + 1):
                two[t] += np.bincount(idx[own[t]], square[own[t]], k) if t else np.bincount(idx, square, k)
        return np.stack([grams.back(grams.wide(b), y.T / b["norm"], k) * idf, two])

    try:
        rows = _written(spread(df.select(_words(text).alias("_text"), has.alias("_has"))), base, made, f"{folder}/counts")
        sums = _each(rows, k + 1 + m, counted)
        n, with_bucket, of = sums[k], sums[:k], sums[k + 1 :]
        idf = np.where(with_bucket >= least, np.log((n + 1) / (with_bucket + 1)), 0.0)
        some = [t for t in range(m) if 0 < of[t] < n]
        if not some:
            return Features(idf), {}
        with _passing(spark):
            rows = _written(rows, list(grams.TYPES), normed, f"{folder}/rows")
        remove(f"{folder}/counts")
        one, two = _each(rows, 2 * (m + 1) * k, moments).reshape(2, m + 1, k)
        yes, no = n / (2 * of[some, None]), n / (2 * (n - of[some, None]))
        mean, square = ((no * s[0] + (yes - no) * s[1:][some]) / n for s in (one, two))
        weight2 = yes**2 * of[some, None] + no**2 * (n - of[some, None])
        deviation = np.sqrt(np.maximum(square - mean**2, 0) * n / (n - weight2 / n))
        scale = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 1e-12)
        shift = mean * scale

        def evaluate(x, on):
            w, intercept = x[:, :k], x[:, k] - (x[:, :k] * shift[on]).sum(1)
            by = spark.sparkContext.broadcast(w * scale[on] * idf)  # a closure of this size would stay on every executor's disk

            def loss(b):
                b = grams.wide(b)
                y = b["truth"].reshape(-1, m)[:, [some[t] for t in on]].T.astype(np.float64)
                z = grams.times(b, by.value) / b["norm"] + intercept[:, None]
                weight = np.where(y > 0, yes[on], no[on])
                r = weight * (0.5 * (1 + np.tanh(z / 2)) - y)
                return np.concatenate([grams.back(b, r / b["norm"], k), r.sum(1, keepdims=True), (weight * (np.logaddexp(0, z) - y * z)).sum(1, keepdims=True)], 1)

            try:
                out = _each(rows, len(on) * (k + 2), loss).reshape(len(on), k + 2) / n
            finally:
                by.destroy()
            slope = out[:, :k] * idf * scale[on] - out[:, k : k + 1] * shift[on] + 1e-3 * w
            return zip(out[:, k + 1] + 0.5e-3 * (w * w).sum(1), np.concatenate([slope, out[:, k : k + 1]], 1), strict=True)

        best = _minimise(evaluate, np.zeros((len(some), k + 1)), iterations)
    finally:
        remove(folder)
    return Features(idf), {topics[t]: Model(x[:k] * s, float(x[k] - x[:k] @ h)) for t, x, s, h in zip(some, best, scale, shift, strict=True)}


def probabilities(df: DataFrame, text: str, features: Features, models: dict[str, Model]) -> Column:
    """Of each topic, in the models' order, as one array."""
    ship()
    idf, by = features.idf, np.stack([m.weights for m in models.values()]) * features.idf
    intercept = np.array([m.intercept for m in models.values()])

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = np.empty((len(texts), len(by)))
            for a, b in grams.cuts(pc.binary_length(texts).to_pylist()):
                rows = grams.block(texts.slice(a, b - a).to_pylist(), len(idf))
                z = grams.times(grams.wide(rows), by) / grams.norms(rows, idf) + intercept[:, None]
                out[a:b] = (0.5 * (1 + np.tanh(z / 2))).T
                give_back()
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(by), pa.int32()), pa.array(out.ravel()))

    return run(_words(text))


def predict(df: DataFrame, text: str, features: Features, models: dict[str, Model], threshold: float = 0.5) -> DataFrame:
    """Adds ``topics``: those whose probability is at least ``threshold``, in the models' order."""
    if not models:
        return df.select(*df.columns, F.array().cast("array<string>").alias("topics"))
    out = spread(df).withColumn("_p", probabilities(df, text, features, models))
    return out.select(*df.columns, F.array_compact(F.array(*(F.when(F.get("_p", i) >= threshold, F.lit(t)) for i, t in enumerate(models)))).alias("topics"))


def f1(df: DataFrame, truth: str, found: str, topics: Sequence[str]) -> DataFrame:
    """micro and macro F1 of two arrays of topics, in one pass."""
    has = lambda c, t: F.coalesce(F.array_contains(c, t), F.lit(False))
    both = [F.count_if(has(truth, t) & has(found, t)) for t in topics]
    some = [F.count_if(has(truth, t)) + F.count_if(has(found, t)) for t in topics]
    per = [F.coalesce(F.try_divide(2.0 * b, s), F.lit(0.0)) for b, s in zip(both, some, strict=True)]
    total = lambda cs: sum(cs[1:], cs[0])
    return df.agg(F.coalesce(F.try_divide(2.0 * total(both), total(some)), F.lit(0.0)).alias("micro_f1"), (total(per) / len(topics)).alias("macro_f1"))


def split(df: DataFrame, key: str, share: float = 0.15, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows: ``share`` of the keys, by their hash, so a row is on the same side in every run."""
    held = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000)) < int(share * 10_000)
    return df.where(~held), df.where(held)


def best_threshold(df: DataFrame, text: str, labels: str, features: Features, models: dict[str, Model], steps: int = 17) -> float:
    """The first of ``steps`` thresholds from 0.1 to 0.9 with the best micro F1 on the rows."""
    out = spread(df).withColumn("_p", probabilities(df, text, features, models) if models else F.array().cast("array<double>"))
    at = [round(0.1 + 0.8 * k / (steps - 1), 4) for k in range(steps)]
    truth = lambda t: F.coalesce(F.array_contains(labels, t), F.lit(False))
    sums = []
    for k, x in enumerate(at):
        hit = {t: F.get("_p", i) >= x for i, t in enumerate(models)}
        both = sum((F.count_if(hit[t] & truth(t)) for t in models), F.lit(0))
        sums.append(F.coalesce(F.try_divide(2.0 * both, sum((F.count_if(hit[t]) + F.count_if(truth(t)) for t in models), F.lit(0))), F.lit(0.0)).alias(f"f{k}"))
    found = out.agg(*sums).first()
    return at[max(range(steps), key=lambda k: (found[f"f{k}"], -k))]


def save(path: str, features: Features, models: dict[str, Model], threshold: float = 0.5) -> None:
    """A folder with the features, a model for each topic, and their names and threshold."""
    spark = SparkSession.active()
    rows = [(-1, None, threshold, features.idf.tobytes()), *((i, t, m.intercept, m.weights.tobytes()) for i, (t, m) in enumerate(models.items()))]
    spark.createDataFrame([(i, t, float(x), bytearray(v)) for i, t, x, v in rows], "place int, topic string, number double, weights binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(path: str) -> tuple[Features, dict[str, Model], float]:
    """What ``save`` wrote."""
    first, *rest = SparkSession.active().read.parquet(path).orderBy("place").collect()
    models = {r.topic: Model(np.frombuffer(r.weights), r.number) for r in rest}
    return Features(np.frombuffer(first.weights)), models, first.number
