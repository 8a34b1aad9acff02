"""Quality classifier: random-indexing vectors pooled per document, and a two-layer network with a temperature.

Random indexing. Each word and each *form* (the signs around a word, capitals, digits, a word like the one before it, a line seen before)
has a sparse ternary index vector that follows from its hash. A word's context vector is the sum of the index vectors
of its neighbours over the labelled sample. A document is the mean of its words' context vectors, of their
index vectors and of its forms' index vectors.

The network (numpy, tanh, one hidden layer) learns from labels of the training rows alone; a temperature fitted on a part
of them that the network hasn't seen turns its outputs into probabilities. ``most_labelled`` bounds the sample (the
rows of least hash of doc_id); scores use whole texts. Labels, language, source and doc_id are never inputs.

Nulls: a null or empty text is a document without words, and gets the score of its zero vector. Rows with a null doc_id are
scored and never learned from. Of several labels of a doc_id the lowest counts; null labels are ignored. Without
both labels to learn from every score is the share of label 1, or 0.5. Other columns are kept; an input column named ``score`` is
replaced by ``score`` and kept by ``keep_good``. Repeated rows are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, arrow_map, doc_hash_column, fresh, pieces, stage, task_id, texts_of

WORDS, FORMS, DIM, NONZERO, SIDE = 1 << 14, 1 << 10, 32, 4, 2
MOST_LABELLED, SAMPLE_TASKS, THRESHOLD = 20_000, 16, 0.3


def _ternary(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.float32)
    at = np.argsort(rng.random((n, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (n, NONZERO)), axis=1)
    return out


def _bucket(text: str, n: int) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) % n


def _unit(chunk: str) -> int:
    """Word bucket and form bucket of a chunk between blanks, in one number."""
    core = chunk.strip("\"'()[]{}.,;:!?#*$%&|<>-_/\\")
    lead, _, tail = chunk.partition(core) if core else ("", "", chunk)
    if core.isupper() and len(core) > 1:
        tail += "A"
    if any(c.isdigit() for c in core):
        tail += "9"
    return _bucket(core.lower(), WORDS) | _bucket(lead + "_" + tail, FORMS) << 14


_STATE: dict = {}


def _tables() -> dict:
    if not _STATE:
        _STATE.update(words=_ternary(WORDS, 1), forms=_ternary(FORMS, 2), units=Generations(_unit, (__name__,)), line_again=_bucket("line again", FORMS), word_again=_bucket("word again", FORMS))
    return _STATE


def units(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets and form buckets of a text; a word like the one before and the words of a line seen before give a form more."""
    get, lines = _tables()["units"].__getitem__, text.split("\n")
    seen, again = set(), 0
    out = []
    for line in lines:
        own = line.split()
        if own:
            if line in seen:
                again += len(own)
            seen.add(line)
            out.extend(map(get, own))
    u = np.array(out, np.int32)
    words = u & (WORDS - 1)
    twice = int((words[1:] == words[:-1]).sum())
    return words, np.concatenate([u >> 14, np.repeat(np.array([_STATE["line_again"], _STATE["word_again"]], np.int32), [again, twice])])


def contexts(text: str, table: np.ndarray) -> None:
    """Add to each word of ``table`` the index vectors of its neighbours in the text."""
    w, _ = units(text)
    r = _tables()["words"][w]
    near = np.zeros_like(r)
    for k in range(1, SIDE + 1):
        near[k:] += r[:-k]
        near[:-k] += r[k:]
    np.add.at(table, w, near)


def pooled(text: str, context: np.ndarray) -> np.ndarray:
    (words, forms), s, out = units(text), _tables(), np.zeros(3 * DIM)
    if not len(words):
        return out
    for i in range(0, len(forms), 1 << 16):
        w, f = words[i : i + (1 << 16)], forms[i : i + (1 << 16)]
        out += np.concatenate([context[w].sum(axis=0), s["words"][w].sum(axis=0), s["forms"][f].sum(axis=0)])
    return out / len(words)


@dataclass
class Model:
    """``context`` (words x DIM), the network's weights, and the temperature."""

    context: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 30, decay: float = 3e-3, seed: int = 7) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], float]:
    """Adam on cross-entropy; the last tenth (after a fixed shuffle) fits the temperature."""
    rng = np.random.default_rng(seed)
    by = rng.permutation(len(x))
    x, y = x[by], y[by].astype(float)
    cut = max(1, len(x) // 10)
    x, y, xv, yv = x[:-cut], y[:-cut], x[-cut:], y[-cut:]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[rows]) / max(1, len(rows))
            dh = np.outer(d, p[2]) * (1 - h * h)
            g = [z[rows].T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], d.sum()]
            t += 1
            for k in range(4):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    raw = np.tanh((xv - mean) / scale @ p[0] + p[1]) @ p[2] + p[3]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
    loss = [np.logaddexp(0, -np.where(yv > 0.5, raw, -raw) / s).mean() for s in grid]
    return mean, scale, p, float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_labelled: int = MOST_LABELLED, training=None) -> Model:
    """Learn from the labelled rows that ``training`` (a condition on doc_id; all, if none) allows."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("_label"))
    known = known if training is None else known.where(training)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)  # so broadcasting it is bounded
    own = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = stage(own.join(F.broadcast(known), "doc_id").repartition(SAMPLE_TASKS, F.xxhash64("doc_id", "text")), "labelled")

    def sums(batches):
        table = np.zeros((WORDS, DIM), np.float32)
        for batch in batches:
            for piece in pieces(batch):
                for t in texts_of(piece.column("text")):
                    contexts(t, table)
        yield pa.RecordBatch.from_arrays([pa.array([task_id()], pa.int32()), pa.array([table.tobytes()], pa.binary())], ["task", "sums"])

    context = np.zeros((WORDS, DIM), np.float64)
    for r in arrow_map(sample, sums, "task int, sums binary").toLocalIterator():  # one table at a time
        context += np.frombuffer(r["sums"], np.float32).reshape(WORDS, DIM)
    context = (context / np.maximum(1e-9, np.linalg.norm(context, axis=1, keepdims=True))).astype(np.float32)

    rows = sorted((r["doc_id"], r["label"], r["x"]) for r in _features(sample.withColumnRenamed("_label", "label"), context).collect())
    x, y = np.array([np.frombuffer(r[2], np.float32) for r in rows], float).reshape(-1, 3 * DIM), np.array([r[1] for r in rows])
    if len(rows) < 20 or len(set(y.tolist())) < 2:
        return Model(context, np.zeros(3 * DIM), np.ones(3 * DIM), [], 1.0, float(y.mean()) if len(y) else 0.5)
    return Model(context, *fit_network(x, y))


def _features(sample: DataFrame, context: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = [pooled(t, context).astype(np.float32).tobytes() for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.binary())], ["doc_id", "label", "x"])

    return arrow_map(sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text"), run, "doc_id long, label int, x binary")


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score, as ``name``, behind them."""
    from pyspark.sql import types as T

    docs = docs.drop(name).withColumn(text, F.col(text).cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text):
                x = np.array([pooled(t, model.context) for t in texts_of(piece.column(text))]).reshape(-1, 3 * DIM)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(model.probabilities(x))], schema.names)

    return arrow_map(docs, run, schema)


def held_out(column: str = "doc_id"):
    return doc_hash_column(column) % 5 == 0


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier doesn't reject."""
    name = fresh("_score", docs)
    return score(docs, model, name=name).where(F.col(name) >= threshold).drop(name)
