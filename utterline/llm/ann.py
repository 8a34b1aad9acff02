"""Approximate nearest neighbours on shifted space-filling curves.

Nearness is the inner product, in double precision, on the vectors as given. Vectors get one more coordinate that brings
all to the greatest norm (queries get 0 there), so the largest product is the least distance.

Curves. Random rotations are cut into ``AXES`` axes each; every such projection, spread by its mean and deviation and shifted, is
numbered along a Hilbert curve. There are more curves as there are more rows (``curves_for``). A vector stands on the ``COPIES`` curves
on which it lies farthest from the middle, since that is where a curve tells its neighbours from the rest, and a query asks the
``probes_for`` curves on which it does itself; a small table has few curves and every vector stands on all. Rows are range-partitioned
by curve and key in Spark; their ranks, from the counts of the partitions, cut each curve into blocks of ``BLOCK`` rows. A query meets
its own block and those beside it.

What travels along the curves is a sketch of a byte for each component. A block gives a query's best by sketch, tasks and
then one shuffle merge them, and the best ``k + MORE`` of all curves are compared with the vectors themselves, which are read for these alone.

Equal vectors are one class: one place on each curve, with its least ``k + 1`` ids (all that can be in an answer), cut
before any shuffle. So a vector that a third of the rows share costs one row, and ties go to smaller ids exactly.

``exact`` compares every query with every row in blocks instead, for tables where that is wanted, and to measure recall against.

Nulls: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part;
neither do rows without id. Rows equal in id and vector are one. An id with several vectors is a candidate with each, never
for itself. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, hot_join, part_of, stage, task_id

AXES, BITS, BLOCK, COPIES, MORE = 4, 6, 256, 24, 20
#: Rows for each curve, the fewest and most curves. The frames of the most are a bounded broadcast: 4096 * AXES * 4 bytes a dimension.
ROWS_A_CURVE, LEAST_CURVES, MOST_CURVES = 390, 16, 4096
#: Entries that a task holds before it merges them, and bytes of vectors in a block of the exact search.
HELD, EXACT_BYTES = 1 << 20, 32 << 20
_ANSWER = "query_id long, rank int, vec_id long, score double"


def curves_for(rows: int) -> int:
    return min(MOST_CURVES, max(LEAST_CURVES, -(-rows // ROWS_A_CURVE)))


def probes_for(curves: int) -> int:
    """Curves that a query asks: all of few, and as the square root of many."""
    return min(curves, round(4 * curves**0.5))


def reach_for(rows: int, curves: int, copies: int, block: int) -> int:
    """Blocks to either side: one, and more once the curves are at their most, so that a query still sees a sixteenth of a curve."""
    return max(1, round(rows * copies / (curves * block * 32)))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells (rows of non-negative integers under 2**bits) along a Hilbert curve, as int64."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] >> b) & 1)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _lifted(x: np.ndarray, query: bool, most: float) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1))
    if query:
        return np.column_stack([x / norm[:, None], np.zeros(len(x))])
    return np.column_stack([x / most, np.sqrt(np.maximum(0, most * most - norm * norm)) / most])


class Curves:
    """Frames (d + 1, curves, axes), spread to mean 0 and deviation 1, and shifts."""

    def __init__(self, curves: int, axes: int, mean: np.ndarray, second: np.ndarray):
        d, rng = len(mean), np.random.default_rng(0xC0DE)
        self.axes = min(axes, d)
        each = d // self.axes
        frames = [np.linalg.qr(rng.normal(size=(d, d)))[0][:, : each * self.axes].reshape(d, each, self.axes) for _ in range(-(-curves // each))]
        frame = np.concatenate(frames, axis=1)[:, :curves]
        spread = np.sqrt(np.maximum(np.einsum("dca,de,eca->ca", frame, second - np.outer(mean, mean), frame), 1e-12))
        self.frame = (frame / spread).astype(np.float32)
        self.middle = np.einsum("d,dca->ca", mean, frame) / spread
        self.shift = rng.random((curves, self.axes))

    def places(self, x: np.ndarray, copies: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(curve, key), one row each for each of the ``copies`` curves on which a vector lies farthest out."""
        n, curves = len(x), self.frame.shape[1]
        z = (x.astype(np.float32) @ self.frame.reshape(len(self.frame), -1)).reshape(n, curves, self.axes) - self.middle.astype(np.float32)
        own = np.argpartition(-(z * z).sum(axis=2), copies - 1, axis=1)[:, :copies] if copies < curves else np.tile(np.arange(curves), (n, 1))
        u = np.clip(np.take_along_axis(z, own[:, :, None], axis=1) / 8 + 0.5, 0, 1)
        cells = np.minimum((u + self.shift[own]) * (1 << bits - 1), (1 << bits) - 1).reshape(-1, self.axes)
        return own, hilbert(cells, bits).reshape(n, -1)


def _sketches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each component, and what a step is worth."""
    step = np.abs(x).max(axis=1) / 127
    return np.rint(x / step[:, None]).astype(np.int8), step.astype(np.float32)


def _merged(query: np.ndarray, found: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` best of each query, best first; a row found twice counts once."""
    by = np.lexsort([-score, found, query])
    query, found, score = query[by], found[by], score[by]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (found[1:] != found[:-1])
    query, found, score = query[new], found[new], score[new]
    by = np.lexsort([found, -score, query])
    query, found, score = query[by], found[by], score[by]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < most
    return query[keep], found[keep], score[keep]


def _classes(own: DataFrame, query: Column, k: int) -> DataFrame:
    """cls, embedding, ids (the least k + 1 of its rows), asked (its rows that are queries)."""
    ranked = own.withColumn("r", F.dense_rank().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = ranked.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    asked = own.where(query).distinct().groupBy("embedding").agg(F.count("*").alias("asked"))
    found = ids.join(asked, "embedding", "left").select("embedding", "ids", F.coalesce("asked", F.lit(0)).alias("asked"))
    return stage(found.withColumn("cls", F.monotonically_increasing_id()), "classes")  # numbers that the files fix


def _usable(vectors: DataFrame) -> tuple[DataFrame, int, float]:
    """The rows that take part, their length and greatest norm; length 0 if there are none."""
    v = F.col("embedding")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    own = own.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda e: e != 0))
    sizes = own.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate(v, F.lit(0.0), lambda a, e: a + e.cast("double") * e)).alias("sq")).collect()
    if not sizes:
        return own, 0, 0.0
    d = max(sizes, key=lambda r: (r["n"], -r["d"]))["d"]
    return own.where(F.size(v) == d), d, max(r["sq"] for r in sizes if r["d"] == d) ** 0.5


def _answers(own: DataFrame, query: Column, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The answers from ``pairs`` (asking class, found class): exact products, then ids in the place of classes."""
    vectors = classes.select(F.col("cls").alias("found"), F.col("embedding").alias("other"), "ids")
    times = pairs.groupBy("found").agg(F.count("*").alias("n")).join(vectors, "found")  # a vector of great norm is in many answers
    met = hot_join(pairs, times, ["found"], "n").join(classes.select("cls", "embedding"), "cls")
    product = F.aggregate(F.zip_with("embedding", "other", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    each = met.select("cls", "ids", (-product).alias("s")).select("cls", F.transform("ids", lambda i: F.struct("s", i.alias("vec_id"))).alias("rows"))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("rows"))), 1, k + 1)
    named = stage(each.groupBy("cls").agg(best.alias("best")).join(classes.where("asked > 0").select("cls", "embedding", "asked"), "cls"), "named")
    queries = own.where(query).distinct().select(F.col("vec_id").alias("query_id"), "embedding")
    out = hot_join(queries, named, ["embedding"], "asked").select("query_id", F.filter("best", lambda f: f["vec_id"] != F.col("query_id")).alias("best"))
    return out.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("p", "f")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.s")).alias("score"))


def search(vectors: DataFrame, query: Column, k: int = 20, curves: int | None = None, copies: int = COPIES, probes: int | None = None, block: int = BLOCK, axes: int = AXES, bits: int = BITS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best found for each row that ``query`` (a condition on vec_id) holds for."""
    own, d, most = _usable(vectors)
    if not d:
        return vectors.sparkSession.createDataFrame([], _ANSWER)
    classes = _classes(own, query, k)
    rows = classes.count()
    curves = curves or curves_for(rows)
    copies, probes = min(copies, curves), min(probes or probes_for(curves), curves)
    reach = reach_for(rows, curves, copies, block)

    def moments(batches):
        total = np.zeros((d + 1, d + 2))
        for batch in batches:
            y = _lifted(_matrix(batch.column("embedding")), False, most)
            total += y.T @ np.column_stack([y, np.ones(len(y))])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

    seen = arrow_map(classes.select("embedding").coalesce(64), moments, "sums array<double>").collect()  # (d + 1) * (d + 2) numbers for each of 64 tasks
    sums = np.sum([r["sums"] for r in seen], axis=0).reshape(d + 1, d + 2) / rows
    shared = vectors.sparkSession.sparkContext.broadcast(Curves(curves, axes, sums[:, -1], sums[:, :-1]))
    step_rows = max(16, (1 << 22) // (curves * axes))

    def keys(batches):
        for batch in batches:
            x, asked = _matrix(batch.column("embedding")), batch.column("asked").to_numpy(zero_copy_only=False) > 0
            cls = batch.column("cls").to_numpy()
            for at in range(0, len(x), step_rows):
                part = slice(at, at + step_rows)
                for is_query, times in ((False, copies), (True, probes)):
                    own, which = x[part][asked[part]] if is_query else x[part], cls[part][asked[part]] if is_query else cls[part]
                    if not len(own):
                        continue
                    curve, key = shared.value.places(_lifted(own, is_query, most), times, bits)
                    if is_query:
                        marks, worth = [q.tobytes() for q in (own / np.abs(own).max(axis=1, keepdims=True)).astype("<f4")], np.zeros(len(own), np.float32)
                    else:
                        sketch, worth = _sketches(own)
                        marks = [s.tobytes() for s in sketch]
                    take = np.repeat(np.arange(len(own)), times)
                    yield pa.RecordBatch.from_arrays([pa.array(curve.ravel().astype(np.int32)), pa.array(key.ravel()), pa.array(which[take]), pa.array(np.full(len(take), is_query)), pa.array(worth[take]), pa.array(marks, pa.binary()).take(pa.array(take))], ["curve", "key", "cls", "is_query", "worth", "sketch"])

    def number(batches):
        part, at = task_id(), {}
        for batch in batches:
            c = batch.column("curve").to_numpy()
            place = np.empty(len(c), np.int64)
            for curve in np.unique(c).tolist():
                own = np.flatnonzero(c == curve)
                place[own] = at.get(curve, 0) + np.arange(len(own))
                at[curve] = at.get(curve, 0) + len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part, np.int32)), pa.array(place), *batch.columns], ["part", "place", *batch.schema.names])

    schema, order = "curve int, key long, cls long, is_query boolean, worth float, sketch binary", ["curve", "key", "cls", "is_query"]
    keyed = arrow_map(classes.select("cls", "embedding", "asked"), keys, schema)
    ranged = keyed.repartitionByRange(part_of(vectors), *order).sortWithinPartitions(*order)
    placed = stage(arrow_map(ranged, number, f"part int, place long, {schema}"), "curves")
    # a row for each curve of each task: curves, and tasks once more, at most; running sums are the ranks
    before = placed.groupBy("curve", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.partitionBy("curve").orderBy("part")) - F.col("n")).drop("n")
    blocks = placed.join(F.broadcast(before), ["curve", "part"]).withColumn("own", F.floor((F.col("place") + F.col("before")) / block).cast("long"))
    near = F.when(F.col("is_query"), F.sequence(F.col("own") - reach, F.col("own") + reach)).otherwise(F.array("own"))
    # neighbouring blocks go to one task, so that what a query finds in them is merged there
    met = blocks.select("curve", F.explode(near).alias("block"), "is_query", "cls", "worth", "sketch").repartition(part_of(vectors), "curve", F.floor(F.col("block") / 64))
    best = arrow_map(met.sortWithinPartitions("curve", "block"), _in_blocks(k + 1 + MORE), "cls long, best array<struct<s float, found bigint>>")
    return _answers(own, query, classes, _best_pairs(best, k + 1 + MORE), k)


def _best_pairs(best: DataFrame, most: int) -> DataFrame:
    """(asking class, found class) of the ``most`` best of all tasks' lists."""
    ordered = F.transform(F.sort_array(F.flatten(F.collect_list("best")), False), lambda f: f["found"])
    merged = best.groupBy("cls").agg(F.slice(F.array_distinct(ordered), 1, most).alias("found"))
    return stage(merged.select("cls", F.explode("found").alias("found")), "pairs")


def _in_blocks(most: int):
    """Rows ordered by (curve, block) to each query's best by sketch: holds one block and HELD entries."""

    def scored(rows: pa.Table):
        q = rows.column("is_query").to_numpy()
        asked, there = np.flatnonzero(q), np.flatnonzero(~q)
        if not len(asked) or not len(there):
            return None
        sketch, cls = rows.column("sketch").combine_chunks(), rows.column("cls").to_numpy()
        ask = np.frombuffer(b"".join(sketch.take(pa.array(asked)).to_pylist()), "<f4").reshape(len(asked), -1)
        rest = np.frombuffer(b"".join(sketch.take(pa.array(there)).to_pylist()), np.int8).reshape(len(there), -1).astype(np.float32)
        score = ask @ rest.T * rows.column("worth").to_numpy()[there]
        m = min(most, len(there))
        top = np.argpartition(-score, m - 1, axis=1)[:, :m]
        return np.repeat(cls[asked], m), cls[there][top].ravel(), np.take_along_axis(score, top, axis=1).ravel()

    def run(batches):
        held, size = [], 0

        def give():
            query, found, score = _merged(*(np.concatenate(c) for c in zip(*held, strict=True)), most)
            first = np.flatnonzero(np.diff(query, prepend=query[0] - 1)) if len(query) else np.zeros(0, np.int64)
            rows = pa.StructArray.from_arrays([pa.array(score.astype(np.float32)), pa.array(found)], ["s", "found"])
            return pa.RecordBatch.from_arrays([pa.array(query[first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(query)).astype(np.int32)), rows)], ["cls", "best"])

        for rows in _groups(batches, ["curve", "block"]):
            if (found := scored(rows)) is not None:
                held.append(found)
                size += len(found[0])
                if size >= HELD:
                    yield give()
                    held, size = [], 0
        if held:
            yield give()

    return run


def _groups(batches, names: list[str]):
    """Tables of the rows that agree in ``names``, which order the rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(n).to_numpy() for n in names]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        if held and any(held[-1].column(n)[-1].as_py() != batch.column(n)[0].as_py() for n in names):
            yield pa.Table.from_batches(held)
            held = []
        ends = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def exact(vectors: DataFrame, query: Column, k: int = 20) -> DataFrame:
    """As ``search``, but every query meets every row: blocks of queries times blocks of rows, each of bounded size."""
    own, d, _ = _usable(vectors)
    if not d:
        return vectors.sparkSession.createDataFrame([], _ANSWER)
    classes = _classes(own, query, k)
    counts = classes.agg(F.count("*").alias("rows"), F.count_if(F.col("asked") > 0).alias("asked")).first()
    side = max(256, EXACT_BYTES // (8 * d))
    wide, high = max(1, -(-counts["asked"] // side)), max(1, -(-counts["rows"] // side))

    def keys(batches):
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([v.tobytes() for v in x.astype("<f8")], pa.binary())], ["cls", "sketch"])

    flat = F.xxhash64("cls")
    rows = arrow_map(classes.select("cls", "embedding"), keys, "cls long, sketch binary").select(F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("curve"), F.pmod(flat, F.lit(high)).alias("block"), F.lit(False).alias("is_query"), "cls", "sketch")
    asked = arrow_map(classes.where("asked > 0").select("cls", "embedding"), keys, "cls long, sketch binary").select(F.pmod(flat, F.lit(wide)).cast("int").alias("curve"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(high - 1).cast("long"))).alias("block"), F.lit(True).alias("is_query"), "cls", "sketch")
    met = rows.unionByName(asked).repartition(part_of(vectors), "curve", "block").sortWithinPartitions("curve", "block", "is_query")
    best = arrow_map(met, _exact_blocks(k + 1 + MORE), "cls long, best array<struct<s float, found bigint>>")
    return _answers(own, query, classes, _best_pairs(best, k + 1 + MORE), k)


def _exact_blocks(most: int):
    def run(batches):
        for rows in _groups(batches, ["curve", "block"]):
            q = rows.column("is_query").to_numpy()
            asked, there = np.flatnonzero(q), np.flatnonzero(~q)
            if not len(asked) or not len(there):
                continue
            x = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), "<f8").reshape(rows.num_rows, -1)
            cls = rows.column("cls").to_numpy()
            for at in range(0, len(asked), 256):
                part = asked[at : at + 256]
                score = x[part] @ x[there].T
                m = min(most, len(there))
                top = np.argpartition(-score, m - 1, axis=1)[:, :m]
                found = pa.StructArray.from_arrays([pa.array(np.take_along_axis(score, top, axis=1).ravel().astype(np.float32)), pa.array(cls[there][top].ravel())], ["s", "found"])
                yield pa.RecordBatch.from_arrays([pa.array(cls[part]), pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * m), found)], ["cls", "best"])

    return run
