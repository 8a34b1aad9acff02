"""N-gram Jaccard self-join with MinHash bands, verified on full n-gram sets.

An n-gram is five neighbouring words (lower case, letters and digits only: signs between and around words don't
count); a document of one to four words is one n-gram. Documents without words take no part. At the threshold of 0.8 a
copy of n words may differ in about n / 50 words; copies that differ more are not links, by definition.

1. Signatures. Each document gives a key of its n-gram set, MinHash values in bands, and a byte of each value as its
   *sketch*; rows and bands are the steepest that meet a recall target at the threshold (``choose_bands``).
2. Classes. Documents of equal sets are one class, found by a map-side aggregation, and only its least doc_id goes on, so
   thousands of copies cost one row.
3. Buckets. Classes are shuffled on band hashes; each is linked with the least one of its bucket, which is linear
   in the bucket's size. Sketches prune what can't matter: Jaccard distance is a metric, so a class far under ``2 * threshold - 1``
   from the hub has no partner among the hub's copies, and all partners of a class close to the hub are linked to the hub too. What
   is neither goes on with another hub, and after ``ROUNDS`` hubs the rest of a bucket is linked without a look. So
   components of the links hold all candidate pairs, and chance collisions of bands don't grow into chains.
4. Verification. A component's n-gram sets meet in blocks of bounded size (a large component is dealt over triangular
   blocks), where intersections are counted exactly. A block returns a row for each class: how many documents it is linked
   to and the least class it hangs together with. Pairs are never emitted.
5. Classes that links join are one group; its id is the least doc_id.

Buckets, hubs, components and classes that hold a large share of the rows are joined to staged tables of one row a key, where
Spark's adaptive skew join deals a hot key's rows over tasks (an aggregate right below a join would keep it from that).

Nulls: null and empty texts get their own doc_id as class_id and no links. Documents with a null doc_id take no part
and get a null class_id. Rows that repeat a doc_id with the same text are copies (counted as links); rows that share a doc_id
but not the text are decided each for itself. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Generations, arrow_map, fresh, pieces, stage, texts_of
from .components import components

N, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Most hashes that a signature may take, and classes in a side of a verification block.
HASHES, BLOCK = 160, 256
#: Hubs that a bucket tries, and how far sketches may err: a sketch of 156 values is 0.04 off (one deviation) at 0.6, where a link begins
#: to matter at the threshold of 0.8, and 0.03 at 0.8 itself. A class that is wrongly taken for close still has its partners linked.
ROUNDS, LINK_SLACK, CLOSE_SLACK = 1, 0.2, 0.1
#: Bytes of n-grams in a side of a verification block, about.
BLOCK_BYTES = 32 << 20
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0xD6E8FEB86659FD93)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): as many rows as ``hashes`` allow while a pair at the threshold meets in a band with probability ``recall``."""
    for rows in range(hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("no bands within so few hashes")


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(0x5EED)
    return rng.integers(1, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


_WORDS: list[Generations] = []


def _word_hash() -> Generations:
    if not _WORDS:
        _WORDS.append(Generations(lambda w: xxhash.xxh3_64_intdigest(w.encode()), (__name__,)))
    return _WORDS[0]


def ngrams(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-grams."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hash().__getitem__, words), np.uint64, len(words))
    m = max(1, len(h) - n + 1)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(n, len(h))):
            out = (out ^ (out >> np.uint64(29))) * _MIX + h[k : k + m]
        out = (out ^ (out >> np.uint64(32))) * _MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)


def minhash(grams: np.ndarray, count: int, seeds: tuple[np.ndarray, np.ndarray], step: int = 4096) -> np.ndarray:
    """The least of ``count`` hashes over all n-grams, as uint32."""
    low = (grams >> np.uint64(16)).astype(np.uint32)
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), step):
        x = low[i : i + step, None] * seeds[0]
        x += seeds[1]
        np.minimum(least, x.min(axis=0), out=least)
    return least


def band_hashes(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band, as int64."""
    h = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for r in least.reshape(bands, rows).T.astype(np.uint64):
            h = (h ^ (h >> np.uint64(29)) ^ r) * _MIX
    return h.view(np.int64)


def sketch(least: np.ndarray) -> bytes:
    """A mixed byte of each value."""
    with np.errstate(over="ignore"):
        return (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def _keys(g: np.ndarray) -> tuple[int, int]:
    """Two 64-bit keys of an n-gram set."""
    if not len(g):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(g.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(g * _MIX).view(np.int64))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_grams, two keys of the n-gram set, band hashes and sketch."""

    def run(batches):
        seeds = _seeds(bands * rows)
        for batch in batches:
            for piece in pieces(batch):
                sizes, one, two, hashes, sketches = [], [], [], [], []
                for t in texts_of(piece.column("text")):
                    g = ngrams(t, n)
                    sizes.append(len(g))
                    a, b = _keys(g)
                    one.append(a)
                    two.append(b)
                    least = minhash(g, bands * rows, seeds) if len(g) else None
                    hashes.append(None if least is None else band_hashes(least, bands, rows))
                    sketches.append(None if least is None else sketch(least))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "n_grams", "key1", "key2", "bands", "sketch"])

    return arrow_map(docs, run, "doc_id long, n_grams long, key1 long, key2 long, bands array<bigint>, sketch binary")


def _links(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j within ``left`` if there is no ``right``) of sets whose Jaccard similarity is at least ``threshold``."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(grams, kind="stable")
    grams, owner = grams[by], owner[by]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # the others count for sizes alone
    owner, column = owner[shared], column[shared]
    n, m = len(left), len(right or left)
    common = np.zeros((n, m), np.float32)
    if len(column):
        _, column = np.unique(column, return_inverse=True)
        width = 4096
        ends = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            dense = np.zeros((len(sets), width), np.float32)
            dense[owner[a:b], column[a:b] - k * width] = 1
            common += dense[:n] @ (dense[n:] if right is not None else dense).T
    other = sizes[n:] if right is not None else sizes
    union = sizes[:n, None] + other[None, :] - common
    i, j = np.nonzero(common >= threshold * union - 1e-6)
    keep = slice(None) if right is not None else i < j
    return i[keep], j[keep]


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _block(ids: list[int], sides: list[int], copies: list[int], sets: list[np.ndarray], threshold: float):
    """(class, linked documents, least class it is joined to here) of a block; ``sides`` tells the two sides of a block off the diagonal."""
    order = sorted(range(len(ids)), key=lambda i: (sides[i], ids[i]))
    left, right = [i for i in order if not sides[i]], [i for i in order if sides[i]]
    if not left or sides and any(sides) and not right:
        return []
    i, j = _links([sets[k] for k in left], [sets[k] for k in right] if right else None, threshold)
    a, b = np.array(left)[i], np.array(right or left)[j]
    weight, total = np.array(copies, np.int64), np.zeros(len(ids), np.int64)
    np.add.at(total, a, weight[b])
    np.add.at(total, b, weight[a])
    parent = list(range(len(ids)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = _find(parent, x), _find(parent, y)
        if x != y:
            x, y = (x, y) if ids[x] < ids[y] else (y, x)
            parent[y] = x
    return [(ids[k], int(total[k]), ids[_find(parent, k)]) for k in range(len(ids)) if total[k]]


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """Rows (component, bi, bj, side, cls, copies, grams) to (cls, links, least). Sorted within tasks; holds one block."""

    def rows(batches):
        names = ("component", "bi", "bj", "side", "cls", "copies", "grams")
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)

    def run(batches):
        out: list = []

        def give():
            cls, links, least = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (cls, links, least)], ["cls", "links", "least"])

        for _, group in groupby(rows(batches), key=lambda r: r[:3]):
            _, _, _, sides, ids, copies, grams = zip(*group, strict=True)
            out.extend(_block(list(ids), list(sides), list(copies), [np.frombuffer(g, np.uint64) for g in grams], threshold))
            if len(out) >= 4096:
                yield give()
        if out:
            yield give()

    key = ["component", "bi", "bj"]
    return arrow_map(members.repartition(*key).sortWithinPartitions(*key), run, "cls long, links long, least long")


def similarity(a: Column, b: Column, values: int) -> Column:
    """Estimated Jaccard similarity of two sketches: the share of equal bytes, less what chance gives."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(values)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    return (same / values - 1 / 256) / (1 - 1 / 256)


def candidates(classes: DataFrame, threshold: float, values: int) -> DataFrame:
    """Links (a, b) whose components hold every pair of classes that share a band, but for those that sketches rule out."""
    link, close_from = 2 * threshold - 1 - LINK_SLACK, threshold + CLOSE_SLACK
    sketches = classes.select("cls", "sketch")
    opened = classes.select("cls", F.explode("bands").alias("band"))
    found = None
    for at in range(ROUNDS + 1):
        hubs = stage(opened.groupBy("band").agg(F.min("cls").alias("hub"), F.count("*").alias("size")).where("size > 1"), "hubs")
        met = opened.join(hubs, "band").where("cls <> hub")
        if at == ROUNDS:  # buckets that no hub settles
            return found.unionByName(met.select(F.col("cls").alias("a"), F.col("hub").alias("b")))
        met = stage(met, "buckets")
        pairs = met.select("cls", "hub").distinct().join(sketches, "cls").join(sketches.withColumnsRenamed({"cls": "hub", "sketch": "hub_sketch"}), "hub")
        close = stage(pairs.select("cls", "hub", similarity(F.col("sketch"), F.col("hub_sketch"), values).alias("near")), "near")
        kept = close.where(F.col("near") >= link).select(F.col("cls").alias("a"), F.col("hub").alias("b"))
        found = kept if found is None else found.unionByName(kept)
        opened = stage(met.where("size > 2").join(close.where(F.col("near") < close_from), ["cls", "hub"]).select("cls", "band"), "open")
        if not opened.count():
            return found
    return found


def _gram_sets(own: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """cls, grams (sorted uint64 as bytes) of the classes ``wanted`` (cls, doc_id, key1, key2): each computed once, from a text of its least doc_id."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                ids, out = [], []
                for cls, a, b, t in zip(*(piece.column(c).to_pylist() for c in ("cls", "key1", "key2", "text")), strict=True):
                    g = ngrams(t or "", n)
                    if _keys(g) == (a, b):  # rows that share the id may have other texts
                        ids.append(cls)
                        out.append(g.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["cls", "grams"])

    return arrow_map(own.join(wanted, "doc_id").select("cls", "key1", "key2", "text"), run, "cls long, grams binary").dropDuplicates(["cls"])


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (least doc_id of its group), n_links (documents of similarity ``threshold`` or more), n_copies (documents of the same n-gram set, itself included)."""
    bands, rows = choose_bands(threshold, recall, hashes)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = stage(signatures(own, n, bands, rows), "signatures")
    key = ["key1", "key2", "n_grams"]
    usable = sig.where("n_grams > 0 AND doc_id IS NOT NULL")
    grouped = usable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = stage(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")  # numbers that the files fix
    found = stage(components(candidates(classes, threshold, bands * rows)), "candidates")

    wanted = found.withColumnRenamed("node", "cls").join(classes.select("cls", "copies", F.col("rep").alias("doc_id"), *key), "cls")
    sets = stage(_gram_sets(own, wanted.select("cls", "doc_id", "key1", "key2"), n), "grams")
    sizes = stage(wanted.groupBy("component").agg(F.count("*").alias("size"), F.sum(8 * F.col("n_grams")).alias("bytes")), "sizes")
    # chunk c of a component is the left side of blocks (c, j) and the right side of blocks (i, c)
    k = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = wanted.join(sizes, "component").withColumn("k", k).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least("chunk", j).alias("bi"), F.greatest("chunk", j).alias("bj"), F.when(j < F.col("chunk"), 1).otherwise(0).alias("side")))
    placed = sets.join(dealt.select("cls", "component", "copies", cells.alias("cells")), "cls").select("component", "copies", "cls", F.explode("cells").alias("c"), "grams")
    checked = stage(verify(placed.select("component", "c.bi", "c.bj", "c.side", "cls", "copies", "grams"), threshold), "links")

    links = checked.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = stage(components(checked.select("cls", "least").where("cls <> least"), "cls", "least").withColumnRenamed("node", "cls").join(classes.select("cls", "rep"), "cls"), "groups")
    least = stage(joined.groupBy("component").agg(F.min("rep").alias("class_id")), "least")
    joined = joined.join(least, "component").select("cls", "class_id")
    per_class = classes.join(links, "cls", "left").join(joined, "cls", "left").select(*key, "copies", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = sig.where("n_grams = 0 OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    per_class = stage(per_class, "per_class")
    return usable.select("doc_id", *key).join(per_class, key).select("doc_id", "class_id", "n_links", F.col("copies").alias("n_copies")).unionByName(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group: that of the least doc_id, and of its texts that of the least hash. Documents without words or id stay.

    Rows are told apart by a 64-bit hash of doc_id and text, so texts that share a doc_id are decided each for itself.
    """
    row = fresh("_row", docs)
    own = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    marked = docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), own))
    found = join(marked.select(F.col(row).alias("doc_id"), "text"), **options).where("doc_id IS NOT NULL").withColumnRenamed("doc_id", row)
    found = stage(found.groupBy(row, "class_id").agg(F.count("*").alias("times"), F.max("n_copies").alias("copies")), "rows")
    ids = marked.where(F.col(row).isNotNull()).select(F.col("doc_id").cast("long").alias("own"), row).distinct()
    first = found.join(ids, row).groupBy("class_id").agg(F.min(F.struct("own", row)).alias("first"))
    later = stage(found.join(stage(first, "first"), "class_id").where(F.col(row) != F.col("first")[row]).select(row), "later")
    kept = marked.join(later, row, "left_anti")
    repeated = found.where("times > 1 AND copies > 1").select(row)  # a document without words has one copy
    if not repeated.isEmpty():
        kept = kept.join(repeated, row, "left_anti").unionByName(kept.join(repeated, row, "left_semi").dropDuplicates([row]))
    return kept.select(docs.columns)
