"""Token-id files: patched frame-of-reference blocks with an index of block starts.

A store is a folder of Parquet files whose rows are *segments*. A segment holds the ids of whole documents, in
order, as one binary value:

    "PFR1" | n ids | block size | n blocks                       4 x uint32 (the mark counts as one)
    index: per block  minimum uint32, start uint32, width uint8, exceptions uint16
    data:  per block  8 * width uint64 words of packed values, exception places (uint16), exception values (uint32)

Each block's minimum is subtracted, the rest is packed at the width that holds a chosen percentile of it, and
what doesn't fit stands in the block's exception list with its full value. Starts are bytes from the data's
beginning, so any block decodes alone.

Nulls: a null text is an empty one; null doc_ids sort first. Repeated rows are separate documents. An empty table
gives an empty store. Columns beyond ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, part_of, pieces, staged_path, task_id, texts_of, write_out
from .encode import default_word_tokenizer, encoder

BLOCK = 512
_LANES = 64
_INDEX = np.dtype([("least", "<u4"), ("start", "<u4"), ("width", "u1"), ("odd", "<u2")])
SEGMENT_IDS = 1 << 18
STORE_SCHEMA = "part int, segment int, local_start long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def _pack(x: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values under 2**width to (blocks, BLOCK // 64 * width) words."""
    if not width:
        return np.zeros((len(x), 0), np.uint64)
    lanes = np.ascontiguousarray(x.astype(np.uint64).reshape(-1, _LANES).T)
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for j in range(_LANES):
        word, bit = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(bit)
        if bit + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - bit)
    return np.ascontiguousarray(out.T).reshape(len(x), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``_pack``."""
    if not width:
        return np.zeros((len(words), BLOCK), np.uint64)
    w = np.ascontiguousarray(words.reshape(-1, width).T)
    mask, out = np.uint64((1 << width) - 1), np.empty((_LANES, w.shape[1]), np.uint64)
    for j in range(_LANES):
        word, bit = divmod(j * width, 64)
        value = w[word] >> np.uint64(bit)
        if bit + width > 64:
            value = value | (w[word + 1] << np.uint64(64 - bit))
        out[j] = value & mask
    return np.ascontiguousarray(out.T).reshape(-1, BLOCK)


def pack_segment(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """Encode ids (uint32) as one segment."""
    n, nb = len(ids), -(-len(ids) // BLOCK)
    full = np.empty(nb * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[-1] if n else 0
    full = full.reshape(nb, BLOCK)
    least = full.min(axis=1) if nb else np.zeros(0, np.uint32)
    rest = full - least[:, None]
    at = min(BLOCK - 1, int(BLOCK * percentile))
    typical = np.partition(rest, at, axis=1)[:, at] if nb else least
    width = np.zeros(nb, np.uint8)
    for b in range(32):
        width += (typical >> np.uint32(b)) > 0
    over = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    odd = over.sum(axis=1)
    index = np.zeros(nb, _INDEX)
    index["least"], index["width"], index["odd"] = least, width, odd
    sizes = width.astype(np.int64) * (BLOCK // 8) + 6 * odd
    index["start"] = np.cumsum(sizes) - sizes
    packed: list[bytes] = [b""] * nb
    low = np.where(over, rest & ((np.uint64(1) << width[:, None].astype(np.uint64)) - np.uint64(1)).astype(np.uint32), rest)
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        for k, row in zip(which, _pack(low[which], int(w)), strict=True):
            packed[k] = row.tobytes()
    for k in np.flatnonzero(odd):
        places = np.flatnonzero(over[k])
        packed[k] += places.astype("<u2").tobytes() + full[k, places].astype("<u4").tobytes()
    return b"PFR1" + np.array([n, BLOCK, nb], "<u4").tobytes() + index.tobytes() + b"".join(packed)


def unpack_segment(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from ``first`` up to ``last``, touching only the blocks that hold them."""
    if payload[:4] != b"PFR1":
        raise ValueError("not a segment")
    n, block, nb = np.frombuffer(payload, "<u4", 3, 4).tolist()
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    index = np.frombuffer(payload, _INDEX, nb, 16)
    data = 16 + nb * _INDEX.itemsize
    lo, hi = first // block, -(-last // block)
    out = np.empty((hi - lo, block), np.uint32)
    own = index[lo:hi]
    for w in np.unique(own["width"]):
        which = np.flatnonzero(own["width"] == w)
        count = block // 64 * int(w)
        words = np.stack([np.frombuffer(payload, "<u8", count, data + int(own["start"][k])) for k in which])
        out[which] = _unpack(words, int(w)).astype(np.uint32) + own["least"][which][:, None]
    for k in np.flatnonzero(own["odd"]):
        at, m = data + int(own["start"][k]) + block // 8 * int(own["width"][k]), int(own["odd"][k])
        out[k, np.frombuffer(payload, "<u2", m, at)] = np.frombuffer(payload, "<u4", m, at + 2 * m)
    return out.reshape(-1)[first - lo * block : last - lo * block]


def write_store(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 1, partitions: int | None = None) -> str:
    """Encode all documents in ascending doc_id order, append ``end_id`` to each, write a store; returns its path.

    One shuffle, of the texts, by ranges of (doc_id, hash of the text): rows that share an id can fall into several
    ranges, so no id is hot.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_word_tokenizer()
    path = path or staged_path(spark, "tokens")
    tail = np.array([end_id], "<u4").tobytes()

    def write(batches):
        part, segment, start = task_id(), 0, 0
        ids, doc_ids, lengths, held = [], [], [], 0
        names = [f.split(" ")[0] for f in STORE_SCHEMA.split(", ")]

        def row():
            joined = np.frombuffer(b"".join(ids), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([pack_segment(joined)], pa.binary())], names)

        enc = encoder(tokenizer)
        for batch in batches:
            for piece in pieces(batch):
                for doc_id, own in zip(piece.column("doc_id").to_pylist(), enc.encode_many(texts_of(piece.column("text"))), strict=True):
                    ids.append(own + tail)
                    doc_ids.append(doc_id)
                    lengths.append(len(own) // 4 + 1)
                    held += lengths[-1]
                    if held >= SEGMENT_IDS:
                        yield row()
                        start, segment = start + held, segment + 1
                        ids, doc_ids, lengths, held = [], [], [], 0
        if held:
            yield row()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.xxhash64("text")
    n = partitions or part_of(docs)
    ordered = own.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), key).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), key, "text")
    write_out(arrow_map(ordered, write, STORE_SCHEMA), path)
    return path


def part_offsets(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each part: one number for each writing task."""
    at, out = 0, {}
    totals = spark.read.schema(STORE_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    for r in sorted(totals, key=lambda r: r["part"]):
        out[r["part"]], at = at, at + r["n"]
    return out


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (uint32 bytes) of each document in a store."""
    offsets = part_offsets(spark, path)

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_segment(r["payload"]).astype("<u4").tobytes()
                ends = np.cumsum(r["lengths"])
                starts = ends - np.array(r["lengths"])
                base = offsets[r["part"]] + r["local_start"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + base, pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array([ids[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    return arrow_map(spark.read.schema(STORE_SCHEMA).parquet(path), read, "doc_id long, start long, n_tokens long, ids binary")


def read_ids(spark: SparkSession, path: str, start: int, length: int) -> np.ndarray:
    """Random access: ids ``start`` to ``start + length`` of the whole store; only the segments that hold them are read."""
    offsets = part_offsets(spark, path)
    end, found = start + length, []
    parts = sorted(offsets)
    for p, q in zip(parts, [*parts[1:], None], strict=True):
        if offsets[p] >= end or q is not None and offsets[q] <= start:
            continue
        local = F.col("local_start") + offsets[p]
        rows = spark.read.schema(STORE_SCHEMA).parquet(path).where((F.col("part") == p) & (local < end) & (local + F.col("n_ids") > start))
        found += [(offsets[p] + r["local_start"], unpack_segment(bytes(r["payload"]), max(0, start - offsets[p] - r["local_start"]), end - offsets[p] - r["local_start"])) for r in rows.select("local_start", "payload").collect()]
    return np.concatenate([x for _, x in sorted(found, key=lambda f: f[0])] or [np.zeros(0, np.uint32)])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""
    offsets = part_offsets(spark, path)

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = memoryview(unpack_segment(r["payload"]).astype("<u4").tobytes())
                ends = np.cumsum(r["lengths"])
                starts = ends - np.array(r["lengths"])
                base = offsets[r["part"]] + r["local_start"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + base, pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(spark.read.schema(STORE_SCHEMA).parquet(path), read, "doc_id long, start long, n_tokens long, ids_crc32 long")
