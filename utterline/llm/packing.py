"""Packing by concatenating and cutting.

Two passes. The first encodes the documents where they lie, numbers each document's place in its task's stream and
writes both. The sums of those streams, one number for each task, give every stream its global offset; the second
pass adds it and cuts at fixed windows. A document that crosses a window's edge gives a boundary record on each side,
so nothing is padded but the last window and nothing moves between tasks.

Nulls: a null text is an empty document (its end id alone). Repeated rows are separate documents. An empty table
gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces, ship, stage, task_id, texts_of
from .encode import default_word_tokenizer, encoder

WINDOW = 2048


def encoded(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """doc_id, part, local_start, n_tokens and ids (uint16 bytes where the vocabulary allows it), written to the shared folder."""
    tokenizer = tokenizer or default_word_tokenizer()

    def run(batches):
        part, at, enc = task_id(), 0, encoder(tokenizer)
        kind = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        for batch in batches:
            for piece in pieces(batch):
                ids = [np.append(np.frombuffer(x, "<u4"), np.uint32(end_id)) for x in enc.encode_many(texts_of(piece.column("text")))]
                n = np.array([len(x) for x in ids], np.int64)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([part] * len(n), pa.int32()), pa.array(start), pa.array(n), pa.array([2 if kind == "<u2" else 4] * len(n), pa.int32()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())],
                    ["doc_id", "part", "local_start", "n_tokens", "id_bytes", "ids"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(arrow_map(own, run, "doc_id long, part int, local_start long, n_tokens long, id_bytes int, ids binary"), "encoded", "zstd")


def offsets_of(streams: DataFrame) -> dict[int, int]:
    """Tokens before each stream: one number for each task of the first pass."""
    at, out = 0, {}
    for r in sorted(streams.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["part"]):
        out[r["part"]], at = at, at + r["n"]
    return out


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (uint32 bytes) of every piece."""
    streams = encoded(docs, tokenizer, end_id)
    offsets = offsets_of(streams)

    def cut(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, part, local, n, width, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "local_start", "n_tokens", "id_bytes", "ids")), strict=True):
                at, raw = offsets[part] + local, np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                done = 0
                while done < n:
                    offset = (at + done) % window
                    take = min(n - done, window - offset)
                    for c, v in zip(cols, (doc_id, done, take, n, (at + done) // window, offset, raw[4 * done : 4 * (done + take)]), strict=True):
                        c.append(v)
                    done += take
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return arrow_map(streams, cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (4 bytes each), n_tokens: the pieces of each window put together, padded to ``window`` unless they number a power of two.

    A window has at most ``window`` pieces, so its group is bounded.
    """

    def build(key, table):
        rows = sorted(zip(table.column("offset").to_pylist(), table.column("ids").to_pylist(), strict=True))
        ids = b"".join(x for _, x in rows)
        n = len(ids) // 4
        pad = window - n if n & (n - 1) else 0
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "ids": pa.array([ids + np.full(pad, pad_id, "<u4").tobytes()], pa.binary())})

    ship(packed.sparkSession)
    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(build, "sequence_id long, n_tokens long, ids binary")


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in the place of the ids."""

    def run(batches):
        for batch in batches:
            crc = pa.array([zlib.crc32(x) for x in batch.column("ids").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length")), crc, *(batch.column(c) for c in ("doc_tokens", "sequence_id", "offset"))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return arrow_map(packed.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
