"""Repeated-substring removal by prefix-free parsing, spread over Spark.

A byte goes if it is covered by a ``length``-byte string that also starts earlier: in a document with a smaller id, or
in the same one further left. Strings never cross documents and are judged on the input.

The method. A rolling hash over ``trigger`` bytes picks triggers: in each window of ``length`` bytes the one with the
least hash, the leftmost of equals. So a window's trigger depends on its bytes alone, and equal windows are cut alike.
The windows that share a trigger make a *phrase* with its context; the parse is the sequence of phrases, the
dictionary the set of distinct ones. No window reaches beyond its phrase, so of the corpus order only two levels count:

1. Parse. Its suffixes are ordered by their first phrase, then by (doc, place): phrases go to the task of their
   trigger's hash and are ordered by (trigger, phrase, doc, place). All but the first occurrence of a phrase are repeats, with
   all of their windows. Most of a repeated passage ends here, at one row for some tens of bytes. Phrases are told apart by
   two independent hashes, 128 bits.
2. Dictionary. Where one trigger has several distinct phrases (at the edges of passages), the suffix array of these phrases
   is built from their bytes, word by word, until a suffix stands alone or ``length`` bytes agree (``suffix_runs``). Suffixes that
   agree are one run, ordered by (doc, place) of their phrases in the parse; all but the first are repeats.

A phrase that came earlier in the same batch of documents is settled there and not sent, so a passage that a third of all
documents hold gives a row for each batch, not for each document. A trigger with over ``HOT`` distinct phrases (a line shorter than a
window, in many surroundings) would fill one task with its array: its suffixes are dealt one by one instead, by two
independent hashes of their ``length`` bytes, and settled batch by batch like phrases.

Nulls: a null text is empty, with nothing removed; null doc_ids come first. Rows of equal doc_id with different texts
are ordered by a hash of the text; rows equal in both are one document, and get the same result. Empty tables give
empty results. ``remove_repeats`` keeps other columns; an input column named like one of its ``counts`` is replaced.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fresh, part_of, stage

LENGTH = 100
TRIGGER = 32
#: Text bytes hashed at once, and settled against each other before anything is sent.
CHUNK = 768 << 10
SETTLE = 8 << 20
#: Distinct phrases of a trigger from which its suffixes are dealt one by one, and phrase bytes that are ordered at once.
HOT, ORDERED = 2048, 1 << 20
COUNTS = ("n_bytes", "n_removed", "n_spans")
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Hasher:
    """Hashes of any range of a buffer, equal for equal bytes wherever they stand. Each ``salt`` is an independent hash."""

    size = 0
    letters = [np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8, person=name).digest() for b in range(256)), "<u8") for name in (b"utterline", b"utterline2")]

    def __init__(self, data: np.ndarray, salt: int = 0):
        if len(data) + 1 > Hasher.size:
            Hasher.size = max(len(data) + 1, CHUNK + 1)
            Hasher.up, Hasher.down = _powers(_BASE, Hasher.size), _powers(_INVERSE, Hasher.size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(Hasher.letters[salt][data] * Hasher.up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray | slice, end: np.ndarray | slice, more: np.ndarray | int = 0) -> np.ndarray:
        h = self.sums[end] - self.sums[start]
        h *= Hasher.down[start]
        h += np.uint64(more) if isinstance(more, int) else more.astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n]) if span < width else x[:n]


def phrases(data: np.ndarray, ends: np.ndarray, length: int, trigger: int):
    """(first window, last window, trigger hash, phrase hash) of all phrases of documents that lie end to end in ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    hasher = Hasher(data)
    n = len(data) - trigger + 1
    h = hasher(slice(0, n), slice(trigger, trigger + n))
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    owner = (_sliding_least(key, length - trigger + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.zeros(len(owner) + 1, np.int32)  # windows that cross an end get no phrase
    last = np.minimum(ends - length + 1, len(owner))
    ok = last > starts
    np.add.at(doc, starts[ok], 1)
    np.add.at(doc, last[ok], -1)
    inside = np.cumsum(doc[:-1]) > 0
    edge = np.ones(len(owner) + 1, bool)
    edge[1:-1] = (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    where = starts[(starts > 0) & (starts < len(owner))]
    edge[where] = True
    cuts = np.flatnonzero(edge)
    lo, hi = cuts[:-1], cuts[1:] - 1
    use = inside[lo]
    lo, hi = lo[use], hi[use]
    at = owner[lo]
    return lo, hi, h[at], Hasher(data, 1)(lo, hi + length, at - lo)


_NULL_ID = -(1 << 63)  # null ids come first
#: kind 0: windows of a document that are repeats; 1: a phrase or suffix to compare with others; 2: a phrase of a hot trigger.
#: A span holds the first and last window as first * length + (last - first).
_ROWS = "kind int, key long, sub long, doc_id long, tie int, span long"
_NAMES = [f.split(" ")[0] for f in _ROWS.split(", ")]


def _rows(kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns)], _NAMES)


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """True where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _settled(batches, cut, length: int):
    """Run ``cut`` over documents and settle what it gives for each SETTLE bytes of text: the first of equal (key, sub) is sent on, the others are repeats."""
    held: list[list[np.ndarray]] = []
    size = 0

    def flush():
        if not held:
            return
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        by = np.lexsort([cols[4], cols[3], cols[2], cols[1], cols[0]])
        cols = [c[by] for c in cols]
        new = _changes(cols[:2])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        rest = ~new & np.logical_or.reduce([c != c[first] for c in cols[2:]])
        if rest.any():
            doc, tie, span = (c[rest] for c in cols[2:])
            spread = (doc.astype(np.uint64) + tie.astype(np.uint64)) * np.uint64(_BASE)
            yield _rows(0, [spread, np.zeros(len(doc), np.int64), doc, tie, span])
        yield _rows(1, [c[new] for c in cols])

    for docs in _chunks(batches, length):
        held.extend(x for x in cut(docs) if len(x[0]))
        size += sum(len(d[2]) for d in docs)
        if size >= SETTLE:
            yield from flush()
            size = 0
    yield from flush()


def _chunks(batches, length: int):
    """Lists of (doc_id, tie, bytes, offset, spans) of about CHUNK bytes; a longer text is cut with overlap, so memory stays bounded."""
    held, size = [], 0
    for batch in batches:
        spans = batch.column("hot") if "hot" in batch.schema.names else None
        for i, (doc_id, tie, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "text")), strict=True)):
            data, own = text.encode(), None if spans is None else spans[i].values.to_numpy()
            if own is not None and not len(own):
                continue
            for at in range(0, max(1, len(data) - length + 1), CHUNK):
                piece = data[at : at + CHUNK + length - 1]
                held.append((doc_id, tie, piece, at, own))
                size += len(piece)
                if size >= CHUNK:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _cut_phrases(length: int, trigger: int):
    def cut(docs):
        data, ends = np.frombuffer(b"".join(d[2] for d in docs), np.uint8), np.cumsum([len(d[2]) for d in docs], dtype=np.int64)
        lo, hi, key, sub = phrases(data, ends, length, trigger)
        which = np.searchsorted(ends, lo, side="right")
        ids, ties = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int32)
        shift = np.array([d[3] for d in docs], np.int64) - np.concatenate([[0], ends[:-1]])
        return [[key, sub, ids[which], ties[which], (lo + shift[which]) * length + hi - lo]]

    return cut


def _cut_suffixes(length: int):
    """The windows that a document's ``spans`` name."""

    def cut(docs):
        out = []
        for doc_id, tie, data, at, spans in docs:
            lo, n = spans // length - at, spans % length + 1
            use = (lo + n > 0) & (lo <= len(data) - length)
            lo, n = lo[use], n[use]
            if not len(lo):
                continue
            p = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            p = np.unique(p[(p >= 0) & (p <= len(data) - length)])
            raw, m = np.frombuffer(data, np.uint8), len(p)
            key, sub = (Hasher(raw, salt)(p, p + length) for salt in (0, 1))
            out.append([key, sub, np.full(m, doc_id, np.int64), np.full(m, tie, np.int32), (p + at) * length])
        return out

    return cut


def _resolve(batches, most: int = HOT):
    """Of rows ordered by (key, sub, doc_id, tie, span): the repeats (kind 0) and, of keys with several subs, the firsts (kind 1; 2 of a key with over ``most``).

    Holds one batch, and up to ``most`` firsts of the batch's last key.
    """
    before = None  # key, sub and (doc_id, tie, span) of the last run's first row
    held: list[list[np.ndarray]] = []  # firsts of the last key, while it isn't known whether it is hot
    hot = False

    def given(firsts: list[np.ndarray]):
        """Firsts of whole keys."""
        key = firsts[0]
        new = np.flatnonzero(_changes([key]))
        size = np.diff(np.append(new, len(key)))
        each = np.repeat(size, size)
        for kind, which in ((1, (each > 1) & (each <= most)), (2, each > most)):
            if which.any():
                yield _rows(kind, [c[which] for c in firsts])

    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if (ready := batch.filter(pa.array(kind == 0))).num_rows:
            yield ready
        if not (kind == 1).any():
            continue
        cols = [c.to_numpy() for c in batch.filter(pa.array(kind == 1)).columns[1:]]
        key, sub = cols[:2]
        new = _changes([key, sub])
        if before is not None:
            new[0] = key[0] != before[0] or sub[0] != before[1]
        run = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        lead = [np.where(run < 0, before[2][j] if before is not None else 0, c[np.maximum(run, 0)]) for j, c in enumerate(cols[2:])]
        rest = ~new & np.logical_or.reduce([c != x for c, x in zip(cols[2:], lead, strict=True)])
        if rest.any():
            yield _rows(0, [c[rest] for c in cols])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        firsts = [c[first] for c in cols]
        if hot:  # the key goes on
            more = firsts[0] == before[0]
            if more.any():
                yield _rows(2, [c[more] for c in firsts])
                firsts = [c[~more] for c in firsts]
        elif held:
            firsts = [np.concatenate(c) for c in zip(*held, firsts, strict=True)]
        held, hot = [], hot and not len(firsts[0])
        before = (key[first[-1]], sub[first[-1]], [c[first[-1]] for c in cols[2:]])
        if len(firsts[0]):
            last = firsts[0] == firsts[0][-1]
            yield from given([c[~last] for c in firsts]) if not last.all() else ()
            tail = [c[last] for c in firsts]
            if last.sum() > most:
                hot = True
                yield _rows(2, tail)
            else:
                held = [tail]
    if held:
        yield from given([np.concatenate(c) for c in zip(*held, strict=True)])


def _level(rows: DataFrame, most: int) -> DataFrame:
    return arrow_map(rows.repartition(part_of(rows), "key").sortWithinPartitions("key", "sub", "doc_id", "tie", "span"), lambda b: _resolve(b, most), _ROWS)


_PHRASES = "key long, doc_id long, tie int, first long, bytes binary"


def _phrase_bytes(length: int):
    """Documents with the phrases (key, span) of ``several`` to rows of these phrases' bytes."""
    names, types = [f.split(" ")[0] for f in _PHRASES.split(", ")], (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())

    def give(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches):
        for batch in batches:
            out: list = []
            size = 0
            for doc_id, tie, text, phrases in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "text", "several")), strict=True):
                data = text.encode()
                for p in phrases:
                    lo, n = divmod(p["span"], length)
                    out.append((p["key"], doc_id, tie, lo, data[lo : lo + n + length]))
                    size += n + length
                if size > ORDERED:
                    yield give(out)
                    out, size = [], 0
            if out:
                yield give(out)

    return run


def suffix_runs(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``starts`` (in groups, numbered from 0) that agree in their first ``length`` bytes with another of their group.

    The groups' suffix arrays, refined eight bytes at a time: suffixes of a run are ordered by their next word, and one that stands
    alone has its place and is left out. Returns the suffixes still in runs, in array order and within a run as given, and their runs' numbers.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
    rest, run = np.arange(len(starts)), group.astype(np.int64)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        word = words[starts[rest] + at]
        by = np.lexsort([word, run])
        rest, run, word = rest[by], run[by], word[by]
        new = np.ones(len(rest) + 1, bool)
        new[1:-1] = (run[1:] != run[:-1]) | (word[1:] != word[:-1])
        keep = ~(new[:-1] & new[1:])
        run = (np.cumsum(new[:-1]) - 1)[keep]
        rest = rest[keep]
        if not len(rest):
            break
    return rest, run


def _dictionary(length: int):
    """Phrases ordered by (key, doc_id, tie, first) to the windows that are repeats. Holds some whole triggers, ORDERED bytes or one."""

    def solve(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        key, doc, tie, first = (t.column(c).to_numpy() for c in ("key", "doc_id", "tie", "first"))
        blobs = t.column("bytes").to_pylist()
        size = np.fromiter(map(len, blobs), np.int64, len(blobs))
        data, at = np.frombuffer(b"".join(blobs), np.uint8), np.cumsum(size) - size
        n = size - length + 1
        which = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rest, run = suffix_runs(data, at[which] + place, (np.cumsum(_changes([key])) - 1)[which], length)
        later = rest[~_changes([run])] if len(rest) else rest
        who = which[later]
        return pa.RecordBatch.from_arrays([pa.array(doc[who]), pa.array(tie[who]), pa.array((first[who] + place[later]) * length)], ["doc_id", "tie", "span"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), batch.num_rows]
            lengths = np.cumsum(np.append(0, pa.compute.binary_length(batch.column("bytes")).to_numpy()))
            begin = 0
            for cut in cuts[:-1]:
                if size + lengths[cut] - lengths[begin] >= ORDERED and (cut or last != key[0]):
                    if cut > begin:
                        held.append(batch.slice(begin, cut - begin))
                    yield solve(held)
                    held, size, begin = [], 0, cut
            held.append(batch.slice(begin))
            size += lengths[-1] - lengths[begin]
            last = key[-1]
        if held:
            yield solve(held)

    return run


def _spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "tie").agg(F.collect_list("span").alias("spans"))


def _tie(text: Column) -> Column:
    """Tells texts of one doc_id apart."""
    return F.shiftright(F.xxhash64(text), 32).cast("int")


def _own(docs: DataFrame) -> DataFrame:
    """doc_id (null: the least number), tie and text (null: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), _tie(text).alias("tie"), text.alias("text"))


def repeats(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, most: int = HOT) -> DataFrame:
    """doc_id, tie and spans: for each document with repeats, the windows that start one (see ``_ROWS``)."""
    if not 0 < trigger < length or length < 8:
        raise ValueError("a trigger must be shorter than a repeat, and that has 8 bytes at least")
    own, parse, suffixes = _own(docs), _cut_phrases(length, trigger), _cut_suffixes(length)
    first = stage(_level(arrow_map(own, lambda b: _settled(b, parse, length), _ROWS), most), "phrases", "zstd")
    several = first.where("kind > 0").groupBy("doc_id", "tie").agg(
        F.collect_list(F.when(F.col("kind") == 1, F.struct("key", "span"))).alias("several"), F.collect_list(F.when(F.col("kind") == 2, F.col("span"))).alias("hot"))
    asked = own.join(several, ["doc_id", "tie"])
    rows = arrow_map(asked.select("doc_id", "tie", "text", "several"), _phrase_bytes(length), _PHRASES)
    ordered = rows.repartition(part_of(docs), "key").sortWithinPartitions("key", "doc_id", "tie", "first")
    found = [first.where("kind = 0"), stage(arrow_map(ordered, _dictionary(length), "doc_id long, tie int, span long"), "suffixes", "zstd")]
    if first.where("kind = 2").count():
        dealt = arrow_map(asked.where(F.size("hot") > 0).select("doc_id", "tie", "text", "hot"), lambda b: _settled(b, suffixes, length), _ROWS)
        found.append(stage(_level(dealt, most).where("kind = 0"), "hot", "zstd"))
    return _spans(reduce(DataFrame.unionByName, [f.select("doc_id", "tie", "span") for f in found]))


def covered(spans: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the spans' windows cover."""
    lo = np.sort(spans) // length
    by = np.argsort(spans, kind="stable")
    end = np.maximum.accumulate(lo + (spans[by] % length) + length)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > end[:-1]
    at = np.flatnonzero(new)
    return lo[at], end[np.append(at[1:], len(lo)) - 1]


def _cut_out(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, counts: tuple[str, str, str] = COUNTS) -> DataFrame:
    """The rows with what is left of ``text`` (bytes of a character cut in two go too), and ``counts``: bytes, bytes removed and runs removed."""
    docs = docs.drop(*counts).withColumn("text", F.col("text").cast("string"))
    own_id, own_tie, own_spans = (fresh(n, docs) for n in ("_id", "_tie", "_spans"))
    tagged = docs.withColumn(own_id, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))).withColumn(own_tie, _tie(F.coalesce("text", F.lit(""))))
    found = repeats(docs, length, trigger).withColumnsRenamed({"doc_id": own_id, "tie": own_tie, "spans": own_spans})
    joined = tagged.join(found, [own_id, own_tie], "left").select(*docs.columns, own_spans)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in counts)])

    def run(batches):
        for batch in batches:
            spans, i = batch.columns[-1], batch.schema.get_field_index("text")
            texts, sizes, gone, runs = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                data = (text or "").encode()
                sizes.append(len(data))
                if spans[k].is_valid:
                    a, b = covered(spans[k].values.to_numpy(), length)
                    text = _cut_out(data, a, b).decode("utf-8", "ignore")
                    gone.append(int((b - a).sum()))
                    runs.append(len(a))
                else:
                    gone.append(0)
                    runs.append(0)
                texts.append(text)
            cols = [pa.array(texts, pa.string()) if j == i else c for j, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, pa.int64()) for c in (sizes, gone, runs))], schema.names)

    return arrow_map(joined, run, schema)


def digests(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, most: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, of the remaining bytes exactly."""
    joined = _own(docs).join(repeats(docs, length, trigger, most), ["doc_id", "tie"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            spans, out = batch.column("spans"), []
            for k, text in enumerate(batch.column("text").to_pylist()):
                data = text.encode()
                a, b = covered(spans[k].values.to_numpy(), length) if spans[k].is_valid else (np.zeros(0, np.int64),) * 2
                out.append((len(data), int((b - a).sum()), len(a), hashlib.sha256(_cut_out(data, a, b)).hexdigest()))
            n, gone, runs, sha = zip(*out, strict=True) if out else ((),) * 4
            ids = batch.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == _NULL_ID), *(pa.array(c, pa.int64()) for c in (n, gone, runs)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return arrow_map(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
