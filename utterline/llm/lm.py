"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, then one end; words are known by 64-bit hash, which
comes from the text's bytes in whole batches (``tokens``).

What is gathered from the training texts, all of it and without a vocabulary:

* exact counts of all words, by a shuffle of counts that each task has summed. They stay a distributed table; N, V and
  the base score come from it. Words that are frequent enough (``HEAD`` of them at most) are broadcast, rarer ones meet their
  counts in a join;
* the quantised logarithms of the counts of all words, pairs and triples of neighbouring words (a text's start stands before its
  first word) in a Bloom filter: a key with level q is entered with (key, 1) .. (key, q), and a probe counts up until one
  is missing. The filter is cut into segments by the key's hash; each is sized by its own entries. Tasks send the keys of a segment as one
  packed value, the segment's task sums them and sets the bits: one shuffle for counting and building.

A filter of up to ``BROADCAST`` bytes is a file that every executor gets once (``SparkContext.addFile``) and its workers map.
A larger one stays a table: texts' distinct keys are sent to the segments, and the levels come back, so memory is bounded at any size.
Both ways make the same probes and give the same scores.

The model, smoothed towards the next shorter n-gram with a weight that falls with what was seen of its context:

    P1(w)       = (c(w) + 1) / (N + V + 1)
    P2(w | v)   = (c(v, w) + PAIR * P1(w)) / (c(v) + PAIR)
    P3(w | u v) = (c(u, v, w) + TRIPLE * P2(w | v)) / (c(u, v) + TRIPLE)

Counts are read back from the filter; a text's first word has P2 after the start. Filter errors only raise a count, by one level with a
probability of about 2 ** -HASHES; no n-gram counts more than the shorter ones in it, so most errors are cut off.

Nulls: a null or empty text has the end alone. Null doc_ids count as the text "". Repeated rows are scored each, and
trained on each. Ties don't matter: nothing is ranked. An empty table, or one without training rows, gives N = 0 and V = 0. Other
columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, doc_hash_column, mark, part_of, pieces, release, stage, task_id

HEAD, STEPS, HASHES = 1 << 17, 1, 5
#: Weights of the shorter n-gram, picked on held-out sample texts.
PAIR, TRIPLE = 400.0, 4.0
#: Bytes of text whose keys make one segment, of a filter that is broadcast, and of segments probed at once.
SEGMENT_TEXT, BROADCAST, SHARD = 4 << 20, 512 << 20, 16 << 20
#: Keys that a task counts before it sends them, tokens scored and bytes hashed at once.
AT_ONCE, TURN, CHUNK = 3 << 20, 1 << 18, 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_END, _START = np.uint64(1), np.uint64(0)  # a word's hash is neither
#: A segment has some two million keys at any size of the corpus, so two of them agree in 40 bits with a probability of 2e-6.
_LOW40 = np.uint64((1 << 40) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _MIX
        h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """Each byte's value (A-Z those of a-z), whether it is white space, and powers of the base and of its inverse."""
    if not _TABLES:
        value = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
        value[65:91] = value[97:123]
        white = np.zeros(256, bool)
        white[[9, 10, 11, 12, 13, 32]] = True
        _TABLES.update(value=value, white=white, up=_powers(_BASE, CHUNK + 1), down=_powers(pow(_BASE, -1, 1 << 64), CHUNK + 1))
    return _TABLES


def _finished(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = _mixed(h + length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.where(h > 1, h, h + np.uint64(2))


def _long_word(data: np.ndarray) -> np.uint64:
    """The unfinished hash of a word longer than CHUNK, piece by piece."""
    t, total = _tables(), 0
    for k, at in enumerate(range(0, len(data), CHUNK)):
        part = t["value"][data[at : at + CHUNK]] * t["up"][: len(data[at : at + CHUNK])]
        total += int(part.sum(dtype=np.uint64)) * pow(_BASE, k * CHUNK, 1 << 64)
    return np.uint64(total & ((1 << 64) - 1))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of texts that lie end to end in ``data`` (UTF-8) and end at ``ends``."""
    t = _tables()
    starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + CHUNK)
        white = t["white"][data[a:b]]
        if b < n:  # cut behind the last white space or end of a text
            blank = np.flatnonzero(white)
            inside = ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b, "right")]
            cut = max(a + int(blank[-1]) + 1 if len(blank) else a, int(inside[-1]) if len(inside) else a)
            if cut == a:  # one word fills the chunk
                stop = int(ends[np.searchsorted(ends, a, "right")])
                cut = b
                while cut < stop and not (blank := np.flatnonzero(t["white"][data[cut : cut + CHUNK]])).size:
                    cut = min(stop, cut + CHUNK)
                cut = min(stop, cut + int(blank[0])) if blank.size else stop
                starts.append(np.array([a]))
                found.append(_finished(np.array([_long_word(data[a:cut])], np.uint64), np.array([cut - a])))
                a = cut
                continue
            b = cut
            white = white[: b - a]
        word = ~white
        before, after = np.zeros(b - a, bool), np.zeros(b - a, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        edge = ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b, "left")] - a
        before[edge], after[edge - 1] = False, False
        first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        sums = np.zeros(b - a + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(t["value"][data[a:b]] * t["up"][: b - a], out=sums[1:])
            own = (sums[last] - sums[first]) * t["down"][first]
        starts.append(first + a)
        found.append(_finished(own, last - first))
        a = b
    return np.concatenate(starts), np.concatenate(found)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and ends of a column of texts (null: empty), and how many each text has."""
    texts = pa.compute.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0]
    at, h = word_hashes(data, ends)
    upto = np.searchsorted(at, ends)
    size = np.diff(upto, prepend=0) + 1
    out = np.insert(h, upto, _END)
    return out, size


def before_of(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's word before (the start for a text's first), and whether it is a text's first."""
    first = np.zeros(len(h), bool)
    first[np.cumsum(size) - size] = True
    before = np.concatenate([[_START], h[:-1]])
    before[first] = _START
    return before, first


def pair_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(before * np.uint64(0x9E3779B97F4A7C15) + h + np.uint64(0x632BE59BD9B4E019))


def triple_keys(pair: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Keys of a pair and the word behind it."""
    with np.errstate(over="ignore"):
        return _mixed(pair * np.uint64(0xC2B2AE3D27D4EB4F) + h + np.uint64(0x165667B19E3779F9))


def levels(counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Quantised logarithms, from 1: 1 + floor(steps * log2(count))."""
    return 1 + np.floor(steps * np.log2(np.maximum(counts, 1)) + 1e-9).astype(np.int64)


def level_counts(level: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    return np.where(level > 0, np.exp2((level - 0.5) / steps), 0.0) * (level != 1) + (level == 1) * 1.0


def filter_ids(keys: np.ndarray) -> np.ndarray:
    """What the filter knows a key by: its upper half picks the segment, its lower 40 bits the places."""
    return _mixed(keys)


def segment_of(ids: np.ndarray, segments: int) -> np.ndarray:
    return ((ids >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def places(ids: np.ndarray, level: int, blocks: np.ndarray | int, hashes: int = HASHES):
    """The bit numbers of (id, level) within a segment of ``blocks`` times 512 bits, one array for each hash.

    Four levels in turn lie in one block, which is one line of the processor's cache.
    """
    group = (level - 1) // 4
    with np.errstate(over="ignore"):
        h = _mixed((ids & _LOW40) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(group * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))
        block = ((h >> np.uint64(32)) * np.asarray(blocks).astype(np.uint64) >> np.uint64(32)) << np.uint64(9)
        for k in range(hashes):
            if k % 7 == 0:
                h = _mixed(h + np.uint64(level * 0x165667B19E3779F9 & (1 << 64) - 1))
            yield block + ((h >> np.uint64(9 * (k % 7))) & np.uint64(511))


def segment_bits(ids: np.ndarray, counts: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The bytes of a segment with these ids and counts: 1.5 bits for each hash of each entry, in blocks of 64 bytes."""
    level = levels(counts)
    blocks = max(1, -(-int(level.sum()) * hashes * 3 // 1024))
    out = np.zeros(512 * blocks, bool)
    for x in range(1, int(level.max(initial=0)) + 1):
        ids, level = ids[level >= x], level[level >= x]
        for p in places(ids, x, blocks, hashes):
            out[p] = True
    return np.packbits(out, bitorder="little")


def probe(ids: np.ndarray, cells: np.ndarray, first: np.ndarray, blocks: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Levels of ids whose segments begin at byte ``first`` of ``cells``: probes of 1, 2, ... until one is missing."""
    out, left, q = np.zeros(len(ids), np.int64), np.flatnonzero(blocks), 1
    while len(left) and q <= 64 * STEPS:
        at, there = first[left], np.ones(len(left), bool)
        for p in places(ids[left], q, blocks[left], hashes):
            there &= (cells[at + (p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
        left = left[there]
        out[left] = q
        q += 1
    return out


@dataclass
class Filter:
    """``ends``: the byte each segment ends at. ``name``: the file that all executors have, or ``table``: where the segments lie."""

    ends: np.ndarray
    hashes: int
    name: str | None = None
    table: DataFrame | None = None

    def __getstate__(self):
        return {"ends": self.ends, "hashes": self.hashes, "name": self.name, "table": None}

    @property
    def segments(self) -> int:
        return len(self.ends)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Levels of keys, from the file."""
        if not self.ends[-1]:
            return np.zeros(len(keys), np.int64)
        if "_cells" not in self.__dict__:
            self._cells = np.memmap(SparkFiles.get(self.name), np.uint8, "r")
        ids = filter_ids(keys)
        own = segment_of(ids, self.segments)
        first = np.concatenate([[0], self.ends[:-1]])[own]
        return probe(ids, self._cells, first, (self.ends[own] - first) // 64, self.hashes)


def _packed(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _keys(h: np.ndarray, size: np.ndarray):
    """Keys of all words, starts, pairs and triples of texts, in turns of bounded size."""
    before, first = before_of(h, size)
    yield np.full(len(size), _START)
    for a in range(0, len(h), TURN):
        lo, b = max(0, a - 1), a + TURN
        pair = pair_keys(before[lo:b], h[lo:b])
        yield h[a:b]
        yield pair[a - lo :]
        inner = np.flatnonzero(~first[max(a, 1) : b]) + max(a, 1) - lo
        yield triple_keys(pair[inner - 1], h[lo:b][inner])


def build_filter(rows: DataFrame, hashes: int = HASHES, broadcast: int = BROADCAST, most_keys: int = AT_ONCE) -> Filter:
    """The filter of all n-grams of the texts. A task holds one segment's keys."""
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    segments = max(1, -(-total // SEGMENT_TEXT))

    def send(batches):
        held, size = [], 0

        def give():
            ids, n = np.unique(np.concatenate(held), return_counts=True)  # ordered, so by segment
            cuts = np.searchsorted(segment_of(ids, segments), np.arange(segments + 1))
            own = [(i, ids[a:b], n[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            held.clear()
            for at in range(0, len(own), 64):
                part = own[at : at + 64]
                columns = [pa.array([i for i, *_ in part], pa.int32()), pa.array([_packed(x[c == 1]) for _, x, c in part], pa.binary()), pa.array([_packed(x[c > 1]) for _, x, c in part], pa.binary()), pa.array([c[c > 1].astype("<u4").tobytes() for *_, c in part], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "once", "more", "counts"])

        for batch in batches:
            for piece in pieces(batch, most_bytes=2 << 20):
                for keys in _keys(*tokens(piece.column("text"))):
                    held.append(filter_ids(keys))
                    size += len(keys)
                    if size >= most_keys:
                        yield from give()
                        size = 0
        if held:
            yield from give()

    def build(batches):
        at, held = None, []

        def give():
            parts = [(_unpacked(once), np.ones(len(once) // 5, np.int64)) for once, _, _ in held] + [(_unpacked(more), np.frombuffer(n, "<u4").astype(np.int64)) for _, more, n in held]
            ids, n = (np.concatenate(c) for c in zip(*parts, strict=True))
            held.clear()
            by = np.argsort(ids)
            ids, n = ids[by], n[by]
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([segment_bits(ids[first], np.add.reduceat(n, first), hashes).tobytes()], pa.binary())], ["segment", "bits"])

        for batch in batches:
            for segment, *own in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "more", "counts")), strict=True):
                if segment != at and held:
                    yield give()
                at = segment
                held.append(own)
        if held:
            yield give()

    sent = arrow_map(rows.select("text"), send, "segment int, once binary, more binary, counts binary")
    dealt = sent.repartition(max(part_of(rows), -(-segments // 64)), "segment").sortWithinPartitions("segment")
    since = mark()
    table = stage(arrow_map(dealt, build, "segment int, bits binary"), "filter", "uncompressed")
    ends = np.zeros(segments, np.int64)
    for r in table.select("segment", F.octet_length("bits").alias("n")).toLocalIterator():
        ends[r["segment"]] = r["n"]
    ends = np.cumsum(ends)
    if ends[-1] > broadcast:
        return Filter(ends, hashes, table=table)
    # written where the driver's own copy of an added file would go, so there is one
    path = Path(SparkFiles.getRootDirectory()) / f"filter-{uuid.uuid4().hex}"
    with path.open("wb") as f:
        f.truncate(int(ends[-1]))
        for r in table.toLocalIterator():
            f.seek(int(ends[r["segment"]]) - len(r["bits"]))
            f.write(r["bits"])
    spark.sparkContext.addFile(str(path))
    release(since)
    return Filter(ends, hashes, name=path.name)


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))


def held_out(column: str = "doc_id"):
    return doc_hash_column(column) % 7 == 2


def _counted(rows: DataFrame, most_keys: int = AT_ONCE) -> DataFrame:
    """(key, n) of all words: summed per batch of text, then by a shuffle."""

    def run(batches):
        held, size = [], 0

        def give():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

        for batch in batches:
            for piece in pieces(batch, most_bytes=2 << 20):
                held.append(tokens(piece.column("text"))[0])
                size += len(held[-1])
                if size >= most_keys:
                    yield give()
                    size = 0
        if held:
            yield give()

    return stage(arrow_map(rows.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words", "zstd")


class Ngrams:
    """The distinct words, pairs and triples of a run of tokens, and which of them each token is.

    ``first`` tells which tokens begin a text. A run's first token has no triple; ``turns`` puts the token before it there.
    """

    def __init__(self, h: np.ndarray, before: np.ndarray, first: np.ndarray):
        self.words, at = np.unique(np.concatenate([h, before[:1], [_START]]), return_inverse=True)
        own = np.concatenate([at[-2:-1], at[: len(h) - 1]])
        own[first] = at[-1]
        at = at[:-2]
        n = len(self.words)
        pairs, self.pair_at = np.unique(own * n + at, return_inverse=True)
        self.pair_before, self.pair_word = pairs // n, pairs % n
        self.inner = np.flatnonzero(~first[1:]) + 1
        triples, self.triple_at = np.unique(self.pair_at[self.inner - 1] * len(pairs) + self.pair_at[self.inner], return_inverse=True)
        self.triple_before, self.triple_pair = triples // len(pairs), triples % len(pairs)

    def pair_keys(self) -> np.ndarray:
        return pair_keys(self.words[self.pair_before], self.words[self.pair_word])

    def triple_keys(self, pair: np.ndarray) -> np.ndarray:
        return triple_keys(pair[self.triple_before], self.words[self.pair_word[self.triple_pair]])

    def scores(self, one: np.ndarray, two: np.ndarray, three: np.ndarray, n: int, v: int) -> np.ndarray:
        """log10 P of each token, from the levels of words, pairs and triples."""
        one, two, three = level_counts(one), level_counts(two), level_counts(three)
        two = np.minimum(two, np.minimum(one[self.pair_before], one[self.pair_word]))
        three = np.minimum(three, np.minimum(two[self.triple_before], two[self.triple_pair]))
        p1 = (one + 1) / (n + v + 1)
        p2 = (two + PAIR * p1[self.pair_word]) / (one[self.pair_before] + PAIR)
        p3 = (three + TRIPLE * p2[self.triple_pair]) / (two[self.triple_before] + TRIPLE)
        out = np.log10(np.minimum(p2, 1))[self.pair_at]
        out[self.inner] = np.log10(np.minimum(p3, 1))[self.triple_at]
        return out


def turns(h: np.ndarray, size: np.ndarray):
    """(n-grams, tokens to leave out) of runs of bounded size: a run begins with the token before, if that is of the same text."""
    before, first = before_of(h, size)
    for a in range(0, len(h), TURN):
        lo = a if first[a] else a - 1
        yield Ngrams(h[lo : a + TURN], before[lo : a + TURN], first[lo : a + TURN]), a - lo


@dataclass
class Model:
    """What scoring needs on each worker: the head's counts, totals, and where the filter is."""

    head: np.ndarray
    head_counts: np.ndarray
    n: int
    v: int
    bloom: Filter

    def head_count(self, h: np.ndarray) -> np.ndarray:
        """Counts of words of the head, -1 for others."""
        if not len(self.head):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[at] == h, self.head_counts[at], -1)

    def token_scores(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        """log10 P of each token, by probes of the file; n-grams with unseen parts aren't asked for."""
        out, level = [], self.bloom.level
        for g, extra in turns(h, size):
            one = level(g.words)
            pair, two = g.pair_keys(), np.zeros(len(g.pair_word), np.int64)
            seen = np.flatnonzero((one[g.pair_before] > 0) & (one[g.pair_word] > 0))
            two[seen] = level(pair[seen])
            triple, three = g.triple_keys(pair), np.zeros(len(g.triple_pair), np.int64)
            seen = np.flatnonzero((two[g.triple_before] > 0) & (two[g.triple_pair] > 0))
            three[seen] = level(triple[seen])
            out.append(g.scores(one, two, three, self.n, self.v)[extra:])
        return np.concatenate(out)


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words that are frequent enough to number at most ``most``: of counts from a power of two on."""
    cuts = [1 << k for k in range(62)]
    sizes = counts.agg(*(F.count_if(F.col("n") >= c).alias(f"c{k}") for k, c in enumerate(cuts))).first()
    least = next((c for k, c in enumerate(cuts) if sizes[f"c{k}"] <= most), cuts[-1])
    return counts.where(F.col("n") >= least)


def fit(docs: DataFrame, training, head: int = HEAD, broadcast: int = BROADCAST, hashes: int = HASHES) -> tuple[Model, DataFrame]:
    """The model of the rows that ``training`` (a condition on doc_id) holds for, and the table of all word counts (key, n)."""
    rows = _text(docs).where(training)
    counts = _counted(rows)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    t = _frequent(counts, head).toArrow()
    key, n = t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy()
    by = np.argsort(key)
    return Model(key[by], n[by], total["n"], total["v"], build_filter(rows, hashes, broadcast)), counts


_SCORED = "doc_id long, held_out boolean, row long, n_tokens long, known long, near double, score double, far array<bigint>"


def _rows(model: Model, piece: pa.RecordBatch, first: int):
    """All columns of ``_SCORED`` but the score, and the texts' hashes and sizes. Rows are numbered from ``first``."""
    h, size = tokens(piece.column("text"))
    starts = np.cumsum(size) - size
    c = model.head_count(h)
    near = np.add.reduceat(np.where(c >= 0, np.log10(np.maximum(c, 0) + 1.0), 0.0), starts)
    far = np.concatenate([[0], np.cumsum(c < 0)])[np.append(starts, len(h))].astype(np.int32)
    known = np.add.reduceat((c > 0).astype(np.int64), starts)
    columns = [piece.column("doc_id"), piece.column("held_out"), pa.array(first + np.arange(len(size))), pa.array(size), pa.array(known), pa.array(near)]
    return columns, pa.ListArray.from_arrays(pa.array(far), pa.array(h[c < 0].view(np.int64))), h, size


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [x.split(" ")[0] for x in _SCORED.split(", ")]

    def run(batches):
        m, number, part = shared.value, 0, task_id()
        for batch in batches:
            for piece in pieces(batch, most_bytes=1 << 20):
                columns, far, h, size = _rows(m, piece, (part << 40) + number)
                number += len(size)
                total = np.add.reduceat(m.token_scores(h, size), np.cumsum(size) - size)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total), far], names)

    own = _text(docs)
    scored = stage(arrow_map(own, run, _SCORED) if model.bloom.name else _by_segments(own, model, shared), "scored", "zstd")
    met = scored.select("row", F.explode("far").alias("key")).join(counts, "key").groupBy("row").agg(F.count("*").alias("far_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("far_log"))
    out = scored.drop("far").join(met, "row", "left")
    n, v, zero = F.lit(model.n).cast("long"), F.lit(model.v).cast("long"), F.lit(0.0)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("far_known", F.lit(0).cast("long"))).alias("n_known"), n.alias("train_tokens"),
        (F.col("near") + F.coalesce("far_log", zero) - F.col("n_tokens") * F.log10((n + v + 1).cast("double"))).alias("base_score"),
        "score")


def _by_segments(own: DataFrame, model: Model, shared) -> DataFrame:
    """The scored rows by probes that are sent to the filter's segments.

    Texts are cut into chunks of rows; each chunk's distinct keys go, as one packed value a shard, to the task of that run of
    segments, their levels come back to the chunk, which is hashed again. A task holds a shard or a chunk.
    """
    names, ends = [x.split(" ")[0] for x in _SCORED.split(", ")], model.bloom.ends
    shard = max(1, int(SHARD // max(1, ends[-1] // len(ends))))  # segments of one task
    shards, hashes = -(-len(ends) // shard), model.bloom.hashes

    def ids_of(g: Ngrams) -> np.ndarray:
        pair = g.pair_keys()
        return filter_ids(np.concatenate([g.words, pair, g.triple_keys(pair)]))

    def chunks(batches):
        number, part = 0, task_id()
        for batch in batches:
            for piece in pieces(batch, most_bytes=1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array([(part << 40) + number] * piece.num_rows, pa.int64()), pa.array((part << 40) + number + np.arange(piece.num_rows)), *piece.columns], ["chunk", "row", *piece.schema.names])
                number += piece.num_rows

    cut = stage(arrow_map(own, chunks, "chunk long, row long, doc_id long, text string, held_out boolean"), "chunks", "zstd")

    def whole(batches):
        """(chunk, its rows) of rows ordered by chunk."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column("chunk").to_numpy()
            edges = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and held[-1].column("chunk")[0].as_py() != c[a]:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def ask(batches):
        for rows in whole(batches):
            ids = np.unique(np.concatenate([ids_of(g) for g, _ in turns(*tokens(rows.column("text")))]))
            own = segment_of(ids, len(ends)) // shard
            cuts = np.searchsorted(own, np.arange(shards + 1))
            which = [i for i in range(shards) if cuts[i + 1] > cuts[i]]
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([1] * len(which), pa.int32()), pa.array([rows.column("chunk")[0].as_py()] * len(which), pa.int64()), pa.array([ids[cuts[i] : cuts[i + 1]].tobytes() for i in which], pa.binary())], ["shard", "kind", "at", "payload"])

    def answer(batches):
        bits: dict[int, bytes] = {}
        at = None
        for batch in batches:
            for who, kind, number, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "at", "payload")), strict=True):
                if who != at:
                    bits, at, cells = {}, who, None
                if not kind:
                    bits[number] = payload
                    continue
                if cells is None:
                    cells = np.frombuffer(b"".join(bits[k] for k in sorted(bits)), np.uint8)
                    begin = int(ends[min(bits) - 1]) if min(bits) else 0
                ids = np.frombuffer(payload, np.uint64)
                own = segment_of(ids, len(ends))
                first = np.concatenate([[0], ends[:-1]])[own]
                level = probe(ids, cells, first - begin, (ends[own] - first) // 64, hashes)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([who], pa.int32()), pa.array([level.astype(np.uint8).tobytes()], pa.binary())], ["chunk", "shard", "levels"])

    layout = "shard int, kind int, at long, payload binary"
    segments = model.bloom.table.select(F.floor(F.col("segment") / shard).cast("int").alias("shard"), F.lit(0).alias("kind"), F.col("segment").cast("long").alias("at"), F.col("bits").alias("payload"))
    asked = arrow_map(cut.repartition(part_of(own), "chunk").sortWithinPartitions("chunk", "row"), ask, layout)
    met = segments.unionByName(asked).repartition(max(part_of(own), shards), "shard").sortWithinPartitions("shard", "kind", "at")
    answers = stage(arrow_map(met, answer, "chunk long, shard int, levels binary"), "levels", "zstd")

    def finish(batches):
        m = shared.value
        for rows in whole(batches):
            told = pa.compute.is_valid(rows.column("levels"))
            level = np.frombuffer(b"".join(rows.filter(told).column("levels").to_pylist()), np.uint8).astype(np.int64)
            piece = rows.filter(pa.compute.invert(told))
            columns, far, h, size = _rows(m, piece, 0)
            columns[2] = piece.column("row")
            known = np.unique(np.concatenate([ids_of(g) for g, _ in turns(h, size)]))
            out = []
            for g, extra in turns(h, size):
                one, two, three = np.split(level[np.searchsorted(known, ids_of(g))], np.cumsum([len(g.words), len(g.pair_word)]))
                two = np.where((one[g.pair_before] > 0) & (one[g.pair_word] > 0), two, 0)
                three = np.where((two[g.triple_before] > 0) & (two[g.triple_pair] > 0), three, 0)
                out.append(g.scores(one, two, three, m.n, m.v)[extra:])
            total = np.add.reduceat(np.concatenate(out), np.cumsum(size) - size)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total), far], names)

    # levels come first, in the order of the shards; then the chunk's rows
    back = answers.select("chunk", F.col("shard").cast("long").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("held_out"), "levels")
    both = cut.withColumn("levels", F.lit(None).cast("binary")).unionByName(back).repartition(part_of(own), "chunk").sortWithinPartitions("chunk", F.isnull("levels"), "row")
    return arrow_map(both, finish, _SCORED)
