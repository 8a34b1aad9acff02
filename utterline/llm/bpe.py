"""Byte-pair encoding and decoding as streaming machines.

Encoding. ``BytePairs`` reads a byte-level vocabulary and its merge list and computes the list's *sufficient
lookahead*: how far to the left bytes that follow can still move a token boundary. Let the front be the leftmost place
where the merging of a text and of the text with more behind it differ; it starts at the text's end. A merge (u, v)
can only move it if v begins at the front, and moves it by len(u). The next one has a later rank, for merges run
in the order of their ranks and each runs from the left, and its right part begins with u. So the longest
chain of that kind, found by one pass over the ranks from the last to the first, bounds the movement. Tokens that end
that far before the end of what was read are stable and are emitted; the rest stays in a buffer, so memory
doesn't depend on the length of a run of letters.

Splitting into pre-tokens runs along the text; no pre-token's ids depend on another's. Chunks between single blanks
repeat, and a bounded map from chunk to ids answers most of them.

Decoding. ``Decoder`` takes ids one batch after another, turns them into bytes and the bytes into text with an
incremental UTF-8 machine that keeps at most three bytes; what isn't UTF-8 becomes U+FFFD as in the library.

Nulls: a null text is an empty one, with no ids. Repeated rows are separate documents. Columns other than doc_id and
text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, arrow_map, pieces, texts_of
from .encode import byte_letters

#: Fixed value: the published splitting pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the library's pattern engine has it: Python's engines also count U+001C to U+001F.
_SPACE = r"[\t-\r \x85\xA0  -     　]"
_NOT_SPACE = _SPACE.replace("[", "[^", 1)
_SPLIT = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r \x85\xA0  -     　\p{L}\p{N}]").replace(r"(?!\S)", f"(?!{_NOT_SPACE})").replace(r"\s", _SPACE))
#: Where white space touches white space, or stands at an end of a line: such lines are split as a whole.
_RUNS = re.compile(r"[\s\x1c-\x1f][^\S\n]|[^\S\n][\s\x1c-\x1f]|[^\S\n]\Z|\A[^\S\n]|[^\S \n]|\n\n")
#: Longer chunks and pre-tokens are streamed, not remembered.
LONG = 256
_NONE = 1 << 60
_TAIL = ".,!?;:%$#&*|"
_MACHINES: dict[str, BytePairs] = {}


def default_byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class BytePairs:
    """The transducer of one vocabulary file (JSON, byte-level, without normalizer)."""

    def __init__(self, path: str, size: int = 72 << 20):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = {c: b for b, c in byte_letters().items()}
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.ids = {b: i for i, b in self.bytes_of.items() if i not in self.special.values()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(data["model"]["merges"]):
            u, v = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[u], vocab[v]] = (rank, vocab[u + v])
        self.pairs = {u << 20 | v: rank << 20 | t for (u, v), (rank, t) in self.merges.items()}
        self.lookahead = self._lookahead()
        self.longest = max(map(len, self.bytes_of.values()))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = Generations(self._word, (__name__,), size)  # a pre-token without its leading blank matters: both are keys here
        self.after = Generations(self._after, (__name__,), size)  # chunks that follow one blank
        self.first = Generations(self._chunk, (__name__,), size // 4)  # chunks that begin a line

    def _lookahead(self) -> int:
        """Bytes by which a boundary must precede the end of what was read to be final."""
        left: dict[int, int] = {}  # the left part of the merge that makes a token
        for (u, _), (_, t) in self.merges.items():
            left.setdefault(t, u)
        reach: dict[int, int] = {}  # of chains whose first merge has a right part that begins with the token
        most = 0
        for (u, v), _ in sorted(self.merges.items(), key=lambda m: -m[1][0]):
            far = len(self.bytes_of[u]) + reach.get(u, 0)
            most = max(most, far)
            w: int | None = v
            while w is not None:
                if far > reach.get(w, 0):
                    reach[w] = far
                w = left.get(w)
        return most

    def _merge(self, data: bytes) -> list[int]:
        """All merges of a short run of bytes, by rank and then from the left."""
        get = self.pairs.get
        ids = list(map(self.single.__getitem__, data))
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) < _NONE:
            i = ranks.index(best)
            ids[i] = t = best & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(t << 20 | ids[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | t, _NONE)
        return ids

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token that arrives in parts; holds the lookahead and two tokens' length of it at most, besides a part."""
        held = b""
        keep = self.lookahead + 2 * self.longest
        for part in parts:
            for i in range(0, len(part), keep):
                held += part[i : i + keep]
                if len(held) < 2 * keep:
                    continue
                done = 0
                for t in self._merge(held):
                    end = done + len(self.bytes_of[t])
                    if end > len(held) - self.lookahead:
                        break
                    yield t
                    done = end
                held = held[done:]
        yield from self._merge(held) if held else ()

    def _word(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        return tuple(self._merge(data)) if len(data) <= 2 * self.longest else tuple(self.stream([data]))

    def _after(self, chunk: str) -> tuple[int, ...]:
        if chunk.isalpha():
            return self.words[" " + chunk]
        base = chunk.rstrip(_TAIL)
        if base != chunk and base.isalpha():  # letters and signs are split before merging
            return self.words[" " + base] + self.words[chunk[len(base):]]
        return self._chunk(" " + chunk)

    def _chunk(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.words.__getitem__, _SPLIT.findall(text))))

    def _plain(self, text: str) -> Iterator[Iterable[int]]:
        """Runs of ids of a text without special tokens."""
        if _RUNS.search(text):
            for m in _SPLIT.finditer(text):
                word = m.group()
                yield self.words[word] if len(word) <= LONG else self.stream([word.encode()])
            return
        newline = self.words["\n"] if "\n" in text else ()
        for k, line in enumerate(text.split("\n")):
            if k:
                yield newline
            if line:
                one, *more = line.split(" ")
                yield self.first[one] if len(one) <= LONG else self._chunk_stream(one)
                if max(map(len, more), default=0) <= LONG:
                    for i in range(0, len(more), 4096):
                        yield chain.from_iterable(map(self.after.__getitem__, more[i : i + 4096]))
                else:
                    yield from (self.after[c] if len(c) <= LONG else self._chunk_stream(" " + c) for c in more)

    def _chunk_stream(self, text: str) -> Iterator[int]:
        for m in _SPLIT.finditer(text):
            word = m.group()
            yield from self.words[word] if len(word) <= LONG else self.stream([word.encode()])

    def runs(self, text: str) -> Iterator[Iterable[int]]:
        """Runs of ids of a text, in order. Special tokens' strings in the text are those tokens."""
        parts = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
        for p in parts:
            if p in self.special:
                yield (self.special[p],)
            elif p:
                yield from self._plain(p)

    def encode(self, text: str) -> Iterator[int]:
        """Ids of a text, as they become stable."""
        return chain.from_iterable(self.runs(text))


class Decoder:
    """Ids to text, a batch at a time."""

    def __init__(self, machine: BytePairs):
        self.bytes_of, self.state = machine.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def end(self) -> str:
        return self.state.decode(b"", final=True)


def machine(path: str) -> BytePairs:
    if path not in _MACHINES:
        _MACHINES[path] = BytePairs(path)
    return _MACHINES[path]


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and its ids."""
    tokenizer = tokenizer or default_byte_tokenizer()

    def run(batches):
        m = machine(tokenizer)
        for batch in batches:
            for piece in pieces(batch, most_bytes=1 << 20):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([list(m.encode(t)) for t in texts_of(piece.column("text"))], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(_own(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and the text that its ids stand for."""
    tokenizer = tokenizer or default_byte_tokenizer()

    def run(batches):
        m = machine(tokenizer)
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                d = Decoder(m)
                texts.append(d.feed(ids or ()) + d.end())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str | None = None, step: int = 1 << 16) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded ``step`` ids at a time."""
    tokenizer = tokenizer or default_byte_tokenizer()

    def run(batches):
        m = machine(tokenizer)
        for batch in batches:
            for piece in pieces(batch):
                counts, ids_sha, text_sha = [], [], []
                for text in texts_of(piece.column("text")):
                    n, a, b, d, held = 0, hashlib.sha256(), hashlib.sha256(), Decoder(m), []
                    for run_of in m.runs(text):
                        held.extend(run_of)
                        if len(held) >= step:
                            n = _take(m, held, n, a, b, d)
                    n = _take(m, held, n, a, b, d)
                    b.update(d.end().encode())
                    counts.append(n)
                    ids_sha.append(a.hexdigest())
                    text_sha.append(b.hexdigest())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(_own(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _take(m: BytePairs, held: list[int], n: int, a, b, d: Decoder) -> int:
    if held:
        a.update(("," * bool(n) + ",".join(map(m.decimal.__getitem__, held))).encode())
        b.update(d.feed(held).encode())
        n += len(held)
        held.clear()
    return n


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
