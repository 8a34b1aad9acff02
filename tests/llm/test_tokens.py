import collections
import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from utterline.llm import bpe, packing, token_store
from utterline.llm.encode import default_word_tokenizer, encoder


def test_segments_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 9000):
        x = (rng.zipf(1.3, n) % (1 << 32)).astype(np.uint32)
        p = token_store.pack_segment(x)
        assert (token_store.unpack_segment(p) == x).all()
        assert (token_store.unpack_segment(p, n // 3, n // 2) == x[n // 3 : n // 2]).all()


def _ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


def test_store_and_packing(spark, docs):
    t, rows = Tokenizer.from_file(default_word_tokenizer()), docs.collect()
    path = token_store.write_store(docs)
    got = sorted(map(tuple, token_store.digests(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] is None for r in got] == [True] + [False] * (len(rows) - 1)
    assert [r[0] for r in got][1:] == sorted(r.doc_id for r in rows if r.doc_id is not None)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    assert sorted((str(r.doc_id), zlib.crc32(_ids(t, r.text))) for r in rows) == sorted((str(r[0]), r[3]) for r in got)
    stream = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)])
    assert (token_store.read_ids(spark, path, 100, 3000) == stream[100:3100]).all()


def test_packing_equals_one_long_stream(docs):
    """Every piece is the part of its document that it says, and the windows are the documents one after the other, cut."""
    t, rows = Tokenizer.from_file(default_word_tokenizer()), docs.collect()
    ids = collections.Counter((str(r.doc_id), _ids(t, r.text)) for r in rows)
    packed = packing.pack(docs.withColumn("offset", F.lit("x")).withColumn("part", F.lit(1)))
    pieces, digests = packed.collect(), packing.digests(packed).collect()
    windows, whole = {}, {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append((p.offset, p))
        assert p.length == len(p.ids) // 4 and 0 < p.length and p.offset + p.length <= 2048
    stream = [p for k in sorted(windows) for _, p in sorted(windows[k], key=lambda x: x[0])]
    at = 0
    for p in stream:
        assert p.sequence_id * 2048 + p.offset == at
        at += p.length
    assert at == sum(len(x) // 4 * n for (_, x), n in ids.items())
    got, held = collections.Counter(), b""
    for p in stream:  # a document's pieces follow each other
        assert p.start == len(held) // 4
        held += bytes(p.ids)
        if len(held) // 4 == p.doc_tokens:
            got[str(p.doc_id), held] += 1
            held = b""
    assert got == ids and not held
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in digests) == sorted((str(p.doc_id), p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, p.sequence_id, p.offset) for p in pieces)
    last = packing.sequences(packed).orderBy("sequence_id").collect()
    assert [r.n_tokens for r in last[:-1]] == [2048] * (len(windows) - 1) and {len(r.ids) for r in last[:-1]} <= {8192}
    assert all(bytes(r.ids)[: 4 * r.n_tokens] == b"".join(bytes(p.ids) for _, p in sorted(windows[r.sequence_id], key=lambda x: x[0])) for r in last)


def test_windows_of_a_power_of_two_are_not_padded(spark):
    rows = [(0, 0, b"\1\0\0\0" * 2048), (1, 0, b"\1\0\0\0" * 512), (2, 0, b"\1\0\0\0" * 513)]
    got = packing.sequences(spark.createDataFrame(rows, "sequence_id long, offset long, ids binary")).orderBy("sequence_id").collect()
    assert [len(r.ids) // 4 for r in got] == [2048, 512, 2048]


def test_encoder_equals_library():
    e = encoder(default_word_tokenizer())
    rng = random.Random(2)
    parts = ["A", "b", " ", "  ", "\n", "é", "É", "½", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "\x1c", "\xa0", "漢", "!", "İ", "Σ", "́", "word", "Word.", "$$$"]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(20)))
        assert np.frombuffer(e.encode_many([s])[0], "<u4").tolist() == e.tokenizer.encode(s, add_special_tokens=False).ids, s


def test_byte_pairs(docs):
    t = Tokenizer.from_file(bpe.default_byte_tokenizer())
    want = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(docs).collect()) == sorted(want)
    m, rng = bpe.machine(bpe.default_byte_tokenizer()), random.Random(4)
    for s in ("a" * 4000, "=" * 1500 + "-" * 999, "".join(rng.choice(["th", "er", "e", "in", "ing", "tion", "s", "aaa"]) for _ in range(2000))):
        assert list(m.stream(s[i : i + 7].encode() for i in range(0, len(s), 7))) == t.encode(s, add_special_tokens=False).ids
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(8))]
        d = bpe.Decoder(m)
        assert "".join(d.feed([i]) for i in ids) + d.end() == t.decode(ids, skip_special_tokens=False)
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(str(r.text) for r in back) == sorted(r.text or "" for r in docs.collect())


def test_empty(spark, docs):
    none = docs.limit(0)
    assert token_store.digests(spark, token_store.write_store(none)).count() == packing.pack(none).count() == bpe.digests(none).count() == 0
