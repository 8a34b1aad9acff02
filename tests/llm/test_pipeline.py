"""The pipeline against a plain version of its stages on one machine."""

import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from .test_documents import plain_removal

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

from utterline.llm import pii, quality  # noqa: E402
from utterline.llm.common import shared_dir  # noqa: E402
from utterline.llm.encode import default_word_tokenizer  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, n_chars long, score double, _id string, n_removed int, n_pii int"


def _tables(spark, folder, rows, labels):
    spark.createDataFrame([(i, t, "en", len(t or ""), 0.5, f"r{k}", 3, 4) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def _rows():
    rng = np.random.default_rng(11)
    words = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words, n)) + "."
    rows = [(i, text(60 + i % 40)) for i in range(160)]
    rows += [(200 + i, " ".join(w + "$$$" for w in rng.choice(words, 50))) for i in range(60)]  # junk
    shared = text(40)
    rows += [(300 + i, text(30) + " " + shared + " " + text(30)) for i in range(6)]  # a passage in several
    rows += [(400 + i, rows[i][1]) for i in range(5)] + [(410, rows[7][1].replace(rows[7][1].split()[30], "other", 1))]  # copies
    rows += [(500, "Write to ann.lee@mail.example.com or call (212) 555-0123 now. " + text(40)), (501, "token = 'ab8ca1b325bc4f85' " + text(40))]
    rows += [(600, None), (601, ""), (None, text(50)), (602, "one two"), (602, "one two"), (603, "漢字 " + text(20))]
    labels = [(i, int(not 200 <= i < 260), 0) for i, _ in rows[:220]] + [(600, None, 0), (None, 1, 0)]
    return rows, labels


def _grams(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _plain(rows, good):
    """The token stream of each document, from the stages one after the other; ``good`` are the rows that the classifier keeps."""
    rows = [r for r in rows if r in good]
    kept = []
    for i, t in sorted({r for r in rows if r[0] is not None}):  # a group's least id stays: here groups are pairs of a text and its copies
        g = _grams(t)
        if not g or not any(len(g & h) >= 0.8 * len(g | h) for h in map(_grams, (x for _, x in kept)) if h):
            kept.append((i, t))
    kept += [r for r in rows if r[0] is None]
    p, t, out = pii.Pseudonyms(pii.TEST_KEY), Tokenizer.from_file(default_word_tokenizer()), []
    for i, data, cover in plain_removal(kept):
        text = bytes(np.frombuffer(data, np.uint8)[~cover]).decode("utf-8", "ignore")
        if cover.any() and not text.strip(" "):
            continue
        out.append((i, np.array([*t.encode(p.replace(text)[0], add_special_tokens=False).ids, 1], "<u4").tobytes()))
    return sorted(out, key=str)


def test_the_pipeline_equals_plain_stages(spark, tmp_path):
    rows, labels = _rows()
    _tables(spark, tmp_path, rows, labels)
    docs, known = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    good = {(r.doc_id, r.text) for r in corpus_pipeline.drop_low_quality(spark, docs, str(tmp_path)).collect()}
    model = quality.fit(docs, known, training=~quality.held_out())
    assert good == {r for r in rows if model.probabilities(quality.pooled(r[1] or "", model.context)[None])[0] >= 0.3}
    assert not any(200 <= (i or 0) < 260 for i, _ in good) and sum(i is not None and i < 160 for i, _ in good) >= 158
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    stream = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    got, held = [], b""
    for r in stream:
        held += bytes(r.ids)
        if len(held) == 4 * r.doc_tokens:
            got.append((r.doc_id, held))
            held = b""
    assert sorted(got, key=str) == _plain(rows, good) and not held
    ids = {i for i, _ in got}
    assert {0, 1, 2, 7, 600, 601, 602, None} <= ids and not ids & {400, 401, 402, 410} and sum(i == 602 for i, _ in got) == 1


def test_stages_keep_columns_and_leave_nothing_behind(spark, tmp_path):
    rows, labels = _rows()
    _tables(spark, tmp_path / "some", rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    names = {r._id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/some")
        assert out.columns == docs.columns, name
        for r in out.collect():
            was = names[r._id]
            assert (r.doc_id, r.lang, r.score, r.n_removed, r.n_pii) == (was.doc_id, was.lang, was.score, was.n_removed, was.n_pii)
            assert r.n_chars == len(r.text or "") and (name in ("suffix_array_dedup", "pii") or r.text == was.text)
    root = Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in root.iterdir()}
    corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert len({p.name for p in root.iterdir()} - before) == 1


@pytest.mark.parametrize("kept", [0, 1])
def test_empty_tables(spark, tmp_path, kept):
    rows, labels = _rows()
    _tables(spark, tmp_path, rows[:kept], labels[:0])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in out) == sum(r.doc_tokens for r in out if not r.start) and len({r.doc_id for r in out}) == kept
    assert zlib.crc32(b"") == 0
