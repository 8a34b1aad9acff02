import io
import wave

import numpy as np
from pyspark.sql import functions as F

from utterline.functions import answers, audio
from utterline.operators import dialogs, sequence


def _wav(x, rate=16000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(audio.to_pcm16(np.repeat(x, channels)))
    return out.getvalue()


def test_wav_frames_and_phrases(spark):
    x = np.r_[np.zeros(16000), np.full(16000, 0.5)].astype(np.float32)
    files = spark.createDataFrame([("a.wav", _wav(x, channels=2)), ("b.wav", b"junk"), ("c.wav", None)], "file_name string, content binary")
    assert [r[0] for r in files.orderBy("file_name").select(audio.duration("content")).collect()] == [2.0, 0.0, 0.0]
    phrases = spark.createDataFrame([(1, "a.wav", 0.0, 0.8), (2, "a.wav", 1.2, 1.8), (3, "a.wav", 5.0, 6.0), (4, "b.wav", 0.0, 1.0)], "id int, file_name string, start double, end double")
    got = {r.id: r for r in audio.phrase_loudness(audio.rms_frames(files), phrases, "id").collect()}
    assert got[1].mean_loudness == 0 and got[1].num_frames == 50
    assert abs(got[2].mean_loudness - 0.5) < 1e-3 and got[2].num_frames == 37
    assert got[3].num_frames == got[4].num_frames == 0 and got[4].max_loudness == 0


def test_samples():
    x = np.sin(np.arange(8000) / 10).astype(np.float32)
    assert np.allclose(audio.from_pcm16(audio.to_pcm16(x)), x, atol=1e-3)
    assert len(audio.fit_length(x, 20000)) == 20000 and len(audio.fit_length(x, 100)) == 100
    assert abs(20 * np.log10(np.sqrt(np.mean(audio.level_to(x) ** 2))) + 20) < 0.01
    assert len(audio.without_silence(np.r_[x, np.zeros(16000, np.float32), x], 16000)) == 16000
    want = [np.sqrt(np.sum(np.square(np.r_[np.zeros(1024), x, np.zeros(1024)][i : i + 2048], dtype=float)) / 2048) for i in range(0, 8001, 256)]
    assert np.allclose(audio.rms(x), want)


def test_answers_of_any_kind(spark):
    docs = ['{"wrap_up": true, "objection": {"detected": "true", "type": "price"}, "next_set": {"set": "x"}}', '{"objection": "none", "add_on_sale": {"items": "oil"}}', "broken", "[]", None]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    out = rows.select("i", *(c.alias(n) for n, c in answers.flatten(F.col("d"), {"obj_type": ("price",)}).items())).orderBy("i").collect()
    assert [r.wrap_up for r in out] == [1, 0, 0, 0, 0] and [r.obj_detected for r in out] == [0] * 5
    assert [r.next_set for r in out] == [1, 0, 0, 0, 0] and [r.obj_type for r in out] == [""] * 5
    assert [r.addon_items for r in out] == [[], ["oil"], [], [], []]


def test_windows_are_cut_between_speakers(spark):
    rows = [("f", 0.0, 1.0, 0, 0), ("f", 0.9, 2.0, 0, 0), ("f", 1.9, 3.0, 1, 0), ("f", 2.9, 4.5, 1, 0), ("f", 9.0, 9.5, 1, 1), ("f", 20.0, 22.0, 0, 2)]
    got = sequence.cut_segments(spark.createDataFrame(rows, "file string, s double, e double, lab int, vad int"), "file", "s", "e", "lab", "vad").collect()
    cut = (1.0 + 2.45) / 2 + 0.04
    assert [(round(r.start, 6), round(r.end, 6), r.lab) for r in got] == [(0.0, round(cut, 6), 0), (round(cut, 6), 4.5, 1), (20.0, 22.0, 0)]


def test_a_dialog_that_ends_waiting_keeps_its_labels(spark):
    rows = spark.createDataFrame([("x", 1, True, False, True), ("x", 2, False, False, True), ("x", 7, False, True, True), ("y", 1, True, False, True), ("y", 2, False, False, True), ("z", 1, True, None, True), ("z", 2, None, True, False)], "d string, n int, a boolean, g boolean, j boolean")
    got = dialogs.waiting_relabel(rows, "d", "n", F.col("a"), F.col("g"), F.col("j")).where("relabel IS NOT NULL").collect()
    assert sorted((r.d, r.n, r.relabel) for r in got) == [("x", 2, "CLIENT"), ("z", 2, "SALES")]
