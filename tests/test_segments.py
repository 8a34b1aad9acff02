import numpy as np
import pytest

from utterline.operators import segments
from utterline.sources import tables


@pytest.fixture()
def spans(spark):
    return spark.createDataFrame([("f", 0.0, 1.0, "A", "x"), ("f", 1.0, 2.0, "A", "y"), ("f", 2.0, 9.0, "B", "z"), ("f", 9.0, 9.2, "B", "z")], "file string, start double, end double, speaker string, text string")


def test_adjacent_phrases_join_in_order(spans):
    rows = segments.join_adjacent(spans, "file", "speaker", "text").orderBy("start").collect()
    assert [(r.speaker, r.start, r.end, r.text, r.n_rows) for r in rows] == [("A", 0.0, 2.0, "x y", 2), ("B", 2.0, 9.2, "z z", 2)]


def test_labels_starts_and_copies(spans):
    out = segments.copies_of_previous(segments.extend_back(segments.encode_labels(spans, "file", "speaker", most=1), "file"), "file", "speaker", "text").orderBy("start").collect()
    assert [r.code for r in out] == [0, 0, -1, -1]
    assert [r.extended_start for r in out] == [0.0, 1.0, 2.0, 9.0]
    assert [r.copied for r in out] == [False, False, False, True]


def test_short_spans_go(spans):
    assert sorted(r.start for r in segments.snap_spans(spans).collect()) == [0.15, 1.0, 2.0]


def test_longest_early_speaker_is_first(spans):
    named = {r.speaker: r.named for r in segments.first_speakers(spans, "file", "speaker").collect()}
    assert named == {"B": "Speaker 1", "A": "Speaker 2"}


def test_centroids_have_length_one(spark):
    df = spark.createDataFrame([("a", [3.0, 0.0]), ("a", [3.0, 8.0]), ("z", [0.0, 0.0])], "label string, e array<double>")
    got = {r.label: r.centroid for r in segments.centroids(df, "label", "e").collect()}
    assert got["a"] == pytest.approx([0.6, 0.8]) and got["z"] == [0.0, 0.0]


def _plain_dwell(labels, start, end, least=1.0):
    """One run after the other, as the rule says it."""
    y = list(labels)
    for _ in range(5):
        runs, changed = [], False
        for i, v in enumerate(y):
            if runs and runs[-1][0] == v:
                runs[-1][2] = i
            else:
                runs.append([v, i, i])
        length = [end[b] - start[a] for _, a, b in runs]
        for k, (_, a, b) in enumerate(runs):
            if len(runs) > 1 and length[k] < least - 1e-6:
                before = length[k - 1] if k else -1.0
                after = length[k + 1] if k + 1 < len(runs) else -1.0
                y[a : b + 1] = [y[a - 1] if before >= after else y[b + 1]] * (b + 1 - a)
                changed = True
        if not changed:
            break
    return y


def test_dwell_goes_from_left_to_right(spark):
    at = np.arange(6) * 0.5
    assert segments.min_dwell(np.array([0, 0, 0, 1, 2, 2]), at, at + 0.5).tolist() == [0, 0, 0, 0, 2, 2]
    assert segments.min_dwell(np.array([1]), np.array([0.0]), np.array([0.1])).tolist() == [1]
    rng = np.random.default_rng(7)
    rows = []
    for g in range(60):
        n = int(rng.integers(1, 25))
        start = np.cumsum(rng.random(n) * 0.5)
        end = start + rng.random(n) * 0.9
        labels = rng.integers(0, 3, n)
        assert segments.min_dwell(labels, start, end).tolist() == _plain_dwell(labels.tolist(), start, end)
        rows += [(g, i, int(x), float(a), float(b)) for i, (x, a, b) in enumerate(zip(labels, start, end, strict=True))]
    got = {(r.g, r.i): r.x for r in segments.enforce_dwell(spark.createDataFrame(rows, "g int, i int, x int, start double, end double"), "g", "i", "x").collect()}
    for g in range(60):
        own = [r for r in rows if r[0] == g]
        assert [got[g, r[1]] for r in own] == _plain_dwell([r[2] for r in own], [r[3] for r in own], [r[4] for r in own])


def test_small_margins_keep_the_label():
    scores = np.array([[0.9, 0.1], [0.5, 0.49], [0.1, 0.9], [0.5, 0.51]])
    assert segments.keep_on_small_margin(np.array([0, 1, 1, 0]), scores).tolist() == [0, 0, 1, 1]


def test_an_empty_label_gets_the_farthest_vector(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.2]), (0, [0.0, 5.0])], "label int, e array<double>")
    got = {r.label: r.centroid for r in segments.centroids(df, "label", "e", [0, 1]).collect()}
    assert got[1] == pytest.approx([0.0, 1.0]) and len(got) == 2


def test_numbers_lines_and_rounding(spark, spans):
    from pyspark.sql import functions as F

    assert sorted(r.phrase_id for r in segments.phrase_numbers(spans, "file").collect()) == [1, 2, 3, 4]
    assert sorted((r.start, r.text) for r in segments.transcript_lines(spans, "file", "speaker", "text").collect()) == [(0.0, "x y"), (2.0, "z")]
    a, b = segments.round_out(F.lit(0.12), F.lit(0.31))
    assert tuple(spark.range(1).select(a, b).first()) == (0.1, 0.35)


def test_upsert_update_delete_and_action(spark):
    from pyspark.sql import functions as F

    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "id int, v string")
    assert sorted(map(tuple, tables.upserted(old, new, "id").collect()))[:2] == [(1, "a"), (2, "c")]
    assert sorted(map(tuple, tables.updated(old, new, "id", ["v"]).collect())) == [(1, "a"), (2, "c")]
    kids, grand = spark.createDataFrame([(10, 1), (20, 2)], "k int, pid int"), spark.createDataFrame([(10,), (20,)], "kid int")
    left = tables.cascade_deleted(old, kids, grand, new.where("id = 2"), "id", "pid", "k", "kid")
    assert [[r[c] for r in t.collect()] for t, c in zip(left, ("id", "k", "kid"), strict=True)] == [[1], [10], [10]]
    rows = spark.createDataFrame([(False, False, 0), (True, False, 0), (True, True, 0), (True, True, 9)], "k boolean, p boolean, t int")
    act = tables.action(F.col("k"), F.col("p"), F.col("t"), F.lit(5), skip_processed=False)
    assert [r[0] for r in rows.select(act).collect()] == ["new", "continue", "reprocess", "skip"]


def test_names_and_columns(spark):
    assert tables.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a.1", "a.2"]
    with pytest.raises(ValueError, match="missing columns: z"):
        tables.require_columns(spark.range(1), ["id", "z"])


def test_audio_listing(spark, tmp_path):
    for n in ("a.WAV", "b.txt", "c.mp3"):
        (tmp_path / n).write_bytes(b"123")
    assert sorted((r.file_name, r.length) for r in tables.audio_files(spark, str(tmp_path)).drop("content").collect()) == [("a.WAV", 3), ("c.mp3", 3)]


def _naive_two(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 2:
        pairs = [(d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    return sorted(map(sorted, groups))


def test_two_clusters_equal_plain_average_linkage():
    rng = np.random.default_rng(4)
    for n in (2, 3, 9, 30):
        x = rng.normal(size=(n, 5))
        labels = segments.two_clusters(x, least=0.0)
        assert sorted([sorted(np.flatnonzero(labels == k).tolist()) for k in (0, 1)]) == _naive_two(x)


def test_lopsided_clusters_are_split(spark):
    x = [[1.0, 0.01 * i] for i in range(19)] + [[-1.0, 0.0]]
    got = segments.speaker_clusters(spark.createDataFrame([("f", i, v) for i, v in enumerate(x)], "f string, i int, e array<double>"), "f", "i", "e").toPandas()
    assert got.label.sum() == 10
