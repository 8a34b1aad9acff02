import numpy as np
import pytest
from pyspark.sql import functions as F

from utterline.llm import ann


def test_hilbert_visits_every_cell_by_steps_of_one():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    place = ann.hilbert(cells, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def _best(ids, x, q, k=20):
    s = (x * x[q]).sum(axis=1)
    s[ids == ids[q]] = -np.inf
    return [int(ids[b]) for b in np.lexsort([ids, -s])[:k] if s[b] > -np.inf]


@pytest.mark.parametrize("way", [ann.search, ann.exact])
def test_small_tables_and_odd_vectors(spark, way):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(200)] + [(1000 + i, [1.0] * 8) for i in range(60)]
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0, None] * 4), (2080, [1.0, 2.0]), (None, [2.0] * 8), (0, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("cls", F.lit(1))
    got = {}
    for r in way(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    assert sorted(got) == sorted(int(i) for i in ids if i % 20 == 0)
    for q, found in got.items():
        assert [(r, v) for r, v, _ in sorted(found)] == [(k + 1, i) for k, i in enumerate(_best(ids, x, list(ids).index(q)))]
    assert way(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = way(spark.createDataFrame(rows[:3], df.select("vec_id", "embedding").schema), F.col("vec_id") == 0, k=20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_vectors_of_many_lengths(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) * rng.lognormal(0, 1, (400, 1))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, k=10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(got[q] == set(_best(np.arange(400), x, q, 10)) for q in got) and len(got) == 8


def test_recall_comes_from_the_curves(spark):
    """A query meets under a third of the rows, yet finds nearly all of its neighbours."""
    rng = np.random.default_rng(2)
    n, block = 12_000, 32
    x = rng.normal(size=(n, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    curves, probes = 120, 40
    assert probes * 3 * block < n / 3
    got = {(r.query_id, r.vec_id) for r in ann.search(df, F.col("vec_id") % 100 == 0, curves=curves, probes=probes, block=block).collect()}
    want = {(q, i) for q in range(0, n, 100) for i in _best(np.arange(n), x, q)}
    assert len(got) == len(want) and len(got & want) >= 0.85 * len(want)


def test_curves_follow_the_rows():
    assert ann.curves_for(2000) == 16 == ann.probes_for(16) and ann.curves_for(500_000) > ann.curves_for(150_000) > 300
    assert ann.reach_for(100_000, ann.curves_for(100_000), 24, 256) == 1 < ann.reach_for(10**8, ann.curves_for(10**8), 24, 256)
