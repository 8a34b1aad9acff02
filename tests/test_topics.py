import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from utterline.operators import grams, topics
from utterline.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_held_out_languages_are_found(spark):
    found = QUERIES["topic_tagger"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 200 AND doc_id % 4 = 0"), "doc_id")
    good, n = found.agg(F.avg((F.col("topics") == F.col("lang")).cast("double")), F.count("*")).first()
    assert n > 20 and good > 0.9


def test_clean_drops_speakers(spark):
    df = spark.createDataFrame([("Sales: Hello\nClient :  I: you",), (None,)], "t string")
    assert [r[0] for r in df.select(topics.clean(F.col("t"))).collect()] == ["hello i: you", ""]


def _plain(text):
    words = [w for w in text.split() if len(w) > 1]
    inside = [p[i : i + n] for w in words for p in [f" {w} "] for n in (3, 4, 5) for i in range(max(len(p) - n + 1, 1))]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])] + inside


def test_terms_are_hashed_and_weighed_as_by_mllib(spark):
    texts = ["the a thé the cat", "", "x", "ёлка и 日本語 𝒳𝒴 ab", "ab", "w" * 300 + " ab cat", "the cat ab " * 5]
    plain = HashingTF(inputCol="g", outputCol="n", numFeatures=997).transform(spark.createDataFrame([(i, _plain(t)) for i, t in enumerate(texts)], "i int, g array<string>"))
    idf = IDF(inputCol="n", outputCol="x", minDocFreq=2).fit(plain)
    want = [np.array(r[0]) for r in plain.orderBy("i").select(vector_to_array("n")).collect()]
    for parts in ([texts], [texts[:3], texts[3:]]):
        made = [grams.block(p, 997) for p in parts]
        got = [np.bincount(idx, count, 997) for b in made for idx, count in grams.terms(b)]
        assert all((a == b).all() for a, b in zip(got, want, strict=True))
        assert (sum(grams.rows_with(b, 997) for b in made) == sum(w > 0 for w in want)).all()
        own, r = np.random.default_rng(1).random((2, 997)), np.random.default_rng(2).random((2, len(texts)))
        assert np.allclose(np.concatenate([grams.times(grams.wide(b), own) for b in made], 1), own @ np.array(want).T)
        assert np.allclose(grams.back(grams.wide(made[0]), r[:, : len(parts[0])], 997), r[:, : len(parts[0])] @ np.array(want[: len(parts[0])]))
        lengths = [np.linalg.norm(w * idf.idf.toArray()) or 1.0 for w in want]
        assert np.allclose(np.concatenate([grams.norms(b, idf.idf.toArray()) for b in made]), lengths)
    assert not len(grams.block([], 997)["g_idx"]) and [(0, 1), (1, 3), (3, 4)] == list(grams.blocks(["aaaa", "b", "c", "dddd"], 3))


def test_models_are_those_of_mllib(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["red", "apple", "pie", "blue", "river", "boat"], 6, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.1] if i % 3 else [0.1, 0.1, 0.1, 0.2, 0.2, 0.3])), ["food"] if i % 3 else ["water"]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, t string, y array<string>")
    features, models = topics.fit(df, "t", "y", ["food", "water", "none"], buckets=256, iterations=200)
    x = HashingTF(inputCol="g", outputCol="n", numFeatures=256).transform(spark.createDataFrame([(i, _plain(t), float(i % 3 > 0), 0.75 if i % 3 else 1.5) for i, t, _ in rows], "i int, g array<string>, y double, w double"))
    idf = IDF(inputCol="n", outputCol="r", minDocFreq=3).fit(x)
    x = Normalizer(inputCol="r", outputCol="x").transform(idf.transform(x))
    want = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=200, regParam=1e-3).fit(x).transform(x).orderBy("i").select(vector_to_array("probability")[1]).collect()
    got = df.select("i", topics.probabilities(df, "t", features, models).alias("p")).orderBy("i").collect()
    assert list(models) == ["food", "water"] and np.allclose(features.idf, idf.idf.toArray())
    assert np.allclose([r.p[0] for r in got], [r[0] for r in want], atol=0.02)


def test_long_texts_are_learnt_in_time(spark):
    rng = np.random.default_rng(6)
    words = [["".join(rng.choice(list(letters), 6)) for _ in range(3000)] for letters in ("abcdefgh", "efghijkl")]
    df = spark.createDataFrame([(" ".join(rng.choice(words[i % 2], 20_000)), [str(i % 2)]) for i in range(300)], "t string, y array<string>").repartition(4).cache()
    df.count()
    began = time.time()
    assert all(r.topics == r.y for r in topics.predict(df, "t", *topics.fit(df, "t", "y", ["0", "1"])).select("topics", "y").collect())
    assert time.time() - began < 90


def test_models_are_learnt_to_the_end(spark):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    rows = [(" ".join(rng.choice(words[:300] if i % 3 else words[100:], 12)), ["a"] if i % 3 else []) for i in range(400)]
    df = spark.createDataFrame(rows, "t string, y array<string>").repartition(4).cache()
    own, end = (topics.fit(df, "t", "y", ["a"], buckets=4096, **more)[1]["a"] for more in ({}, {"iterations": 2000}))
    assert np.allclose(own.weights, end.weights) and np.isclose(own.intercept, end.intercept)
    short = topics.fit(df, "t", "y", ["a"], buckets=4096, iterations=15)[1]["a"]
    assert np.linalg.norm(short.weights - end.weights) > 0.01 * np.linalg.norm(end.weights)  # so the case needs more than 15


def test_blocks_are_made_in_little_memory():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeéß"), n)) for n in rng.integers(2, 14, 20_000)]
    texts = [" ".join(rng.choice(words, 500)) for _ in range(250)]
    tracemalloc.start()
    grams.block(texts, 1 << 17)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * sum(len(t.encode()) for t in texts)


def test_stored_blocks_are_read_one_at_a_time(spark, tmp_path):
    blocks = lambda x: ({"truth": np.random.default_rng(i).integers(0, 256, 9 << 20)} for i in x.column(0).to_pylist())
    with topics._passing(spark):
        rows = topics._written(spark.range(0, 6, 1, 1), ["truth"], blocks, f"{tmp_path}/b")
        sizes = rows.mapInArrow(lambda xs: (x.append_column("n", pa.array([x.num_rows] * x.num_rows)).select(["n"]) for x in xs), "n long").collect()
    assert [r.n for r in sizes] == [1] * 6
    assert all(pq.ParquetFile(p).num_row_groups >= 3 for p in tmp_path.glob("b/*.parquet"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
