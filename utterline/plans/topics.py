"""Topic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import topics
from .registry import query, table


@query()
def topic_tagger(spark, sf_dir):
    """The language of every document as its topic, learnt from those whose id isn't divisible by 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array("lang").alias("truth"))
    model = topics.fit(docs.where("doc_id % 4 <> 0"), "text", "truth", ["de", "en", "es", "fr"])
    return topics.predict(docs, "text", *model).select("doc_id", F.array_join("topics", ", ").alias("topics"))


_PART = "SELECT p_name LIKE '%widget' AS a, p_brand LIKE '%1%' AS b, p_size > 20 AS x, p_partkey % 3 = 0 AS y FROM part"


@query(f"""WITH p AS ({_PART}), c AS (SELECT sum((a AND x)::INT) AS ta, sum(a::INT) + sum(x::INT) AS na, sum((b AND y)::INT) AS tb, sum(b::INT) + sum(y::INT) AS nb FROM p)
 SELECT round(2.0 * (ta + tb) / (na + nb), 6) AS micro_f1, round((2.0 * ta / na + 2.0 * tb / nb) / 2, 6) AS macro_f1 FROM c""")
def multilabel_f1(spark, sf_dir):
    name = lambda a, b: F.array_compact(F.array(F.when(a, "a"), F.when(b, "b")))
    rows = table(spark, sf_dir, "part").select(name(F.col("p_name").like("%widget"), F.col("p_brand").like("%1%")).alias("truth"), name(F.col("p_size") > 20, F.col("p_partkey") % 3 == 0).alias("found"))
    return topics.f1(rows, "truth", "found", ["a", "b"]).select(F.round("micro_f1", 6).alias("micro_f1"), F.round("macro_f1", 6).alias("macro_f1"))
