"""Queries of whole dialogs, model answers and aligned speech, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers
from ..operators import dialogs, sequence
from .queries import _SEGMENTS, _segments, _sides
from .registry import query, table

_ALLOWED = {"intent": ("1-URGENT", "2-HIGH", "3-MEDIUM"), "obj_type": ("O", "F"), "obj_status": ("open",), "season": ("summer", "winter")}


@query("""WITH d AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s, o_orderkey % 3 = 0 AS det FROM orders)
 SELECT k AS o_orderkey, CASE WHEN p IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN p ELSE '' END AS intent, 'c' || k AS category, CAST(k % 20 AS DOUBLE) AS tire_rim,
 CASE WHEN k % 2 = 0 THEN 'summer' ELSE '' END AS season, CASE WHEN k % 2 = 0 THEN 'Summer' ELSE '' END AS season_label,
 CASE WHEN det AND s IN ('O', 'F') THEN s ELSE '' END AS obj_type, CASE WHEN det THEN 'open' ELSE '' END AS obj_status, CAST(det AS INT) AS obj_detected,
 CAST(k % 5 <> 0 AS INT) AS obj_ack, 0 AS wrap_up, CAST(k % 4 = 1 AS INT) AS addon_offered, array_to_string(CASE WHEN k % 4 = 1 THEN [p, s] ELSE [] END, '|') AS items FROM d""")
def answer_flatten(spark, sf_dir):
    """Answers made of orders; ``wrap_up`` is the text "true", which isn't a true flag."""
    k = F.col("o_orderkey")
    doc = F.to_json(F.struct(
        F.col("o_orderpriority").alias("intent"), F.concat(F.lit("c"), k.cast("string")).alias("category"), (k % 20).alias("tire_rim"), F.when(k % 2 == 0, "summer").otherwise("spring").alias("season"), F.lit("true").alias("wrap_up"),
        F.struct((k % 3 == 0).alias("detected"), F.col("o_orderstatus").alias("type"), F.lit("open").alias("status"), F.struct((k % 5).alias("acknowledge")).alias("handling")).alias("objection"),
        F.struct((k % 4 == 1).alias("offered"), F.when(k % 4 == 1, F.array("o_orderpriority", "o_orderstatus")).otherwise(F.array().cast("array<string>")).alias("items")).alias("add_on_sale")))
    flat = answers.flatten(doc, _ALLOWED, {"season": {"summer": "Summer", "winter": "Winter"}})
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(n) for n, c in flat.items()))
    return rows.select("o_orderkey", "intent", "category", "tire_rim", "season", "season_label", "obj_type", "obj_status", "obj_detected", "obj_ack", "wrap_up", "addon_offered", F.array_join("addon_items", "|").alias("items"))


@query(r"""WITH r AS (SELECT conv_id, turn, role = 'assistant' AS own, nullif(regexp_extract(text, '[A-Z][a-z]+', 0), '') AS name, text LIKE '%e%' AS told FROM conversations),
 n AS (SELECT *, sum(own::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS i FROM r),
 s AS (SELECT *, first_value(CASE WHEN own AND i <= 3 AND told AND name IS NOT NULL THEN name END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sales FROM n)
 SELECT conv_id, max(sales) AS name_sales, arg_min(name, turn) FILTER (WHERE name IS NOT NULL AND (sales IS NULL OR lower(name) <> lower(sales))) AS name_client FROM s GROUP BY 1""")
def dialog_names(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "SALES").otherwise("CLIENT").alias("who"), F.regexp_extract("text", "[A-Z][a-z]+", 0).alias("found"), F.when(F.col("text").contains("e"), "e").alias("told"))
    return dialogs.names(rows, "conv_id", "turn", "who", "found", "told")


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id % 3 <> 0 AS judged, event_id % 7 = 1 AS a, event_id % 5 = 2 AS g FROM events),
 e AS (SELECT *, CASE WHEN judged AND a THEN 1 WHEN g AND (NOT judged OR n > 5) THEN 0 END AS e FROM n),
 b AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM e)
 SELECT user_id, event_id, CASE WHEN judged THEN 'CLIENT' ELSE 'SALES' END AS relabel FROM b WHERE before = 1 AND final = 0 AND ((judged AND e IS NULL) OR (NOT judged AND e = 0))""")
def waiting_relabel(spark, sf_dir):
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(sequence.W.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))
    return dialogs.waiting_relabel(e, "user_id", "n", i % 7 == 1, i % 5 == 2, i % 3 != 0).where("relabel IS NOT NULL").select("user_id", "event_id", "relabel")


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber * 1000000000000 + l_suppkey * 1000000 + CAST(l_quantity * 100 AS BIGINT) AS n, l_returnflag IN ('R', 'A') AS own, 'm' || (l_suppkey % 4) AS m, l_linestatus = 'F' AS f, CAST(l_quantity AS DOUBLE) AS q FROM lineitem),
 a AS (SELECT k, count(*) AS rows_count, arg_min(q, n) AS q, CAST(bool_or(f) AS INT) AS closed FROM l GROUP BY 1),
 m AS (SELECT k, m AS m, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, m) AS r FROM l GROUP BY k, m),
 s AS (SELECT k, string_agg(m, ', ' ORDER BY t) AS shipped_sales FROM (SELECT k, m, min(n) AS t FROM l WHERE own GROUP BY 1, 2) GROUP BY 1)
 SELECT a.k AS l_orderkey, rows_count, q, closed, m.m AS supplier_group, coalesce(shipped_sales, '') AS shipped_sales FROM a JOIN m ON m.k = a.k AND r = 1 LEFT JOIN s ON s.k = a.k""")
def dialog_report_rows(spark, sf_dir):
    """The whole-dialog summary with orders as dialogs and their lines as rows."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * F.lit(10**12) + F.col("l_suppkey") * F.lit(10**6) + (F.col("l_quantity") * 100).cast("long")).alias("at"), F.when(F.col("l_returnflag").isin("R", "A"), "SALES").otherwise("CLIENT").alias("who"), F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("shipped"), (F.col("l_linestatus") == "F").cast("int").alias("closed"), F.col("l_quantity").cast("double").alias("q"))
    return dialogs.summary(li.withColumn("supplier_group", F.col("shipped")), "l_orderkey", "at", "who", criteria=["shipped"], modes=["supplier_group"], flags=["closed"], first=["q"])


@query("""WITH m AS (SELECT user_id, avg(CASE WHEN event_id % 2 = 0 THEN CAST(value AS DOUBLE) END) AS v FROM events GROUP BY 1), q AS (SELECT quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM m)
 SELECT user_id, round(v, 6) AS sales_loudness, CAST(coalesce(v <= lo, false) AS INT) AS quieter, CAST(coalesce(v >= hi, false) AS INT) AS louder FROM m, q""")
def sales_loudness(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 2 == 0, "Speaker_1").otherwise("CLIENT").alias("who"), F.col("value").cast("double").alias("v"))
    return dialogs.relative_loudness(e, "user_id", "who", "v").withColumn("sales_loudness", F.round("sales_loudness", 6))


_TOPICS = ("widget", "promo", "metal")


@query("""WITH t AS (SELECT p_partkey, i, w FROM (SELECT p_partkey, unnest(range(1, 9)) AS i, unnest(string_split(lower(p_name || ' ' || p_type), ' ')[1:8]) AS w FROM part) WHERE w IS NOT NULL),
 n AS (SELECT p_partkey, min(i) AS i, t FROM (SELECT p_partkey, i, CASE WHEN w LIKE 'bol%' OR w LIKE 'gad%' THEN 'metal' ELSE w END AS t FROM t) WHERE t IN ('widget', 'promo', 'metal') GROUP BY p_partkey, t)
 SELECT p_partkey, string_agg(t, ', ' ORDER BY i) AS topics FROM n GROUP BY 1""")
def topic_labels(spark, sf_dir):
    t = dialogs.topics(F.replace(F.concat_ws(" ", "p_name", "p_type"), F.lit(" "), F.lit(",")), _TOPICS, [("bol", "metal"), ("gad", "metal")])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(t, ", ").alias("topics")).where("topics <> ''")


@query(f"""WITH {_SEGMENTS}, r AS (SELECT event_id, greatest(0, "start" - 20) AS s, "end" + 10 AS e FROM s), n AS (SELECT *, CAST(floor((e - s - 100) / 30 + 1e-9) AS INT) + 1 AS n FROM r WHERE e - s > 1e-6),
 w AS (SELECT event_id, 0 AS "window", s AS a, e AS b FROM n WHERE e - s <= 100 + 1e-6
  UNION ALL SELECT event_id, k, s + k * 30, least(s + k * 30 + 100, e) FROM (SELECT *, unnest(range(0, n)) AS k FROM n WHERE e - s > 100 + 1e-6)
  UNION ALL SELECT event_id, n, greatest(s, e - 100), e FROM n WHERE e - s > 100 + 1e-6 AND e - (s + (n - 1) * 30) > 30 AND s + (n - 1) * 30 + 100 < e - 1e-9)
 SELECT event_id, CAST("window" AS INT) AS "window", round(a, 6) AS window_start, round(b, 6) AS window_end FROM w""")
def rolled_windows(spark, sf_dir):
    return sequence.rolled_windows(_segments(spark, sf_dir), "start", "end", F.lit(1e12), 100.0, 30.0, 20.0, 10.0).select("event_id", "window", "window_start", "window_end")


@query(f"""WITH {_SEGMENTS}, d AS (SELECT user_id, "start", max("end") AS "end" FROM s GROUP BY 1, 2)
 SELECT user_id, "start", greatest("start", coalesce(max("end") OVER (PARTITION BY user_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "start")) AS clear_start, max("end") OVER (PARTITION BY user_id ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS clear_end FROM d""")
def overlaps_resolved(spark, sf_dir):
    d = _segments(spark, sf_dir).groupBy("user_id", "start").agg(F.max("end").alias("end"))
    return sequence.without_overlaps(d, "user_id").select("user_id", "start", "clear_start", "clear_end")


@query(f"""WITH {_SEGMENTS}, z AS (SELECT min("start") AS z FROM s), a AS (SELECT user_id, event_id, "start" - z AS s, "end" - z AS e FROM s, z WHERE event_id % 2 = 0 AND "end" > "start"), b AS (SELECT user_id, event_type AS speaker, "start" - z AS s, "end" - z AS e FROM s, z WHERE event_id % 2 = 1),
 o AS (SELECT a.user_id, event_id, a.s AS fs, a.e AS fe, speaker, b.s AS bs, round(least(a.e, b.e) - greatest(a.s, b.s), 6) AS ov, CASE WHEN a.s < 864000 THEN greatest(0, least(a.e, b.e, 1296000) - greatest(a.s, b.s)) ELSE least(a.e, b.e) - greatest(a.s, b.s) END AS cut
  FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e),
 t AS (SELECT user_id, event_id, speaker, row_number() OVER (PARTITION BY user_id, event_id ORDER BY total DESC, speaker) AS r FROM (SELECT user_id, event_id, speaker, round(sum(cut), 6) AS total FROM o GROUP BY 1, 2, 3) WHERE total > 0),
 l AS (SELECT user_id, event_id, speaker, ov / (fe - fs) AS part, fs, row_number() OVER (PARTITION BY user_id, event_id ORDER BY ov DESC, bs, speaker DESC) AS r FROM o WHERE ov > 0.2)
 SELECT a.user_id, a.event_id, coalesce(CASE WHEN l.fs >= 864000 AND l.part >= 0.85 THEN l.speaker ELSE t.speaker END, 'Speaker 1') AS speaker FROM a LEFT JOIN t ON t.user_id = a.user_id AND t.event_id = a.event_id AND t.r = 1 LEFT JOIN l ON l.user_id = a.user_id AND l.event_id = a.event_id AND l.r = 1""")
def aligned_speaker(spark, sf_dir):
    """Phrases of the first ten days count as early ones; the vote then looks at fifteen."""
    a, b = _sides(spark, sf_dir)
    zero = F.broadcast(_segments(spark, sf_dir).agg(F.min("start").alias("z")))
    shift = lambda d: d.join(zero).withColumn("start", F.col("start") - F.col("z")).withColumn("end", F.col("end") - F.col("z"))
    return sequence.aligned_speaker(shift(a).withColumn("text", F.lit("x")), shift(b), "user_id", "event_id", "text", early=864000.0, window=1296000.0)
