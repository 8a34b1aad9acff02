"""Queries of lookups, changes, spans and detectors, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import audio, text
from ..operators import dialogs, report, segments, sequence, speakers
from ..sources import tables
from .queries import _SEGMENTS, _segments
from .registry import query, table


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def rows_without_criteria(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "CLIENT").otherwise(F.col("lang")).alias("lang"))
    return speakers.without_criteria(rows, table(spark, sf_dir, "labels"), "doc_id", "doc_id", "lang")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def lookup_by_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return tables.find_all_by(table(spark, sf_dir, "orders"), "o_custkey", keys).select("o_orderkey", "o_custkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 7) UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 11")
def lookup_points(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return tables.find_all_by(n, "n_nationkey", [3, 7]).unionByName(tables.find_by(n, "n_nationkey", 11))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders
 UNION ALL SELECT o_orderkey + 100000000, 'N' FROM orders WHERE o_orderkey % 11 = 0""")
def upsert_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("X")).unionByName(o.where("o_orderkey % 11 = 0").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    return tables.upserted(o, new, "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'DONE' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders")
def update_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    changes = o.where("o_orderkey % 6 IN (0, 3, 5)").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "DONE").alias("o_orderstatus"))
    return tables.updated(o, changes, "o_orderkey", ["o_orderstatus"])


@query("""SELECT 'customer' AS kind, count(*) AS n FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 5 <> 0
 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 0)""")
def cascade_delete(spark, sf_dir):
    c, o, li = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    left = tables.cascade_deleted(c, o, li, c.where("c_custkey % 5 = 0"), "c_custkey", "o_custkey", "o_orderkey", "l_orderkey")
    one = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in zip(("customer", "orders", "lineitem"), left, strict=True)]
    return one[0].unionByName(one[1]).unionByName(one[2])


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality = 0 THEN 'continue' WHEN d.n_chars < 500 THEN 'reprocess' ELSE 'skip' END AS action FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def run_action(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("known"))
    d = table(spark, sf_dir, "documents").join(known, "doc_id", "left")
    return d.select("doc_id", tables.action(F.coalesce("known", F.lit(False)), F.col("quality") != 0, F.col("n_chars"), F.lit(500), skip_processed=False).alias("action"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS ordinal FROM orders")
def row_ordinals(spark, sf_dir):
    return tables.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "ordinal")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 40")
def offset_slice(spark, sf_dir):
    return tables.sliced(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 40, 25)


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'ing ')")
def contains_search(spark, sf_dir):
    return speakers.searched(table(spark, sf_dir, "conversations"), "text", "ING ").select("conv_id", "turn")


@query("SELECT event_id, 'Speaker_' || (event_id % 4 + 1) AS speaker FROM events WHERE event_type <> 'click'")
def speaker_names(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("who", F.when(F.col("event_type") == "click", "CLIENT").otherwise(F.col("event_type")))
    return speakers.without_clients(e, "who").select("event_id", speakers.speaker_name(F.col("event_id") % 4).alias("speaker"))


@query(f'WITH {_SEGMENTS}, z AS (SELECT min("start") + 86400 AS z FROM s) SELECT event_id, greatest(z, "start") AS "start", "end" FROM s, z WHERE round("end" - greatest(z, "start"), 9) >= 30')
def snapped_spans(spark, sf_dir):
    s = _segments(spark, sf_dir)
    first = s.agg(F.min("start")).first()[0] + 86400
    return segments.snap_spans(s, first, 30.0).select("event_id", "start", "end")


@query("SELECT event_id, CASE WHEN r <= 2 THEN r - 1 ELSE -1 END AS code FROM (SELECT event_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS INT) AS r FROM events)")
def label_codes(spark, sf_dir):
    return segments.encode_labels(table(spark, sf_dir, "events"), "user_id", "event_type", 2).select("event_id", "code")


def _distinct(spark, sf_dir):
    """Segments of a file with starts of their own, so that every order is the same."""
    return _segments(spark, sf_dir).groupBy("user_id", "start").agg(F.max("end").alias("end"), F.min("event_type").alias("event_type"), F.min("event_id").alias("event_id"))


_DISTINCT = _SEGMENTS + """, d AS (SELECT user_id, "start", max("end") AS "end", min(event_type) AS event_type, min(event_id) AS event_id FROM s GROUP BY 1, 2)"""


@query(f"""WITH {_DISTINCT}, b AS (SELECT *, lag(event_type) OVER w AS who, lag("end") OVER w AS before FROM d WINDOW w AS (PARTITION BY user_id ORDER BY "start", "end")),
 r AS (SELECT *, sum(CASE WHEN who = event_type AND round("start" - before, 9) <= 90000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS run FROM b)
 SELECT user_id, event_type, min("start") AS "start", max("end") AS "end", string_agg('t' || event_id, ' ' ORDER BY "start", "end") AS words, count(*) AS n_rows FROM r GROUP BY user_id, run, event_type""")
def joined_phrases(spark, sf_dir):
    d = _distinct(spark, sf_dir).withColumn("words", F.concat(F.lit("t"), F.col("event_id").cast("string")))
    return segments.join_adjacent(d, "user_id", "event_type", "words", 90000.0)


@query(f'WITH {_DISTINCT} SELECT event_id, coalesce(event_type = lag(event_type) OVER w AND event_id % 3 = lag(event_id % 3) OVER w, false) AS copied, coalesce(lag("end") OVER w, 0) AS extended_start, CAST(row_number() OVER w AS INT) AS phrase_id FROM d WINDOW w AS (PARTITION BY user_id ORDER BY "start", "end")')
def phrase_marks(spark, sf_dir):
    d = _distinct(spark, sf_dir).withColumn("words", (F.col("event_id") % 3).cast("string"))
    marked = segments.phrase_numbers(segments.extend_back(segments.copies_of_previous(d, "user_id", "event_type", "words"), "user_id"), "user_id")
    return marked.select("event_id", "copied", "extended_start", "phrase_id")


@query(f"""WITH {_DISTINCT}, z AS (SELECT user_id, "start" - 1600000000 AS a, "end" - 1600000000 AS b, event_type FROM d), t AS (SELECT user_id, event_type, round(sum(greatest(0, least(b, 110000000) - greatest(a, 0))), 6) AS spoken, min(a) AS f FROM z GROUP BY 1, 2),
 l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY spoken DESC, f, event_type) AS lead FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lead = 1, f, event_type) AS rest FROM l)
 SELECT user_id, event_type, CASE WHEN lead = 1 THEN 'Speaker 1' WHEN rest = 1 THEN 'Speaker 2' ELSE event_type END AS named FROM r""")
def early_speakers(spark, sf_dir):
    d = _distinct(spark, sf_dir).withColumn("start", F.col("start") - 1600000000).withColumn("end", F.col("end") - 1600000000)
    return segments.first_speakers(d, "user_id", "event_type", 110000000.0).select("user_id", "event_type", "named").distinct()


@query(f"""WITH {_DISTINCT}, b AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(event_type) OVER (PARTITION BY user_id ORDER BY "start", "end") AS was FROM d),
 i AS (SELECT *, sum(CASE WHEN before IS NULL OR "start" - before > 86400 OR was <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM b)
 SELECT user_id, event_type, min("start") AS "start", max("end") AS "end", count(*) AS n_rows FROM i GROUP BY user_id, island, event_type HAVING round(max("end") - min("start"), 9) >= 600""")
def labelled_islands(spark, sf_dir):
    return sequence.merge_islands(_distinct(spark, sf_dir), "user_id", "start", "end", 86400.0, "event_type", 600.0).drop("island")


@query(f'WITH {_SEGMENTS} SELECT event_id, round(floor("start" / 300 + 1e-9) * 300, 6) AS a, round(ceil("end" / 300 - 1e-9) * 300, 6) AS b FROM s')
def rounded_spans(spark, sf_dir):
    a, b = segments.round_out(F.col("start"), F.col("end"), 300.0)
    return _segments(spark, sf_dir).select("event_id", a.alias("a"), b.alias("b"))


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round((e[1] - list_avg(e)) / list_stddev_pop(e), 4) AS first, round((e[64] - list_avg(e)) / list_stddev_pop(e), 4) AS last FROM v")
def vector_cmvn(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("n", audio.normalised(F.col("embedding"))).select("vec_id", F.round(F.get("n", 0), 4).alias("first"), F.round(F.get("n", 63), 4).alias("last"))


@query("SELECT count(DISTINCT o_custkey) AS dialogs, count(*) AS rows, round(sum(o_orderkey % 100) / 3600.0, 6) AS hours FROM orders")
def report_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("seconds", (F.col("o_orderkey") % 100).cast("string"))
    return report.totals(o, "o_custkey", "seconds").withColumn("hours", F.round("hours", 6))


@query("SELECT l_shipmode AS phrase, count(*) AS n FROM lineitem WHERE l_shipmode <> '' GROUP BY 1 ORDER BY n DESC, phrase LIMIT 10".replace("l_shipmode", "l_returnflag"))
def top_report_phrases(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit(" - "), "l_returnflag", F.lit("; ")).alias("found"))
    return report.top_phrases(li, ["found"])


@query("""WITH m AS (SELECT CAST(o_orderstatus = 'F' AS INT) AS done, CAST(o_orderpriority = '1-URGENT' AS INT) AS "p_1-URGENT", CAST(o_orderpriority = '2-HIGH' AS INT) AS "p_2-HIGH" FROM orders)
 SELECT 'done' AS metric_a, 'p_1-URGENT' AS metric_b, round(corr(done, "p_1-URGENT"), 3) AS r FROM m UNION ALL SELECT 'done', 'p_2-HIGH', round(corr(done, "p_2-HIGH"), 3) FROM m UNION ALL SELECT 'p_1-URGENT', 'p_2-HIGH', round(corr("p_1-URGENT", "p_2-HIGH"), 3) FROM m""")
def dummy_correlations(spark, sf_dir):
    metrics = report.with_dummies({"done": F.col("o_orderstatus") == "F"}, {"p": (F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])})
    return report.correlations(table(spark, sf_dir, "orders"), metrics)


@query("""WITH p AS (SELECT p_name LIKE '%widget' AS t, p_size > 20 AS f FROM part), c AS (SELECT count(*) FILTER (WHERE t AND f) AS b, count(*) FILTER (WHERE t) AS t, count(*) FILTER (WHERE f) AS f FROM p)
 SELECT 'a' AS label, round(b / f, 6) AS precision, round(b / t, 6) AS recall, round(2 * b / (t + f), 6) AS f1, t AS support FROM c""")
def class_report(spark, sf_dir):
    name = lambda c: F.when(c, F.array(F.lit("a")))
    rows = table(spark, sf_dir, "part").select(name(F.col("p_name").like("%widget")).alias("t"), name(F.col("p_size") > 20).alias("f"))
    return report.classification(rows, F.col("t"), F.col("f"), ["a"])


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda t: lower(t) IN ('the', 'de', 'und', 'que')) AS h FROM documents WHERE text IS NOT NULL) SELECT doc_id, h[1] AS found FROM w""")
def first_name(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.first_hit(F.col("text"), ["The", "de", "UND", "que"]).alias("found"))


@query(r"""WITH h AS (SELECT conv_id, turn, list_filter([CASE WHEN regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])(?:of[^\p{L}\p{N}_]+the|in[^\p{L}\p{N}_]+the)(?:$|[^\p{L}\p{N}_])') THEN 'place' END, CASE WHEN regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])and(?:$|[^\p{L}\p{N}_])') THEN 'join' END], lambda x: x IS NOT NULL) AS h FROM conversations)
 SELECT conv_id, turn, CASE WHEN len(h) > 0 AND turn % 2 = 0 THEN array_to_string(h, ', ') END AS kinds FROM h""")
def gated_labels(spark, sf_dir):
    gate = F.when(F.col("turn") % 2 == 0, "x")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.labels_of(F.col("text"), {"place": ["of the", "in the"], "join": ["and"]}, gate).alias("kinds"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), 'th[a-z]{1,2}')), lambda x: x NOT IN ('the', 'tha'))), ', ') AS found FROM documents WHERE text IS NOT NULL")
def found_without(spark, sf_dir):
    hits = text.find_all(F.lower("text"), "th[a-z]{1,2}", 0, ["the", "tha"])
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.coalesce(F.array_join(hits, ", "), F.lit("")).alias("found"))


@query("SELECT event_id, printf('%02d:%02d', event_id // 60, event_id % 60) AS clock, printf('%.2f:%.2f: [%s] %s', event_id / 4, event_id / 2, event_type, 'x') AS line FROM events")
def line_formats(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", text.clock(i + 0.5).alias("clock"), text.row_line(i / 4, i / 2, F.col("event_type"), F.lit("x")).alias("line"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber * 1000000000000 + l_suppkey * 1000000 + CAST(l_quantity * 100 AS BIGINT) AS l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'back' WHEN l_linestatus = 'F' THEN 'done' END AS t FROM lineitem), m AS (SELECT l_orderkey, t, min(l_linenumber) AS i FROM t WHERE t IS NOT NULL GROUP BY 1, 2)
 SELECT l_orderkey, string_agg(t, ', ' ORDER BY i) AS topics FROM m GROUP BY 1""")
def dialog_themes(spark, sf_dir):
    at = F.col("l_linenumber") * F.lit(10**12) + F.col("l_suppkey") * F.lit(10**6) + (F.col("l_quantity") * 100).cast("long")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", at.alias("at"), F.when(F.col("l_returnflag") == "R", "Back to shop").when(F.col("l_linestatus") == "F", " done , other").otherwise("none").alias("theme"))
    return dialogs.theme_labels(li, "l_orderkey", "at", "theme", ["back", "done"], [("back", "back")]).select("l_orderkey", F.array_join("topics", ", ").alias("topics"))


@query("""WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, upper(left(w[1], 1)) || lower(substr(w[1], 2)) AS first, left(p_name, 8) || CASE WHEN length(p_name) > 8 THEN '…' ELSE '' END AS shown FROM (SELECT a.p_partkey, w, p_name FROM a JOIN part USING (p_partkey))""")
def first_tokens(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.capitalise(text.first_token(F.concat(F.lit("«"), "p_name"))).alias("first"), text.preview(F.col("p_name"), 8).alias("shown"))


@query("""WITH m AS (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS q FROM lineitem) SELECT CAST(quantile_cont(q, 0.05) AS DOUBLE) AS low, CAST(quantile_cont(q, 0.5) AS DOUBLE) AS middle, CAST(quantile_cont(q, 0.95) AS DOUBLE) AS high FROM m""")
def exact_quantile_places(spark, sf_dir):
    q = report.exact_quantiles(table(spark, sf_dir, "lineitem"), "l_quantity", [0.05, 0.5, 0.95])
    return spark.createDataFrame([tuple(q)], "low double, middle double, high double")


@query(r"""WITH c AS (SELECT conv_id, turn, regexp_split_to_array(trim(lower(text)), '[\s]+') AS w FROM conversations) SELECT conv_id, turn, CASE WHEN list_has_all(w, ['the', 'with']) THEN 'with the' WHEN list_has_all(w, ['of']) THEN 'of' END AS phrase FROM c""")
def subset_else_nearest(spark, sf_dir):
    """No pattern vector is near, so the subset decides."""
    rows = table(spark, sf_dir, "conversations")
    found = speakers.subset_or_nearest(F.lower("text"), ["with the", "of"], F.array(F.lit(1.0), F.lit(0.0)), {"with the": [0.0, 1.0], "of": [0.1, 1.0]})
    return rows.select("conv_id", "turn", found.alias("phrase"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT vec_id, list_cosine_similarity(e[1:2], [1.0, 0.0]) AS x, list_cosine_similarity(e[1:2], [0.0, 1.0]) AS y FROM v)
 SELECT vec_id, CASE WHEN x >= y AND x >= 0.9 THEN 'x' WHEN y > x AND y >= 0.9 THEN 'y' END AS pattern FROM s""")
def nearest_of_patterns(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", speakers.nearest_pattern(F.slice("embedding", 1, 2), {"x": [1.0, 0.0], "y": [0.0, 1.0]}, 0.9).alias("pattern"))
