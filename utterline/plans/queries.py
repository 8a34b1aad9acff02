"""Registered queries: each operator family on the driver's tables, beside its SQL.

Segments come from ``events``: a user is a file, seconds are the time, ``value`` gives lengths. Lexicons are small and Latin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fuzzy, jsons, text
from ..operators import report, sequence, speakers
from ..shipping import spread
from .registry import query, table


@query("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL AND d.text IS NOT NULL AND d.text NOT IN ('', ' ')")
def unprocessed_anti_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.where(F.col("text").isNotNull() & ~F.col("text").isin("", " ")).join(labels, "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE c_name IS NOT NULL")
def report_three_way_join(spark, sf_dir):
    li, o, c = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    return li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey, "left").where(F.col("c_name").isNotNull()).select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def dialog_transcript(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(report.transcript(F.concat("role", F.lit(": "), "text"), F.col("turn")).alias("transcript"))


@query(r"""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript, count(*) AS n_rows, count(DISTINCT role) AS n_speakers,
 arg_min(role, turn) AS first_speaker, sum(CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])') THEN 1 ELSE 0 END) AS n_flagged FROM conversations GROUP BY conv_id""")
def dialog_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("flag", text.has_word(F.lower("text"), "the"))
    return rows.groupBy("conv_id").agg(
        report.transcript(F.concat("role", F.lit(": "), "text"), F.col("turn")).alias("transcript"), F.count("*").alias("n_rows"), F.countDistinct("role").alias("n_speakers"),
        F.min_by("role", "turn").alias("first_speaker"), F.sum(F.col("flag").cast("int")).alias("n_flagged"))


@query("SELECT conv_id, string_agg(role, ', ' ORDER BY t) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def ordered_distinct_join(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(report.ordered_distinct(F.col("role"), F.col("turn")).alias("roles"))


@query("SELECT c_nationkey, c_mktsegment AS mode_segment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)) WHERE r = 1")
def mode_nonempty(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(report.mode_nonempty(F.col("c_mktsegment")).alias("mode_segment"))


@query("""WITH m AS (SELECT user_id, round(avg(CAST(value AS DOUBLE)), 6) AS mean_value FROM events GROUP BY 1), q AS (SELECT quantile_cont(mean_value, 0.05) AS lo, quantile_cont(mean_value, 0.95) AS hi FROM m)
 SELECT user_id, mean_value, CAST(mean_value <= lo AS INT) AS quieter, CAST(mean_value >= hi AS INT) AS louder FROM m, q""")
def quantile_flags(spark, sf_dir):
    means = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg(F.col("value").cast("double")), 6).alias("mean_value"))
    low, high = report.exact_quantiles(means, "mean_value", [0.05, 0.95])
    return means.select("user_id", "mean_value", (F.col("mean_value") <= low).cast("int").alias("quieter"), (F.col("mean_value") >= high).cast("int").alias("louder"))


@query("SELECT count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS finished, round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END), 6) AS urgent FROM orders")
def rate_kpis(spark, sf_dir):
    return report.rates(table(spark, sf_dir, "orders"), {"finished": (F.col("o_orderstatus") == "F").cast("int"), "urgent": (F.col("o_orderpriority") == "1-URGENT").cast("int")})


@query("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 6) AS share FROM orders GROUP BY 1")
def value_share(spark, sf_dir):
    return report.shares(table(spark, sf_dir, "orders"), F.col("o_orderpriority"))


@query("SELECT c.criterion, sum(c.hit) AS n, round(avg(c.hit::DOUBLE), 6) AS share FROM (SELECT 'quality' AS criterion, quality AS hit FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) c GROUP BY 1")
def criteria_coverage(spark, sf_dir):
    return report.coverage(table(spark, sf_dir, "labels"), {}, {n: F.col(n) for n in ("quality", "toxic")})


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS o, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS a FROM lineitem GROUP BY 1, 2)
 SELECT l_linenumber, count(*) AS total, sum(o) AS offered, sum(a) AS accepted, round(count(*) / (SELECT count(DISTINCT l_orderkey) FROM lineitem)::DOUBLE, 6) AS share,
 round(CASE WHEN sum(o) = 0 THEN 0 ELSE sum(a) / sum(o)::DOUBLE END, 6) AS conversion FROM p GROUP BY 1 HAVING count(*) >= 2""")
def addon_funnel(spark, sf_dir):
    return report.funnel(table(spark, sf_dir, "lineitem"), "l_linenumber", F.col("l_returnflag") != "N", F.col("l_returnflag") == "R", "l_orderkey")


_CORR = """WITH m AS (SELECT CAST(l_returnflag = 'R' AS INT) AS returned, CAST(l_linestatus = 'O' AS INT) AS open, CAST(l_linenumber = 1 AS INT) AS first, CAST(l_quantity > 25 AS INT) AS large FROM lineitem),
 p AS (SELECT 'returned' AS metric_a, 'open' AS metric_b, round(corr(returned, open), 3) AS r FROM m UNION ALL SELECT 'returned', 'first', round(corr(returned, first), 3) FROM m UNION ALL SELECT 'returned', 'large', round(corr(returned, large), 3) FROM m
 UNION ALL SELECT 'open', 'first', round(corr(open, first), 3) FROM m UNION ALL SELECT 'open', 'large', round(corr(open, large), 3) FROM m UNION ALL SELECT 'first', 'large', round(corr(first, large), 3) FROM m)
 SELECT metric_a, metric_b, r FROM p"""


@query(_CORR)
def corr_matrix(spark, sf_dir):
    metrics = {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O", "first": F.col("l_linenumber") == 1, "large": F.col("l_quantity") > 25}
    return report.correlations(table(spark, sf_dir, "lineitem"), metrics)


@query(_CORR + " WHERE r IS NOT NULL ORDER BY abs(r) DESC, metric_a, metric_b LIMIT 3")
def top_pairs(spark, sf_dir):
    return report.most_correlated(corr_matrix(spark, sf_dir), 3).drop("line")


@query(r"SELECT phrase, count(*) AS n FROM (SELECT trim(unnest(regexp_split_to_array(l_comment, ' +'))) AS phrase FROM part) WHERE phrase <> '' GROUP BY 1 ORDER BY n DESC, phrase LIMIT 10".replace("l_comment", "p_type || ' ' || p_brand"))
def top_phrases(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.concat_ws(" ", "p_type", "p_brand"), " +")).alias("phrase")).where("phrase <> ''")
    return words.groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(10)


@query("SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS finished_rate, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS open_count FROM orders GROUP BY 1")
def group_rate_by_intent(spark, sf_dir):
    return report.grouped_rates(table(spark, sf_dir, "orders"), "o_orderpriority", {"finished_rate": F.col("o_orderstatus") == "F"}, {"open_count": (F.col("o_orderstatus") == "O").cast("int")})


@query("""WITH t AS (SELECT conv_id, turn, role, regexp_extract(text, '[A-Za-z]+', 0) AS w, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations)
 SELECT conv_id, upper(left(arg_min(CASE WHEN role = 'assistant' AND r <= 3 THEN w END, turn), 1)) || lower(substr(arg_min(CASE WHEN role = 'assistant' AND r <= 3 THEN w END, turn), 2)) AS name_sales FROM t WHERE w <> '' GROUP BY 1""")
def name_attribution(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.regexp_extract("text", "[A-Za-z]+", 0).alias("w"), F.row_number().over(W.partitionBy("conv_id", "role").orderBy("turn")).alias("r"))
    own = F.when((F.col("role") == "assistant") & (F.col("r") <= 3), F.col("w"))
    name = F.min_by(own, F.when(own.isNotNull(), F.col("turn")))
    return rows.where("w <> ''").groupBy("conv_id").agg(name.alias("n")).select("conv_id", text.capitalise(F.col("n")).alias("name_sales"))


@query("""WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id % 7 = 0 AS a, event_id % 5 = 1 AS g FROM events),
 f AS (SELECT *, max(CASE WHEN a THEN n END) OVER p AS pa, max(CASE WHEN g THEN n END) OVER p AS pg, min(CASE WHEN a THEN n END) OVER q AS fa, min(CASE WHEN g THEN n END) OVER q AS fg FROM e
  WINDOW p AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
 SELECT user_id, event_id FROM f WHERE NOT a AND NOT g AND pa IS NOT NULL AND fg IS NOT NULL AND (pg IS NULL OR pg <= pa) AND (fa IS NULL OR fa >= fg) AND fg - pa - 1 > 1 AND fg - pa - 1 <= 5""")
def await_relabel(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return sequence.await_relabel(e, "user_id", "o", F.col("event_id") % 7 == 0, F.col("event_id") % 5 == 1).where("should_be_client").select("user_id", "event_id")


def _segments(spark, sf_dir) -> DataFrame:
    s = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", s.alias("start"), F.round(s + F.abs(F.col("value").cast("double")) * 60, 3).alias("end"))


_SEGMENTS = "s AS (SELECT event_id, user_id, event_type, floor(epoch(ts)) AS \"start\", round(floor(epoch(ts)) + abs(CAST(value AS DOUBLE)) * 60, 3) AS \"end\" FROM events)"


@query(f"""WITH {_SEGMENTS}, b AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
 i AS (SELECT *, sum(CASE WHEN before IS NULL OR "start" - before > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "start", "end", event_id ROWS UNBOUNDED PRECEDING) AS island FROM b)
 SELECT user_id, CAST(island AS BIGINT) AS island, min("start") AS "start", max("end") AS "end", count(*) AS n_rows FROM i GROUP BY 1, 2""")
def segment_islands(spark, sf_dir):
    return sequence.merge_islands(_segments(spark, sf_dir), "user_id", "start", "end", 3600).select("user_id", "island", "start", "end", "n_rows")


@query(f"""WITH {_SEGMENTS}, c AS (SELECT *, CAST(greatest(0, floor(("end" - "start" - 60) / 300 + 1e-6) + 1) AS INT) AS k FROM s)
 SELECT event_id, CAST(w AS INT) AS "window", round("start" + w * 300, 6) AS window_start, round(least("end", "start" + w * 300 + 600), 6) AS window_end FROM (SELECT *, unnest(range(0, k)) AS w FROM c)""")
def sliding_windows(spark, sf_dir):
    return sequence.sliding_windows(_segments(spark, sf_dir), "start", "end", 600.0, 300.0, 60.0).select("event_id", "window", "window_start", "window_end")


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = _segments(spark, sf_dir)
    return s.where("event_id % 2 = 0"), s.where("event_id % 2 = 1").withColumnRenamed("event_type", "speaker")


_OVERLAPS = _SEGMENTS + """, o AS (SELECT a.user_id, a.event_id, b.event_type AS speaker, b."start" AS bs, round(least(a."end", b."end") - greatest(a."start", b."start"), 6) AS ov
 FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND a."start" < b."end" AND b."start" < a."end")"""


@query(f"WITH {_OVERLAPS} SELECT user_id, event_id, speaker FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY ov DESC, bs, speaker) AS r FROM o) WHERE r = 1")
def overlap_speaker(spark, sf_dir):
    return sequence.overlap_speaker(*_sides(spark, sf_dir), "user_id", "event_id")


@query(f"""WITH {_OVERLAPS} SELECT user_id, event_id, speaker, total FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY total DESC, speaker) AS r
 FROM (SELECT user_id, event_id, speaker, round(sum(ov), 6) AS total FROM o GROUP BY 1, 2, 3)) WHERE r = 1""")
def overlap_vote(spark, sf_dir):
    return sequence.overlap_vote(*_sides(spark, sf_dir), "user_id", "event_id")


@query(f"""WITH {_SEGMENTS}, d AS (SELECT user_id, "start", max("end") AS "end" FROM s GROUP BY 1, 2)
 SELECT user_id, "start", least("start", greatest(0, coalesce(lag("end") OVER w, 0), "start" - 120)) AS padded_start, greatest("end", least(coalesce(lead("start") OVER w, 1e300), "end" + 180)) AS padded_end FROM d WINDOW w AS (PARTITION BY user_id ORDER BY "start", "end")""")
def padding_neighbours(spark, sf_dir):
    d = _segments(spark, sf_dir).groupBy("user_id", "start").agg(F.max("end").alias("end"))
    return sequence.padded(d, "user_id", 120.0, 180.0).select("user_id", "start", "padded_start", "padded_end")


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 c AS (SELECT a.user_id, a.event_id, b.event_type, count(*) AS k FROM e a JOIN e b ON a.user_id = b.user_id AND b.n BETWEEN a.n - 1 AND a.n + 1 GROUP BY 1, 2, 3)
 SELECT user_id, event_id, event_type AS label FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY k DESC, event_type) AS r FROM c) WHERE r = 1""")
def majority_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", sequence.majority(F.col("event_type"), "user_id", "event_id").alias("label"))


@query(f'WITH {_SEGMENTS} SELECT user_id, event_type, count(*) AS n, round(sum(greatest(0, "end" - "start")), 3) AS seconds FROM s GROUP BY 1, 2')
def speaker_totals(spark, sf_dir):
    return report.speaker_totals(_segments(spark, sf_dir), "user_id", "event_type")


@query("SELECT user_id, count(*) AS usage_count, max(ts) AS last_used FROM events GROUP BY 1")
def usage_stats(spark, sf_dir):
    return report.usage(table(spark, sf_dir, "events"), "user_id", "ts")


_LEXICON = ["and", "de", "das", "los", "the", "with"]
_HAS = lambda w: rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])')"


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_HAS(w)} THEN '{w}' END" for w in _LEXICON) + "], lambda x: x IS NOT NULL), ', ') AS found FROM documents WHERE text IS NOT NULL")
def exact_lexicon(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.coalesce(F.array_join(text.matched(F.lower("text"), _LEXICON, as_listed=True), ", "), F.lit("")).alias("found"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), '(?s)the.*with.*and') THEN 'the with and' END, CASE WHEN regexp_matches(lower(text), '(?s)de.*la.*en') THEN 'de la en' END], lambda x: x IS NOT NULL), ', ') AS found FROM documents WHERE text IS NOT NULL")
def ordered_token_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.coalesce(F.array_join(text.ordered_tokens(F.lower("text"), ["the with and", "de la en"]), ", "), F.lit("")).alias("found"))


@query("""WITH w AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS w FROM conversations)
 SELECT conv_id, turn, CASE WHEN list_has_all(w, ['the', 'with']) THEN 'with the' WHEN list_has_all(w, ['of', 'to']) THEN 'to of' END AS phrase FROM w""")
def word_subset_match(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.word_subset(F.split(F.lower("text"), " "), ["with the", "to of"]).alias("phrase"))


@query(r"SELECT doc_id, nullif(regexp_extract(lower(text), '(?:^|[^\p{L}\p{N}_])(of[^\p{L}\p{N}_]+the)(?:$|[^\p{L}\p{N}_])', 1), '') AS phrase FROM documents")
def fullword_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.full_phrase(F.lower("text"), "of the").alias("phrase"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '(?:^|[^\p{L}\p{N}_])([i1!][d][i1!][o0][t]\p{L}*|[t][r][a4@][s5$][h]\p{L}*)', 1))), ', ') AS found FROM documents WHERE text IS NOT NULL")
def swear_homoglyph(spark, sf_dir):
    pattern = text.homoglyph_pattern(["idiot", "trash"], {"i": "i1!", "o": "o0", "a": "a4@", "s": "s5$"})
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.coalesce(F.array_join(text.find_all(F.lower("text"), pattern), ", "), F.lit("")).alias("found"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, 'License') THEN 'license' WHEN regexp_matches(text, '@') THEN 'contact' WHEN regexp_matches(text, '[0-9]{4}') THEN 'number' ELSE 'other' END AS label FROM documents WHERE text IS NOT NULL")
def rule_cascade_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.cascade(F.col("text"), [("License", "license"), ("@", "contact"), ("[0-9]{4}", "number")], "other").alias("label"))


@query(r"""WITH p AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS x FROM (SELECT doc_id, regexp_split_to_array(text, '[;,|/\\]+') AS a FROM documents WHERE text IS NOT NULL)),
 c AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(x, '^[\s"''“”«»·–—-]+|[\s"''“”«»·–—-]+$', '', 'g'), '\s+', ' ', 'g')) AS v FROM p)
 SELECT doc_id, count(*) AS n_phrases, string_agg(v, '|' ORDER BY i) AS phrases FROM c WHERE v <> '' GROUP BY 1""")
def phrase_split(spark, sf_dir):
    found = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.phrases(F.col("text")).alias("p")).where(F.size("p") > 0)
    return found.select("doc_id", F.size("p").cast("long").alias("n_phrases"), F.array_join("p", "|").alias("phrases"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(replace(lower(html), '&nbsp;', ' '), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM pages WHERE html IS NOT NULL")
def text_clean(spark, sf_dir):
    html = F.regexp_replace(F.replace(F.lower("html"), F.lit("&nbsp;"), F.lit(" ")), "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", text.collapse_space(html).alias("clean"))


@query()
def text_clean_repeat(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.truncate(text.clean_line(F.col("text"))).alias("clean"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, CAST(CAST(props->>'k' AS BIGINT) > 50 AS INT) AS high FROM events WHERE props IS NOT NULL")
def json_flatten(spark, sf_dir):
    k = F.from_json("props", "k BIGINT")["k"]
    return table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", k.alias("k"), (k > 50).cast("int").alias("high"))


@query("""SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN event_id ELSE CAST(props->>'k' AS BIGINT) END AS VARCHAR) AS k, event_type AS kind FROM events WHERE props IS NOT NULL""")
def json_shallow_merge(spark, sf_dir):
    new = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_id").alias("k"), F.col("event_type").alias("kind")))).otherwise(F.to_json(F.struct(F.col("event_type").alias("kind"))))
    return table(spark, sf_dir, "events").where("props IS NOT NULL").withColumn("m", jsons.shallow_merge(F.col("props"), new)).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["kind"].alias("kind"))


@query("""WITH p AS (SELECT vec_id AS pid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id < 8)
 SELECT vec_id, pid AS pattern_id, round(sim, 5) AS sim FROM (SELECT v.vec_id, p.pid, list_cosine_similarity(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE)), p.e) AS sim,
 row_number() OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE)), p.e) DESC, p.pid) AS r FROM embeddings v, p) WHERE r = 1""")
def cosine_top1(spark, sf_dir):
    """Each vector against a lexicon of eight pattern vectors, a stated set."""
    v = table(spark, sf_dir, "embeddings")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    p = F.broadcast(v.where("vec_id < 8").select(F.collect_list(F.struct(F.col("vec_id").alias("pid"), F.col("embedding").alias("e"))).over(W.partitionBy()).alias("ps")).limit(1))
    sims = F.transform("ps", lambda x: F.struct((dot(F.col("embedding"), x["e"]) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(x["e"], x["e"]))).alias("sim"), (-x["pid"]).alias("n")))
    return v.join(p).select("vec_id", F.array_max(sims).alias("b")).select("vec_id", (-F.col("b.n")).alias("pattern_id"), F.round("b.sim", 5).alias("sim"))


@query("""WITH s AS (SELECT conv_id, role, sum(CASE WHEN lower(text) LIKE '%ing%' THEN 1 ELSE 0 END - CASE WHEN lower(text) LIKE '%you%' THEN 1 ELSE 0 END) AS score, min(CASE WHEN lower(text) LIKE '%ing%' THEN turn END) AS sold, min(CASE WHEN lower(text) LIKE '%you%' THEN turn END) AS bought FROM conversations GROUP BY 1, 2),
 f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, sold NULLS LAST, bought NULLS LAST, role) AS r FROM s WHERE sold IS NOT NULL OR bought IS NOT NULL)
 SELECT c.conv_id, c.turn, CASE WHEN f.role IS NULL THEN c.role WHEN c.role = f.role THEN 'SALES' ELSE 'CLIENT' END AS speaker FROM conversations c LEFT JOIN f ON f.conv_id = c.conv_id AND r = 1""")
def speaker_score_role(spark, sf_dir):
    t = F.lower("text")
    return speakers.by_score(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", t.contains("ing"), t.contains("you")).select("conv_id", "turn", F.col("role").alias("speaker"))


@query("""SELECT count(*) AS total, count(l.doc_id) AS processed, count(*) - count(l.doc_id) AS pending, round(100 * count(l.doc_id) / count(*)::DOUBLE, 4) AS coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def status_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("l")), "doc_id", "left")
    return report.stage_counts(d, F.col("l").isNotNull())


@query("""WITH s AS (SELECT l.quality AS y, least(1.0, d.n_chars / 4000.0) AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id), t AS (SELECT unnest(range(0, 17)) AS k),
 f AS (SELECT round(0.1 + 0.05 * k, 2) AS threshold, 2 * sum(CASE WHEN p >= 0.1 + 0.05 * k AND y = 1 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN p >= 0.1 + 0.05 * k THEN 1 ELSE 0 END) + sum(y), 0)::DOUBLE AS f1 FROM s, t GROUP BY k)
 SELECT CAST(threshold AS DOUBLE) AS threshold, round(f1, 6) AS f1 FROM f""")
def threshold_search_f1(spark, sf_dir):
    """F1 at seventeen thresholds in one aggregation of the scores."""
    s = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("quality").alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("p"))
    return report.threshold_f1(s, F.col("p"), F.col("y"), [round(0.1 + 0.05 * k, 2) for k in range(17)])


@query("SELECT user_id, count(*) AS n, round(avg(v), 6) AS mean, max(v) AS most, min(v) AS least, round(stddev_pop(v), 6) AS deviation, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.25), 6) AS p25 FROM (SELECT user_id, CAST(value AS DOUBLE) AS v FROM events) GROUP BY 1")
def loudness_stats(spark, sf_dir):
    return report.level_stats(table(spark, sf_dir, "events"), "user_id", F.col("value").cast("double")).select("user_id", "n", "mean", "most", "least", "deviation", "p95", "p25")


@query()
def fuzzy_phrase(spark, sf_dir):
    greetings = ["hello and welcome", "good morning", "how can i help", "thank you for calling"]
    rows = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    return rows.select("conv_id", "turn", fuzzy.best_phrase(F.lower("text"), greetings, 60).alias("greeting"))


@query()
def json_repair(spark, sf_dir):
    broken = F.concat(F.lit("Answer:\n```json\n"), F.replace("props", F.lit('"'), F.lit("'")), F.lit(",\n```"))
    return spread(table(spark, sf_dir, "events").select("event_id", "props"), "event_id").select("event_id", jsons.repair(broken).alias("fixed"))


@query()
def viterbi_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 3 / 3).alias("a"), (F.col("event_id") % 5 / 5).alias("b"))
    return sequence.viterbi(e, "user_id", "event_id", ["a", "b"])
