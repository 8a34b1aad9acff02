"""What a whole dialog says: names, who speaks, relabelled rows, and its summary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import answers
from ..functions import rules as R
from ..functions.text import capitalise, clean_line, collapse_space, first_token, phrases, present, truncate
from .report import any_flag, exact_quantiles, mode_nonempty, ordered_distinct, transcript

#: Labels that stand for the selling side. Fixed values.
SALES = ("SALES", "Speaker_1", "Speaker_2")


def names(rows: DataFrame, dialog: str, order: str, speaker: str, found: str, told: str, first: int = 3) -> DataFrame:
    """dialog, name_sales, name_client.

    The seller's name is the first one found in the seller's ``first`` rows beside a self-introduction; the client's is the first
    name found in any row that isn't the seller's, whatever its case. Null where there is none.
    """
    sells = F.coalesce(F.col(speaker).isin(*SALES), F.lit(False))
    r = rows.select(dialog, F.col(order).alias("_o"), first_token(F.when(present(F.col(found)), F.col(found))).alias("_name"), present(F.col(told)).alias("_told"),
                    F.sum(sells.cast("int")).over(W.partitionBy(dialog).orderBy(order).rowsBetween(W.unboundedPreceding, 0)).alias("_n"), sells.alias("_sells"))
    own = F.col("_sells") & (F.col("_n") <= first) & F.col("_told") & F.col("_name").isNotNull()
    r = r.withColumn("_sales", F.min(F.when(own, F.struct("_o", "_name"))).over(W.partitionBy(dialog))["_name"])
    other = F.col("_name").isNotNull() & (F.col("_sales").isNull() | (F.lower("_name") != F.lower("_sales")))
    per = r.groupBy(dialog).agg(F.first("_sales").alias("s"), F.min(F.when(other, F.struct("_o", "_name")))["_name"].alias("c"))
    return per.select(dialog, capitalise(F.col("s")).alias("name_sales"), capitalise(F.col("c")).alias("name_client"))


def waiting_relabel(rows: DataFrame, dialog: str, order: str, await_: Column, greeting: Column, judged: Column, after: int = 5) -> DataFrame:
    """Adds ``relabel``: CLIENT for judged rows while somebody waits, SALES for an unjudged row whose greeting ends the wait, else null.

    An await among judged rows starts the wait; a greeting ends it: in an unjudged row at once, in a judged one when ``order`` is
    over ``after``. A dialog that ends waiting keeps all its labels. What a row's state is follows from the last such event before
    it, so windows say it without a loop.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    start = yes(judged) & yes(await_)
    end = ~start & yes(greeting) & (~yes(judged) | (F.col(order) > after))
    w = W.partitionBy(dialog).orderBy(order)
    df = rows.withColumn("_e", F.when(start, 1).when(end, 0))
    before = yes(F.last("_e", True).over(w.rowsBetween(W.unboundedPreceding, -1)) == 1)
    closed = ~yes(F.last("_e", True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) == 1)
    label = F.when(closed & before & yes(judged) & F.col("_e").isNull(), "CLIENT").when(closed & before & ~yes(judged) & (F.col("_e") == 0), "SALES")
    return df.withColumn("relabel", label).drop("_e")


def summary(rows: DataFrame, dialog: str, order: str, speaker: str, criteria: Iterable[str] = (), modes: Iterable[str] = (), flags: Iterable[str] = (), first: Iterable[str] = (), all_speakers: Iterable[str] = (), items: Iterable[str] = ()) -> DataFrame:
    """One row for each dialog, a null dialog among them.

    rows_count; the ``first`` values in order; the most frequent non-empty value of ``modes``; whether any of ``flags``; of the
    ``criteria`` the distinct phrases of the selling side (``<c>_sales``), of ``all_speakers`` those of everybody (``<c>_all``), each in
    order of first appearance; arrays of ``items`` likewise, joined. One shuffle, on the dialog.
    """
    at, sells = F.col(order), F.col(speaker).isin(*SALES)
    blank = lambda c: F.when(present(F.col(c)), F.col(c))
    lists = lambda c: F.array_join(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("o"), F.col(c).alias("v")))), lambda r: r["v"]))), ", ")
    return rows.groupBy(dialog).agg(
        F.count("*").alias("rows_count"), *(F.min_by(c, at).alias(c) for c in first), *(mode_nonempty(F.col(c)).alias(c) for c in modes), *(any_flag(F.col(c)).alias(c) for c in flags),
        *(ordered_distinct(F.when(sells, blank(c)), at).alias(f"{c}_sales") for c in criteria), *(ordered_distinct(blank(c), at).alias(f"{c}_all") for c in all_speakers), *(lists(c).alias(c) for c in items))


def durations(rows: DataFrame, dialog: str, duration: str, order: str) -> DataFrame:
    """dialog, duration_sec: the dialog's own length, else from its first start to its last end."""
    own = F.min_by(F.col(duration).try_cast("double"), order)
    return rows.groupBy(dialog).agg(F.coalesce(own, F.max("end") - F.min("start")).alias("duration_sec"))


def relative_loudness(rows: DataFrame, dialog: str, speaker: str, loudness: str) -> DataFrame:
    """dialog, sales_loudness, quieter, louder: the selling side's mean, and whether it is at or beyond the 5th or 95th percentile of all dialogs' means."""
    means = rows.groupBy(dialog).agg(F.avg(F.when(F.col(speaker).isin(*SALES), F.col(loudness))).alias("sales_loudness"))
    low, high = (F.lit(q).cast("double") for q in exact_quantiles(means, "sales_loudness", [0.05, 0.95]))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return means.select(dialog, "sales_loudness", flag(F.col("sales_loudness") <= low).alias("quieter"), flag(F.col("sales_loudness") >= high).alias("louder"))


def topics(c: Column, known: Iterable[str], stems: Iterable[tuple[str, str]] = ()) -> Column:
    """Known topics of a comma-joined text, lower-case, in order, each once; a topic that starts with a stem becomes its label."""
    def one(t: Column) -> Column:
        t = F.translate(F.lower(F.trim(t)), "ё", "е")
        for stem, label in stems:
            t = F.when(t.startswith(stem), label).otherwise(t)
        return t

    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), one), lambda t: t.isin(*known)))


def theme_labels(rows: DataFrame, dialog: str, order: str, theme: str, known: Iterable[str], stems: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """dialog, topics: known topics of all rows, in order, each once; dialogs without one are left out."""
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), topics(F.col(theme), known, stems).alias("t")))), lambda r: r["t"]))
    return rows.groupBy(dialog).agg(F.array_distinct(ordered).alias("topics")).where(F.size("topics") > 0)


def training_set(rows: DataFrame, dialog: str, order: str, speaker: str | None, said: str, theme: str, known: Iterable[str], stems: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """dialog_id, text, topics, topics_csv: each labelled dialog's lines, blanks once, with the speaker before a colon."""
    need = [dialog, order, said, theme, *([speaker] if speaker else [])]
    if missing := sorted(set(need) - set(rows.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = rows.where(present(F.col(said)))
    words = collapse_space(F.col(said))
    line = F.when(present(F.col(speaker)), F.concat(F.trim(speaker), F.lit(": "), words)).otherwise(words) if speaker else words
    texts = rows.groupBy(F.col(dialog)).agg(transcript(line, F.col(order)).alias("text"))
    return texts.join(theme_labels(rows, dialog, order, theme, known, stems), dialog).select(F.col(dialog).cast("string").alias("dialog_id"), "text", "topics", F.array_join("topics", ", ").alias("topics_csv"))


#: Criteria whose phrases the report gives for the selling side, and those it gives for everybody. Fixed values.
SALES_CRITERIA = ["greeting_phrase", "found_name", "telling_name_phrases", "parasite_words", "stop_words", "interjections", "await_requests", "await_requests_exit", "working_hours", "inappropriate_phrases", "non_professional_phrases", "slang"]
ALL_CRITERIA = ["swear_words"]


def _split_distinct(value: Column, order: Column, keep: Column) -> Column:
    """Distinct phrases of the rows that ``keep`` holds for, in order of first appearance, joined."""
    rows = F.array_sort(F.collect_list(F.when(keep, F.struct(order.alias("o"), phrases(value).alias("v")))))
    return F.array_join(F.array_distinct(F.flatten(F.transform(rows, lambda r: r["v"]))), ", ")


def report_rows(rows: DataFrame, dialog: str = "dialog_id", order: str = "row_num", speaker: str = "speaker_id", answer: str = "llm_data_short") -> DataFrame:
    """The report's row for each dialog: 52 columns, the transcript and both names.

    ``rows`` have row_text, start, end, and what is known of theme, file_name, duration, mean_loudness and the criteria; missing
    columns are empty. Answers are read row by row, so a dialog's fields are the most frequent ones of its rows, as flags any.
    """
    known = set(rows.columns)
    for name in ("theme", "file_name", "duration", "mean_loudness", answer, *SALES_CRITERIA, *ALL_CRITERIA):
        if name not in known:
            rows = rows.withColumn(name, F.lit(None).cast("double" if name == "mean_loudness" else "string"))
    flat = answers.report_columns(F.col(answer))
    rows = rows.withColumns(flat)
    at, sells = F.col(order), F.coalesce(F.col(speaker).isin(*SALES), F.lit(False))
    mode = lambda c, allowed=None: F.coalesce(mode_nonempty(F.col(c).cast("string"), allowed), F.lit("")).alias(c)
    objection = any_flag(F.col("llm_obj_detected"))
    gated = lambda c, allowed: F.when(objection > 0, F.coalesce(mode_nonempty(F.col(c), allowed), F.lit(""))).otherwise("").alias(c)
    yes_no = [R.YES, R.NO]
    items = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("o"), F.col("llm_addon_items").alias("v")))), lambda r: r["v"])))
    theme = ordered_distinct(F.when(present(F.col("theme")) & ~F.lower(F.trim("theme")).isin("nan", "none", "null"), F.trim("theme")), at)
    line = F.concat_ws(": ", F.when(present(F.col(speaker)), F.col(speaker)), clean_line(F.coalesce("row_text", F.lit(""))))
    per = rows.groupBy(dialog).agg(
        theme.alias("theme"), F.coalesce(F.min_by("file_name", at), F.lit("")).alias("file_name"),
        F.coalesce(F.min_by(F.col("duration").try_cast("double"), at), F.max("end") - F.min("start")).alias("duration_sec"), F.count("*").alias("rows_count"),
        F.avg(F.when(sells, F.col("mean_loudness").try_cast("double"))).alias("_loud"),
        mode("llm_intent", R.INTENTS), mode("llm_category", R.CATEGORIES), mode("llm_category_detail"), mode("llm_tire_rim"), mode("llm_season_ru", list(R.SEASONS.values())), mode("llm_availability_ru", list(R.AVAILABILITY.values())),
        objection.alias("llm_obj_detected"), mode("llm_obj_detected_text", yes_no), gated("llm_obj_type_ru", list(R.OBJECTION_TYPE.values())), gated("llm_obj_status_ru", list(R.OBJECTION_STATUS.values())),
        *(x for n in ("ack", "sol", "check") for x in (any_flag(F.col(f"llm_obj_{n}")).alias(f"llm_obj_{n}"), mode(f"llm_obj_{n}_text", yes_no))),
        any_flag(F.col("llm_next_set")).alias("llm_next_set"), mode("llm_next_action"), mode("llm_next_datetime"), mode("llm_next_place"), mode("llm_next_owner_ru", list(R.OWNERS.values())), any_flag(F.col("llm_wrap_up")).alias("llm_wrap_up"),
        *(x for n in ("offered", "accepted") for x in (any_flag(F.col(f"llm_addon_{n}")).alias(f"llm_addon_{n}"), mode(f"llm_addon_{n}_text", yes_no))),
        F.array_join(items, ", ").alias("llm_addon_items"),
        *(_split_distinct(F.col(c), at, sells).alias(f"{c}_sales") for c in SALES_CRITERIA), *(_split_distinct(F.col(c), at, F.lit(True)).alias(f"{c}_all") for c in ALL_CRITERIA),
        truncate(transcript(line, at)).alias("dialog_text"))
    low, high = (F.lit(q).cast("double") for q in exact_quantiles(per, "_loud", [0.05, 0.95]))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    who = names(rows.withColumn("_found", F.col("found_name")), dialog, order, speaker, "_found", "telling_name_phrases").withColumnRenamed(dialog, "_dialog")
    long_enough = lambda c: F.when(F.char_length(c) >= 2, F.col(c))
    per = per.join(who, per[dialog].eqNullSafe(who["_dialog"]), "left").drop("_dialog")
    per = per.withColumns({"theme_class": R.theme_class(F.col("theme")), "sales_quieter_95_global": flag(F.col("_loud") <= low), "sales_louder_95_global": flag(F.col("_loud") >= high),
                           "named_self_sales": long_enough("name_sales"), "addressed_by_name_sales": long_enough("name_client"), "name_sales": F.coalesce("name_sales", F.lit("")), "name_client": F.coalesce("name_client", F.lit(""))})
    return per.drop("_loud").withColumnRenamed(dialog, "dialog_id").withColumn("dialog_id", F.col("dialog_id").cast("string"))
