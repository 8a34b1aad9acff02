"""All detectors over a table of rows: the criteria table of 24 columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy, text
from ..shipping import spread
from . import speakers

#: Columns of the criteria table, in order. Fixed values.
COLUMNS = ["dialog_criteria_id", "dialog_row_fk_id", "greeting_phrase", "found_name", "ongoing_sale", "working_hours", "interjections", "parasite_words", "abbreviations", "slang", "telling_name_phrases", "axis_attention",
           "inappropriate_phrases", "diminutives", "stop_words", "swear_words", "detected_speaker_id", "order_type", "non_professional_phrases", "order_offer", "order_processing", "order_resume", "await_requests", "await_requests_exit"]
#: Scores that fuzzy phrases need. Fixed values.
THRESHOLDS = {"greeting_phrase": 80, "telling_name_phrases": 80, "farewell_phrase": 80, "await_requests": 95, "await_requests_exit": 95, "axis_attention": 85, "ongoing_sale": 95, "working_hours": 95}


@dataclass(frozen=True)
class Lexicons:
    """What the detectors look for. An empty lexicon finds nothing; ``off`` names columns that stay empty."""

    fuzzy: Mapping[str, list[str]] = field(default_factory=dict)
    names: Iterable[str] = ()
    parasites: Iterable[str] = ()
    slang: Iterable[str] = ()
    slang_exclude: Iterable[str] = ()
    stop_words: Mapping[str, list[str]] = field(default_factory=dict)
    interjections: str = ""
    interjections_exclude: Iterable[str] = ()
    abbreviations: str = ""
    non_professional: str = ""
    inappropriate: Iterable[str] = ()
    swear: Iterable[str] = ()
    look_alikes: Mapping[str, str] = field(default_factory=dict)
    offer: Iterable[str] = ()
    processing: Iterable[str] = ()
    resume: Iterable[str] = ()
    order_types: Mapping[str, list[str]] = field(default_factory=dict)
    sales: Iterable[str] = ()
    off: Iterable[str] = ()
    analyse: Callable | None = None


def _joined(hits: Column) -> Column:
    return F.array_join(hits, ", ")


def detectors(low: Column, raw: Column, lexicons: Lexicons) -> dict[str, Column]:
    """Detector columns of normalised texts (``low``); ``raw`` is the text as it was, of which the kinds of order are found."""
    x, none = lexicons, F.lit(None).cast("string")
    found = {n: fuzzy.best_phrase(low, p, THRESHOLDS.get(n, 80)) for n, p in x.fuzzy.items()}
    found["found_name"] = F.coalesce(text.first_hit(low, x.names), F.lit(""))
    found["parasite_words"] = _joined(text.matched(low, x.parasites)) if x.parasites else none
    found["slang"] = _joined(text.matched(low, x.slang, x.slang_exclude)) if x.slang else none
    found["stop_words"] = _joined(text.matched(low, text.variants(x.stop_words))) if x.stop_words else none
    for name, pattern, exclude in (("interjections", x.interjections, x.interjections_exclude), ("abbreviations", x.abbreviations, ()), ("non_professional_phrases", x.non_professional, ())):
        found[name] = _joined(text.find_all(low, pattern, 0, exclude)) if pattern else none
    folded = text.norm_ru(low) if x.inappropriate else None
    found["inappropriate_phrases"] = _joined(text.ordered_tokens(folded, x.inappropriate)) if x.inappropriate else none
    found["swear_words"] = _joined(text.find_all(low, text.homoglyph_pattern([w.lower() for w in x.swear], x.look_alikes))) if x.swear else none
    found["diminutives"] = text.diminutives(low, x.analyse)
    for name, phrases in (("order_offer", x.offer), ("order_processing", x.processing), ("order_resume", x.resume)):
        found[name] = speakers.subset_or_nearest(low, phrases) if phrases else none
    found["order_type"] = text.labels_of(raw, x.order_types, F.col("order_resume")) if x.order_types else none
    return {n: none if n in set(x.off) else c for n, c in found.items()}


def criteria(rows: DataFrame, lexicons: Lexicons, key: str = "id", dialog: str = "dialog_id", order: str = "row_num", said: str = "row_text", speaker: str = "speaker_id") -> DataFrame:
    """The criteria table of ``rows``: COLUMNS, a row each. Rows of a small file are dealt to all cores first, as scores are Python's work."""
    rows = spread(rows.select(key, dialog, order, said, speaker), key).withColumn("_low", text.normalize(F.col(said)))
    found = detectors(F.col("_low"), F.col(said), lexicons)
    late = {n: found.pop(n) for n in ("order_type",)}
    rows = rows.withColumns({n: c for n, c in found.items()}).withColumns(late)
    sells = fuzzy.any_block_phrase(F.col("_low"), [p.lower() for p in lexicons.sales]) if lexicons.sales else F.lit(False)
    rows = rows.withColumn("_sells", sells)
    for n in COLUMNS:
        if n not in rows.columns and n not in ("dialog_criteria_id", "dialog_row_fk_id", "detected_speaker_id"):
            rows = rows.withColumn(n, F.lit(None).cast("string"))
    marked = speakers.detected(rows, dialog, order, speaker, F.col("_sells"), F.col("await_requests"), F.col("greeting_phrase"))
    return marked.withColumn("dialog_criteria_id", F.expr("uuid()")).withColumn("dialog_row_fk_id", F.col(key)).select(*COLUMNS)
