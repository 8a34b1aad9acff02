"""Text normalisation and lexical detectors as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..shipping import ship

#: Spellings that become one before phrases are looked for, in this order.
SPELLINGS = [
    ("здрасте", "здравствуйте"),
    ("здрасьте", "здравствуйте"),
    ("здрась", "здравствуйте"),
    ("драсьте", "здравствуйте"),
    ("доброго дня", "добрый день"),
    ("добраго вечера", "добрый вечер"),
    ("всего хорошего", "всего доброго"),
    ("в общем-то", "в общем"),
    ("короче говоря", "короче"),
    ("типа того", "типа"),
    ("как-бы", "как бы"),
    ("т.е.", "то есть"),
    ("т.д.", "так далее"),
    ("т.п.", "тому подобное"),
]
#: Endings of diminutives and the least length of a word with them; what a recogniser adds; what a model puts before a theme.
DIMINUTIVES = [("ик", 5), ("чик", 6), ("к", 4), ("очк", 6), ("ечк", 6), ("оньк", 6), ("еньк", 6)]
BOILERPLATE = ["Продолжение следует...", "Субтитры сделал DimaTorzok"]
THEME_PREFIXES = ["Тема диалога - ", "Тема диалога: "]

#: Letters, digits and underscore, spelled out so that every regex engine agrees.
WORD = r"\p{L}\p{N}_"
_EDGE = f"(?:^|[^{WORD}])"


def present(c: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.trim(c), F.lit("")) != ""


def fold(c: Column) -> Column:
    """Lower case, trimmed, with the Cyrillic io folded."""
    return F.trim(F.translate(F.lower(c), "ё", "е"))


def replace_all(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements, in order."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def squeeze_repeats(c: Column) -> Column:
    """A word that follows itself twice or more, whatever its case and with blanks or , - – — . ? ! … between, stays twice. Twice over: nested runs settle."""
    for _ in range(2):
        c = F.regexp_replace(c, r"(?iU)\b(\w+)(?:[\s,\-–—.?!…]+\1\b){2,}", "$1 $1")
    return c


def squeeze_chars(c: Column) -> Column:
    """A word character that stands six times or more stays three times."""
    return F.regexp_replace(c, r"(?iU)(\w)\1{5,}", "$1$1$1")


def squeeze_chunks(c: Column) -> Column:
    """A word that is one chunk of two to ten letters four times or more keeps it twice."""
    return F.regexp_replace(c, r"(?iU)\b([a-zа-яё0-9]{2,10})\1{3,}\b", "$1$1")


def long_tokens(c: Column, cut: int = 40, drop: int = 80) -> Column:
    """Words over ``cut`` characters are cut with an ellipsis; those of ``drop`` and more go."""
    c = F.regexp_replace(c, rf"(?U)\b\w{{{drop},}}\b", "")
    return F.regexp_replace(c, rf"(?U)\b(\w{{{cut}}})\w{{1,{drop - cut - 1}}}\b", "$1…")


def clean_line(c: Column) -> Column:
    """A row's text as transcripts show it."""
    return long_tokens(squeeze_chunks(squeeze_chars(squeeze_repeats(F.trim(F.regexp_replace(c, r"\s+\n", "\n"))))))


def truncate(c: Column, most: int = 32767, marker: str = "\n...[TRUNCATED]", room: int = 20) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most - room), F.lit(marker))).otherwise(c)


def preview(c: Column, most: int = 1500, marker: str = "…") -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit(marker))).otherwise(c)


def phrases(c: Column, separators: str = r"[;,|/\\]+") -> Column:
    """Trimmed phrases between separators, without empty ones; none of a text that is ``nan``, ``none`` or two quotes."""
    whole = F.when(F.lower(F.trim(c)).isin("nan", "none", '""'), "").otherwise(F.coalesce(c, F.lit("")))
    parts = F.transform(F.split(whole, separators), lambda p: collapse_space(F.regexp_replace(p, "^[\\s\"'“”«»·–—-]+|[\\s\"'“”«»·–—-]+$", "")))
    return F.filter(parts, lambda p: p != "")


def capitalise(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def first_token(c: Column) -> Column:
    """What stands before the first blank or separator, without quotes and dashes around it."""
    edge = "^[\\s\"'“”«»·–—-]+|[\\s\"'“”«»·–—-]+$"
    return F.regexp_replace(F.get(F.split(F.regexp_replace(c, edge, ""), r"[\s,;/\\|]+"), 0), edge, "")


def has_word(c: Column, word: str) -> Column:
    """The word stands alone in the text; case counts."""
    return c.rlike(f"{_EDGE}{re.escape(word)}(?:$|[^{WORD}])")


def tokens(c: Column) -> Column:
    return F.split(c, f"[^{WORD}]+")


def _single(words: Iterable[str]) -> tuple[list[str], list[str]]:
    """Those that are one token, and the others."""
    words = sorted(set(words))
    one = [w for w in words if re.fullmatch(r"\w+", w)]
    return one, [w for w in words if not re.fullmatch(r"\w+", w)]


def matched(c: Column, lexicon: Iterable[str], exclude: Iterable[str] = (), as_listed: bool = False) -> Column:
    """Lexicon words that stand alone in the text, sorted, or in the lexicon's order if ``as_listed``; null if none.

    The text is cut into tokens once, and words of one token are looked up in a hash set, so a lexicon's size hardly matters;
    words with other signs are patterns of their own.
    """
    lexicon = list(lexicon)
    one, more = _single(set(lexicon) - set(exclude))
    hits = F.array_distinct(F.filter(tokens(c), lambda t: t.isin(one))) if one else F.array().cast("array<string>")
    if more:
        hits = F.array_union(hits, F.array_compact(F.array(*(F.when(has_word(c, w), F.lit(w)) for w in more))))
    return F.when(F.size(hits) > 0, F.array_intersect(F.array(*map(F.lit, lexicon)), hits) if as_listed else F.array_sort(hits))


def first_hit(c: Column, lexicon: Iterable[str]) -> Column:
    """The first token of the text, as it stands there, that is in the lexicon whatever its case; null if none. Lexicon words are single tokens."""
    known = sorted({w.lower() for w in lexicon})
    return F.get(F.filter(tokens(c), lambda t: F.lower(t).isin(known)), 0) if known else F.lit(None).cast("string")


def variants(bases: Mapping[str, Iterable[str]]) -> list[str]:
    """All variants of a lexicon of base words, in lower case."""
    return [v.lower() for own in bases.values() for v in own]


def full_phrase(c: Column, *phrases: str) -> Column:
    """The matched text of the first phrase found, words separated by anything but letters and digits; null if absent."""
    patterns = [r"\W+".join(found) for p in phrases if (found := re.findall(r"[A-Za-zА-Яа-яЁё0-9]+", p))]
    if not patterns:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_extract(c, rf"(?iU)(?<!\w)({'|'.join(patterns)})(?!\w)", 1), F.lit(""))


def labels_of(c: Column, kinds: Mapping[str, Iterable[str]], gate: Column | None = None) -> Column:
    """The kinds, in their order, of which a full phrase is found, joined; null if none, or where ``gate`` is blank."""
    hits = F.array_compact(F.array(*(F.when(full_phrase(F.lower(c), *own).isNotNull(), F.lit(k)) for k, own in kinds.items())))
    found = F.when(F.size(hits) > 0, F.array_join(hits, ", "))
    return found if gate is None else F.when(present(gate), found)


def ordered_tokens(c: Column, phrases: Iterable[str]) -> Column:
    """Phrases, in lexicon order, whose tokens occur one after another with gaps; null if none."""
    hits = F.array_compact(F.array(*(F.when(c.rlike("(?s)" + ".*".join(map(re.escape, p.split()))), F.lit(p)) for p in phrases)))
    return F.when(F.size(hits) > 0, hits)


def word_subset(words: Column, phrases: Iterable[str]) -> Column:
    """The first phrase all of whose words are among ``words``; null if none."""
    return F.coalesce(*(F.when(F.size(F.array_except(F.array(*map(F.lit, sorted(set(p.split())))), words)) == 0, F.lit(p)) for p in phrases), F.lit(None).cast("string"))


def homoglyph_pattern(words: Iterable[str], classes: Mapping[str, str]) -> str:
    """Words with each letter widened to its look-alikes, and any ending."""
    stems = "|".join("".join(f"[{re.escape(classes[ch])}]" if ch in classes else re.escape(ch) for ch in w) for w in words)
    return rf"(?<![{WORD}])((?:{stems})\p{{L}}*)"


def find_all(c: Column, pattern: str, group: int = 1, exclude: Iterable[str] = ()) -> Column:
    """Sorted distinct matches without ``exclude``; null if none."""
    hits = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)))
    hits = F.array_sort(F.array_except(hits, F.array(*map(F.lit, exclude))) if exclude else hits)
    return F.when(F.size(hits) > 0, hits)


def cascade(c: Column, rules: Iterable[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first rule whose pattern is found."""
    return F.coalesce(*(F.when(c.rlike(p), F.lit(label)) for p, label in rules), F.lit(default).cast("string"))


def clock(seconds: Column) -> Column:
    """Minutes and seconds; nothing is before 0."""
    whole = F.floor(F.greatest(F.lit(0), seconds))
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("int"), (whole % 60).cast("int"))


def without(c: Column, literals: Iterable[str]) -> Column:
    """The text without any of ``literals``, such as a recogniser's boilerplate."""
    for x in literals:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def normalize(c: Column) -> Column:
    """Lower case, with common spellings evened out, in order."""
    return replace_all(F.lower(c), SPELLINGS)


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def norm_ru(c: Column) -> Column:
    """Compatibility forms and case folded, Latin look-alikes as Cyrillic letters, dashes and signs as blanks, blanks once."""
    ship()
    folded = F.translate(F.replace(_folded(c), F.lit("ё"), F.lit("е")), "abcehkmoptxy", "авсенкмортху")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(folded, "[-–—]+", " "), r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))


def row_line(start: Column, end: Column, speaker: Column, said: Column) -> Column:
    return F.format_string("%.2f:%.2f: [%s] %s", start, end, speaker, said)


def theme_saved(c: Column, prefixes: Iterable[str] = THEME_PREFIXES) -> Column:
    """A model's theme without brackets, prefixes and hyphens, in lower case."""
    return F.lower(F.trim(F.replace(replace_all(without(c, "[]"), [(p, " ") for p in prefixes]), F.lit("-"), F.lit(""))))


def diminutives(c: Column, analyse: Callable[[str], tuple[str, bool]] | None = None, suffixes: Iterable[tuple[str, int]] = DIMINUTIVES, least: int = 5) -> Column:
    """Sorted words of ``least`` letters with a diminutive ending, joined; null if none.

    ``analyse`` gives a word's normal form and whether it is a name; a word that is its own normal form, or a name, isn't one.
    """
    ends = list(suffixes)
    ship()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, bool] = {}

        def is_one(w: str) -> bool:
            if w not in known:
                form, name = analyse(w) if analyse else ("", False)
                known[w] = form != w and not name
            return known[w]

        def find(t):
            words = {w for w in re.findall(r"\b[а-яё]+\b", (t or "").lower()) if len(w) >= least and any(w.endswith(e) and len(w) >= n for e, n in ends)}
            return ", ".join(sorted(w for w in words if is_one(w))) or None

        return texts.map(find)

    return run(c)


def names_by(c: Column, extract: Callable[[str], Iterable[str]], least: int = 3) -> Column:
    """Sorted distinct capitalised names that ``extract`` finds, joined; null if none. Texts without a capitalised word aren't asked about."""
    like = re.compile(rf"\b[A-ZА-ЯЁ][a-zа-яё]{{{max(least - 1, 0)},}}\b")
    ship()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: (", ".join(sorted({n for n in extract(t) if len(n) >= least and n[0].isupper()})) or None) if t and like.search(t) else None)

    return run(c)
