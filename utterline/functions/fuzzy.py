"""Fuzzy phrase scores as Arrow-batched functions; equal texts of a batch are scored once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shipping import ship


def _lcs(a: str, masks: dict[str, int], width: int) -> int:
    """Length of the longest common subsequence with the string that ``masks`` describes, by bit-parallel rows."""
    s = (1 << width) - 1
    full = s
    for c in a:
        m = masks.get(c, 0)
        u = s & m
        s = ((s + u) | (s - u)) & full
    return bin(~s & full).count("1")


def partial_ratio(a: str, b: str, at_least: float = 0) -> float:
    """Best similarity (0 to 100, 2 * LCS over both lengths) of the shorter string with any stretch of the longer one of its length, edges included."""
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100.0
    n, best, masks = len(short), 0.0, {}
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    need, have, common = Counter(short), Counter(), 0
    for i in range(1 - n, len(long)):
        part = long[max(0, i) : i + n]
        if i + n <= len(long):
            c = long[i + n - 1]
            have[c] += 1
            common += have[c] <= need[c]
        if i > 0:
            c = long[i - 1]
            common -= have[c] <= need[c]
            have[c] -= 1
        # no more letters can agree than both have
        if 200 * common / (n + len(part)) > max(best, at_least - 1e-9):
            best = max(best, 200 * _lcs(part, masks, n) / (n + len(part)))
    return best


def _pieces(phrase: str, at_least: float) -> list[str]:
    """Pieces of which one stands whole in any text that scores ``at_least``: as many as edits are possible then, and one more."""
    edits = int(2 * len(phrase) * (100 - at_least) / at_least + 1e-9) if at_least > 0 else len(phrase)
    n = min(len(phrase), edits + 1)
    cuts = [len(phrase) * k // n for k in range(n + 1)]
    return [phrase[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] if n <= edits + 1 and edits < len(phrase) else []


def scores(phrase: str, texts: list[str], at_least: float) -> np.ndarray:
    """Partial ratios of a phrase with texts; 0 where one is surely under ``at_least``.

    Windows of all texts go through one bit-parallel pass: a 64-bit state for each window, a step for each of its characters. Between
    texts stand characters that match nothing, so windows over a text's edge need no care.
    """
    out, m = np.zeros(len(texts)), len(phrase)
    if not m:
        return out
    pieces = _pieces(phrase, at_least)
    open_ = [i for i, t in enumerate(texts) if t and (not pieces or len(t) < m or any(p in t for p in pieces))]
    rest = []
    for i in open_:
        if phrase in texts[i]:
            out[i] = 100.0
        elif len(texts[i]) < m or m > 64:
            out[i] = partial_ratio(phrase, texts[i], at_least)
        else:
            rest.append(i)
    for a in range(0, len(rest), 512):
        part = rest[a : a + 512]
        gap = "\0" * (m - 1)
        codes = np.frombuffer((gap + gap.join(texts[i] for i in part) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
        masks = np.zeros(len(codes), np.uint64)
        for c in set(phrase):
            masks[codes == ord(c)] = sum(1 << k for k, x in enumerate(phrase) if x == c)
        size = np.array([len(texts[i]) for i in part])
        begin = (m - 1) + np.cumsum(size + m - 1) - (size + m - 1)
        windows = size + m - 1
        first = np.cumsum(windows) - windows
        at = np.arange(windows.sum()) - np.repeat(first - (begin - m + 1), windows)
        real = np.minimum(at + m, np.repeat(begin + size, windows)) - np.maximum(at, np.repeat(begin, windows))
        full = np.uint64((1 << m) - 1)
        state = np.full(len(at), full, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(m):
                u = state & masks[at + k]
                state = ((state + u) | (state - u)) & full
        common = m - np.bitwise_count(state).astype(np.int64)
        out[part] = np.maximum.reduceat(200 * common / (m + real), first)
    return out


def _texts(found: pd.Series) -> tuple[list[str], dict]:
    known = list(dict.fromkeys(t for t in found if t is not None))
    return known, {t: i for i, t in enumerate(known)}


def best_phrase(text: Column, phrases: Iterable[str], threshold: float = 80) -> Column:
    """The phrase of the highest partial ratio, the first of equals; null under the threshold. Equal texts of a batch are scored once."""
    known = list(phrases)
    ship()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        own, at = _texts(texts)
        best, which = np.full(len(own), threshold - 1e-9), np.full(len(own), -1)
        for k, p in enumerate(known):
            s = scores(p, own, threshold)
            better = s > best
            best[better], which[better] = s[better], k
        return texts.map(lambda t: None if t is None or which[at[t]] < 0 else known[which[at[t]]])

    return run(text)


def first_phrase(text: Column, phrases: Iterable[str], threshold: float = 80) -> Column:
    """The first phrase, in the list's order, whose partial ratio reaches the threshold; null if none does."""
    known = list(phrases)
    ship()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        own, at = _texts(texts)
        which = np.full(len(own), -1)
        for k, p in enumerate(known):
            which[(which < 0) & (scores(p, own, threshold) >= threshold - 1e-9)] = k
        return texts.map(lambda t: None if t is None or which[at[t]] < 0 else known[which[at[t]]])

    return run(text)


def block_ratio(a: str, b: str) -> int:
    """Best similarity in whole per cents of the shorter string with the stretches of the longer one that its matching blocks point at."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0
    best = 0.0
    for block in SequenceMatcher(None, short, long).get_matching_blocks():
        at = max(block.b - block.a, 0)
        r = SequenceMatcher(None, short, long[at : at + len(short)]).ratio()
        if r > 0.995:
            return 100
        best = max(best, r)
    return int(round(100 * best))


def any_block_phrase(text: Column, phrases: Iterable[str], threshold: int = 97) -> Column:
    """Whether some phrase's block ratio reaches the threshold. Texts without a whole piece of a phrase can't and aren't compared."""
    known = [(p, _pieces(p, threshold - 0.5)) for p in phrases if p]
    ship()

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        own, at = _texts(texts)
        hit = [any((len(t) < len(p) or not pieces or any(x in t for x in pieces)) and block_ratio(p, t) >= threshold for p, pieces in known) for t in own]
        return texts.map(lambda t: t is not None and hit[at[t]])

    return run(text)


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: what two texts' sets of words share, against what only one has."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    n = len(" ".join(both))
    one, two = n + (n > 0) + len(left), n + (n > 0) + len(right)
    masks: dict[str, int] = {}
    for i, c in enumerate(left):
        masks[c] = masks.get(c, 0) | 1 << i
    apart = len(left) + len(right) - 2 * _lcs(right, masks, len(left))
    out = 100 - 100 * apart / (one + two)
    return max(out, 100 - 100 * (1 + len(left)) / (n + one), 100 - 100 * (1 + len(right)) / (n + two)) if n else out


def best_token_set(text: Column, phrases: Iterable[str], threshold: float = 95) -> Column:
    """The phrase of the highest token set ratio, the first of equals; null under the threshold."""
    known = list(phrases)
    ship()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def find(t):
            r = [token_set_ratio(p, t) for p in known] if t else []
            return known[int(np.argmax(r))] if r and max(r) >= threshold else None

        return texts.map(find)

    return run(text)
