"""Format-preserving pseudonyms for personal data.

What is found is validated first (Luhn's sum, calendar, octets, mod 97, number plans) and then permuted within its
format by a keyed Feistel network, so the pseudonym is valid too, equal values get equal pseudonyms in every document,
and who holds the key can invert it. Separators, letter case, country codes, a card's first digit and top-level domains stay. A
permutation that leaves the valid values is walked on until it is back among them, which keeps it one-to-one.

Kinds: ``card`` (13 to 19 digits, Luhn), ``phone`` (North American numbers keep to that plan, others keep whether they begin
with 0), ``ssn``, ``date``, ``ip``, ``iban``, ``email``, ``secret`` (values assigned to names such as token or api_key, whole, of any
length; after ``token``, ``secret`` or ``auth`` with a colon and no quote only if letters and digits mix, as prose has such colons).
Invalid look-alikes stay as they are. Digits are the ASCII ones.

Nulls: a null text stays null, with no finds. Repeated rows are kept. Columns other than the text keep their values and
places; the operator's own columns are ``n_pii`` and ``pii_kinds``, and an input column of that name is replaced, unless
``counts`` is off: then only the text changes. An empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import re
from bisect import bisect
from collections import Counter
from collections.abc import Callable
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, pieces

ROUNDS = 8
#: Most characters that are permuted as one number; longer values go in chained blocks.
BLOCK = 128
#: What the registered query and, where the session names none, the pipeline use: anybody knows it, so it protects nothing.
TEST_KEY, KEY_SETTING = b"a test key that everybody knows", "spark.utterline.pii.key"
_FIRST = datetime.date(1900, 1, 1).toordinal()
_LAST = datetime.date(2099, 12, 31).toordinal()
_HINT = re.compile("[0-9@]")
_NAMES = re.compile("(?i)token|secret|passw|key|auth")
_DIGITS = frozenset("0123456789")
_SEP = r"[ .\-]?"
_NUMBERS = re.compile(
    r"(?<![\w.+\-])(?:"
    r"(?P<phone>\+[0-9]{1,3}" + _SEP + r"(?:\([0-9]{1,4}\)" + _SEP + r")?[0-9]{1,4}(?:" + _SEP + r"[0-9]{2,4}){1,4}|\([0-9]{3}\)" + _SEP + r"[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}([.\-])[0-9]{3}\2[0-9]{4})"
    r"|(?P<date>[0-9]{4}([\-/.])[0-9]{1,2}\4[0-9]{1,2}|[0-9]{1,2}([\-/.])[0-9]{1,2}\5[0-9]{4})"
    r"|(?P<ip>[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})"
    r"|(?P<card>[0-9](?:[ \-]?[0-9]){12,18})"
    r")(?![\w]|[.\-][0-9])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w])")
_SECRET = re.compile(r"(?i)\b(?P<name>token|secret|passw(?:or)?d|api[_\-]?key|access[_\-]?key|auth)\b[\"']?\s{0,3}(?P<sign>[:=])\s{0,3}(?P<quote>[\"']?)(?P<value>[A-Za-z0-9_\-+/][A-Za-z0-9_\-+/.=~]{6,}[A-Za-z0-9_\-+/=~])")
#: Names after which a colon alone doesn't make a secret of a plain word.
_COMMON = ("token", "secret", "auth")


class Feistel:
    """A keyed permutation of [0, size): balanced rounds on the next power of four, walked until inside."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        size = -(-bits // 8)
        start = tweak + bytes([i, bits & 0xFF]) + half.to_bytes(max(64, size), "little")
        h = b"".join(blake2b(start + bytes(k), key=self.key, digest_size=64).digest() for k in range(-(-size // 64)))
        return int.from_bytes(h, "little") & ((1 << bits) - 1)

    def permute(self, x: int, size: int, tweak: bytes, inverse: bool = False) -> int:
        if size < 2:
            return x
        bits = -(-(size - 1).bit_length() // 2)
        mask = (1 << bits) - 1
        while True:
            a, b = x >> bits, x & mask
            if inverse:
                for i in reversed(range(ROUNDS)):
                    a, b = b ^ self._round(tweak, i, a, bits), a
            else:
                for i in range(ROUNDS):
                    a, b = b, a ^ self._round(tweak, i, b, bits)
            x = a << bits | b
            if x < size:
                return x


def luhn(digits: str) -> int:
    """The digit that completes ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _digits(shape: str) -> str:
    return "".join(c for c in shape if c in _DIGITS)


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in _DIGITS else c for c in shape)


class Pseudonyms:
    """``replace(text)`` gives the text with pseudonyms and the kinds found; ``restore`` inverts it."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()
        self.feistel = Feistel(self.key)

    def number(self, kind: str, digits: str, inverse: bool = False, like: Callable[[str], object] | None = None) -> str:
        """Digits to digits of the same count, of which ``like`` says the same as of these."""
        n, wanted = len(digits), like(digits) if like else None
        x = int(digits)
        while True:
            x = self.feistel.permute(x, 10**n, f"{kind}{n}".encode(), inverse)
            out = str(x).zfill(n)
            if like is None or like(out) == wanted:
                return out

    def letters(self, kind: str, text: str, inverse: bool = False) -> str:
        """Each ASCII letter or digit within its class; blocks of ``BLOCK`` characters, each after the pseudonym of the one before."""
        out, before = [], ""
        for at in range(0, len(text), BLOCK):
            part = text[at : at + BLOCK]
            out.append(self._letters(kind + (blake2b(before.encode(), digest_size=16).hexdigest() if at else ""), part, inverse))
            before = part if inverse else out[-1]
        return "".join(out)

    def _letters(self, kind: str, text: str, inverse: bool) -> str:
        """One block, as one number of mixed radix."""
        x, size, sets = 0, 1, []
        for c in text:
            s = "0123456789" if "0" <= c <= "9" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else None
            sets.append(s)
            if s:
                x, size = x * len(s) + s.index(c), size * len(s)
        x = self.feistel.permute(x, size, f"{kind}{size}".encode(), inverse)
        out = []
        for c, s in zip(reversed(text), reversed(sets), strict=True):
            if s:
                x, k = divmod(x, len(s))
                c = s[k]
            out.append(c)
        return "".join(reversed(out))

    def card(self, shape: str, inverse: bool = False) -> str | None:
        def whole(body: str) -> str:
            return digits[0] + body + str(luhn(digits[0] + body))

        digits = _digits(shape)
        if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        return _refill(shape, whole(self.number("card", digits[1:-1], inverse, lambda body: len(set(whole(body))) == 1)))

    def phone(self, shape: str, inverse: bool = False) -> str | None:
        digits = _digits(shape)
        if not (8 if shape[0] == "+" else 10) <= len(digits) <= 15:
            return None
        country = len(re.match(r"\+([0-9]{1,3})(?=[^0-9])|\+([0-9])|", shape)[0]) - 1 if shape[0] == "+" else 0
        own = digits[country:]
        american = len(own) == 10 and digits[:country] in ("", "1")
        return _refill(shape, digits[:country] + self.number("phone", own, inverse, (lambda d: d[0] > "1" and d[3] > "1") if american else (lambda d: d[0] == "0")))

    def ssn(self, shape: str, inverse: bool = False) -> str | None:
        def valid(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        digits = shape.replace("-", "")
        return _refill(shape, self.number("ssn", digits, inverse, valid)) if valid(digits) else None

    def ip(self, shape: str, inverse: bool = False) -> str | None:
        octets = shape.split(".")
        if any(int(o) > 255 or o != str(int(o)) for o in octets):
            return None
        x = self.feistel.permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, b"ip", inverse)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, shape: str, inverse: bool = False) -> str | None:
        parts = re.findall("[0-9]+", shape)
        sep = shape[len(parts[0])]
        if len(parts[0]) == 4:
            order = (0, 1, 2)
        else:  # day first, but for slashes where only month first is a date
            order = (2, 1, 0)
        for o in (order, (2, 0, 1)) if order[0] and sep == "/" else (order,):
            try:
                day = datetime.date(*(int(parts[i]) for i in o)).toordinal()
            except ValueError:
                continue
            if not _FIRST <= day <= _LAST:
                return None
            # the same calendar day is the same number in every format, but month-first dates must stay such
            x = day
            while True:
                x = self.feistel.permute(x - _FIRST, _LAST - _FIRST + 1, b"date", inverse) + _FIRST
                new = datetime.date.fromordinal(x)
                if o == order or new.day > 12:
                    break
            padded = all(len(parts[i]) == 2 for i in o[1:])
            values = dict(zip(o, (f"{new.year}", f"{new.month:02}" if padded else f"{new.month}", f"{new.day:02}" if padded else f"{new.day}"), strict=True))
            return sep.join(values[i] for i in range(3))
        return None

    def iban(self, shape: str, inverse: bool = False) -> str | None:
        plain = shape.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = self.letters("iban" + plain[:2], plain[4:], inverse)
        new = iter(plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02}" + body)
        return "".join(c if c == " " else next(new) for c in shape)

    def email(self, shape: str, inverse: bool = False) -> str:
        local, _, domain = shape.rpartition("@")
        name, _, top = domain.rpartition(".")
        return f"{self.letters('local', local, inverse)}@{self.letters('domain', name, inverse)}.{top}"

    def secret(self, shape: str, inverse: bool = False) -> str:
        return self.letters("secret", shape, inverse)

    def spans(self, text: str):
        """(start, end, kind) of candidates, by preference."""
        at = text.find("@")
        while at >= 0:
            start, domain = at, _DOMAIN.match(text, at + 1)
            while domain and start and text[start - 1] in _LOCAL:
                start -= 1
            if domain and start < at and text[start] != ".":
                yield start, domain.end(), "email"
            at = text.find("@", at + 1)
        for m in _SECRET.finditer(text):
            value = m["value"]
            plain = value.isalpha() or not any(c.isalpha() for c in value)
            if not (plain and m["name"].lower() in _COMMON and m["sign"] == ":" and not m["quote"]):
                yield *m.span("value"), "secret"
        for m in _IBAN.finditer(text):
            yield *m.span(), "iban"
        for m in _NUMBERS.finditer(text):
            yield *m.span(), m.lastgroup if m.lastgroup else next(k for k, v in m.groupdict().items() if v)

    def replace(self, text: str, inverse: bool = False) -> tuple[str, Counter]:
        kinds: Counter = Counter()
        if not _HINT.search(text) and not _NAMES.search(text):
            return text, kinds
        found, taken = [], []
        for start, end, kind in self.spans(text):
            at = bisect(taken, (start, end))
            if at and taken[at - 1][1] > start or at < len(taken) and taken[at][0] < end:
                continue
            if (new := getattr(self, kind)(text[start:end], inverse)) is not None:
                found.append((start, end, new))
                taken.insert(at, (start, end))
                kinds[kind] += 1
        out, at = [], 0
        for start, end, new in sorted(found):
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]), kinds


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def session_key(spark: SparkSession) -> bytes:
    """The key of the session's setting ``spark.utterline.pii.key``, else the test key."""
    return (spark.conf.get(KEY_SETTING, None) or TEST_KEY.decode()).encode()


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", inverse: bool = False, counts: bool = True) -> DataFrame:
    """The rows with pseudonyms in ``text``, and ``n_pii`` and ``pii_kinds`` (kind to count) behind the other columns if ``counts``."""
    from pyspark.sql import types as T

    if not key:
        raise ValueError("a key is needed: without one anybody inverts the pseudonyms")
    own = (docs.drop("n_pii", "pii_kinds") if counts else docs).withColumn(text, F.col(text).cast("string"))
    schema = T.StructType([*own.schema.fields, *([T.StructField("n_pii", T.LongType()), T.StructField("pii_kinds", T.MapType(T.StringType(), T.LongType()))] if counts else [])])

    def run(batches):
        p = Pseudonyms(key)
        for batch in batches:
            for piece in pieces(batch, text):
                new, kinds = [], []
                for t in piece.column(text).to_pylist():
                    t, k = (None, Counter()) if t is None else p.replace(t, inverse)
                    new.append(t)
                    kinds.append(sorted(k.items()))
                i = piece.schema.get_field_index(text)
                cols = [pa.array(new, pa.string()) if j == i else c for j, c in enumerate(piece.columns)]
                found = [pa.array([sum(v for _, v in k) for k in kinds], pa.int64()), pa.array(kinds, pa.map_(pa.string(), pa.int64()))] if counts else []
                yield pa.RecordBatch.from_arrays([*cols, *found], schema.names)

    return arrow_map(own, run, schema)
