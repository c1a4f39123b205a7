"""Operator 3, PII: format-preserving Feistel pseudonyms for validated numbers, dates, addresses and secrets."""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable
from functools import cache, lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.tables import HIDDEN, q, read

ROUNDS = 8
#: Stands in where no key is given, so that runs agree; production passes its own, from its secret store.
DEMO_KEY = b"palimpsest demonstration key"
_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_DATES = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal() + 1)

#: Countries by the length of their IBANs, for those written in groups of four.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_GROUPED = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?:(?P=by)[0-9A-Z]{{4}}){{{n // 4 - 1}}}" + (f"(?P=by)[0-9A-Z]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())

PATTERN = re.compile(
    rf"""(?P<email>(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
    |(?P<secret>(?<![0-9A-Za-z_-])(?:AKIA[0-9A-Z]{{16}}|gh[opsu]_[0-9A-Za-z]{{36}}|sk-[0-9A-Za-z]{{20,}}|(?=[0-9a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{{24,}}|(?=[0-9A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{{24,}})(?![0-9A-Za-z]))
    |(?P<iban>(?<![0-9A-Za-z])(?:[A-Z]{{2}}[0-9]{{2}}[0-9A-Z]{{11,30}}|(?=[A-Z]{{2}}[0-9]{{2}}(?P<by>[ -])[0-9A-Z]{{4}}(?P=by))(?:{_GROUPED}))(?![0-9A-Za-z]))
    |(?P<date>(?<![0-9.,/-])(?:[0-9]{{4}}(?P<sep>[-/.])[0-9]{{1,2}}(?P=sep)[0-9]{{1,2}}|[0-9]{{1,2}}(?P<sep2>[-/.])[0-9]{{1,2}}(?P=sep2)[0-9]{{4}})(?![0-9/-]|\.[0-9]))
    |(?P<ip>(?<![0-9.])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?!\.?[0-9]))
    |(?P<ssn>(?<![0-9-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9-]))
    |(?P<number>(?<![0-9.])(?:[0-9]{{12,19}}|[0-9]{{4}}(?P<gap>[ -])[0-9]{{4}}(?:(?P=gap)[0-9]{{4}}){{1,2}}(?:(?P=gap)[0-9]{{1,3}})?|[0-9]{{4}}(?P<gap2>[ -])[0-9]{{6}}(?P=gap2)[0-9]{{4,5}})(?![0-9]))
    |(?P<phone>(?<![0-9+.])(?:\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})(?:[ .-]?[0-9]{{2,4}}){{2,4}}|\([0-9]{{3}}\)[ ]?[0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{3}}(?P<dot>[ .-]?)[0-9]{{3}}(?P=dot)[0-9]{{4}}|0[0-9](?P<two>[ .-])[0-9]{{2}}(?:(?P=two)[0-9]{{2}}){{3}})(?![0-9]))""",
    re.VERBOSE,
)
#: A superset of PATTERN, for rows without a match never to leave the JVM. Each branch of PATTERN implies one of these: e-mail the @;
#: secrets and IBANs their heads or runs; dates and IPv4 addresses two digits around a sign; other numbers three digits in
#: a row; telephone numbers those, a plus before a digit or pairs of digits from a 0 on. A branch added to PATTERN must have its part here.
MAYBE = r"@|[0-9]{3}|0[0-9] [0-9]{2} |[0-9][./-][0-9]|\+[0-9]|[A-Z]{2}[0-9]{2}|AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20}|[0-9a-f]{24}|[0-9A-F]{24}"


class Cipher:
    """Keyed permutations of [0, n) for any n: a generalised Feistel network on a * b >= n, walked until the value lies within."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, tweak: str, n: int, i: int, x: int, modulus: int) -> int:
        size = (modulus.bit_length() + 7) // 8 + 8  # 64 bits more than needed: no bias to speak of
        out = b""
        while len(out) < size:
            out += hashlib.blake2b(f"{tweak}|{n}|{i}|{len(out)}|{x}".encode(), key=self.key, digest_size=32).digest()
        return int.from_bytes(out[:size], "big") % modulus

    def _once(self, tweak: str, n: int, a: int, b: int, x: int, back: bool) -> int:
        left, right = divmod(x, b)
        for i in range(ROUNDS) if not back else range(ROUNDS - 1, -1, -1):
            sign = -1 if back else 1
            if i % 2 == 0:
                left = (left + sign * self._f(tweak, n, i, right, a)) % a
            else:
                right = (right + sign * self._f(tweak, n, i, left, b)) % b
        return left * b + right

    def permute(self, tweak: str, n: int, x: int, ok: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """The image of x among those values below n that ``ok`` accepts; x itself must be one."""
        if n < 2:
            return x
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            x = self._once(tweak, n, a, b, x, back)
            if x < n and ok(x):
                return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _like(shape: str, chars: str) -> str:
    """``chars`` in the places of the ASCII letters and digits of ``shape``."""
    it = iter(chars)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in shape)


@lru_cache(maxsize=4096)
def _letters(c: str) -> tuple[str, int]:
    """The letters and digits that may stand for the non-ASCII letter or digit ``c``, in the case of lower letters if they have both, and its place among them.

    They are those of its 256 code points and kind, so that a text in one script stays in it.
    """
    both = lambda x: len(x.upper()) == 1 and x.upper() != x and x.upper().lower() == x and x.upper().isalnum()
    fold = lambda x: x.lower() if len(x.lower()) == 1 and both(x.lower()) and x.lower().upper() == x else x
    low = fold(c)
    kind = lambda x: (unicodedata.category(x), both(x))
    first = ord(low) & ~255
    some = "".join(x for x in map(chr, range(max(first, 128), first + 256)) if x.isalnum() and fold(x) == x and kind(x) == kind(low))
    return some, some.index(low)


def _mixed(cipher: Cipher, tweak: str, text: str, back: bool, ok: Callable[[str], bool] = lambda _: True) -> str:
    """Permutes letters among letters and digits among digits of their script, place by place as one mixed-radix number; keeps case."""
    x, n, kinds = 0, 1, []
    for c in text:
        if c.isalnum():
            some, at = (_DIGITS, int(c)) if c in _DIGITS else (_LETTERS, ord(c.lower()) - 97) if c.isascii() else _letters(c)
            x = x * len(some) + at
            n *= len(some)
            kinds.append((some, c not in some))

    def spell(v: int) -> str:
        out = []
        for some, upper in reversed(kinds):
            v, d = divmod(v, len(some))
            out.append(some[d].upper() if upper else some[d])
        it = iter(reversed(out))
        return "".join(next(it) if c.isalnum() else c for c in text)

    return spell(cipher.permute(tweak, n, x, lambda v: ok(spell(v)), back))


def _digits(cipher: Cipher, tweak: str, text: str, back: bool, keep: int = 0, ok: Callable[[str], bool] = lambda _: True) -> str:
    d = "".join(c for c in text if c.isdigit())
    head, tail = d[:keep], d[keep:]
    w = len(tail)
    x = cipher.permute(f"{tweak}{head}", 10**w, int(tail), lambda v: ok(head + f"{v:0{w}d}"), back)
    return _like(text, head + f"{x:0{w}d}")


def _email(c: Cipher, s: str, back: bool) -> str:
    local, _, domain = s.rpartition("@")
    return _mixed(c, "email" + domain.lower(), local, back) + "@" + domain


def _secret(c: Cipher, s: str, back: bool) -> str:
    low = s.lower()
    iban = lambda v: re.fullmatch(r"[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}", v) and _right(v)
    if iban(s):
        return _iban(c, s, back)
    if all(ch in "0123456789abcdef" for ch in low):
        is_secret = lambda v: any(ch.isdigit() for ch in v) and any(ch.isalpha() for ch in v) and (s == low or not iban(v.upper()))
        x = c.permute("hex", 16 ** len(s), int(low, 16), lambda v: is_secret(f"{v:0{len(s)}x}"), back)
        out = f"{x:0{len(s)}x}"
        return out.upper() if s != low else out
    head = 4 if s[:4] == "AKIA" or s[2:4] in ("o_", "p_", "s_", "u_") else 3
    return s[:head] + _mixed(c, s[:head], s[head:], back)


def _right(s: str) -> bool:
    return int("".join(str(int(ch, 36)) for ch in s[4:] + s[:4])) % 97 == 1


def _iban(c: Cipher, s: str, back: bool) -> str:
    compact = s.replace(s[4], "") if s[4] in " -" else s
    if not _right(compact):  # in groups, which would else be taken for numbers, a wrong one gets another wrong one
        return s if compact == s else _like(s, compact[:4] + _mixed(c, "wrong iban" + compact[:4], compact[4:], back, lambda v: not _right(compact[:4] + v)))
    body = _mixed(c, "iban" + s[:2], compact[4:], back)
    check = 98 - int("".join(str(int(ch, 36)) for ch in body + s[:2] + "00")) % 97
    return _like(s, f"{s[:2]}{check:02d}{body}")


def _date(c: Cipher, s: str, back: bool) -> str:
    parts = re.split(r"([-/.])", s)
    a, b, y = int(parts[0]), int(parts[2]), int(parts[4])
    year_first = len(parts[0]) == 4
    if year_first:
        order, y, m, d = "ymd", a, b, y
    else:  # with slashes the month comes first, if it can
        order, m, d = ("mdy", a, b) if parts[1] == "/" and a <= 12 else ("dmy", b, a)
    try:
        day = datetime.date(y, m, d).toordinal()
    except ValueError:
        return s
    if not _DATES[0] <= day < _DATES[1]:
        return s

    kind = _kind(datetime.date.fromordinal(day))
    days = _days()[kind]
    new = datetime.date.fromordinal(days[c.permute(f"date{kind}", len(days), bisect_left(days, day), back=back)])
    two = {"ymd": (new.month, new.day), "mdy": (new.month, new.day), "dmy": (new.day, new.month)}[order]
    two = [f"{x:0{len(w)}d}" for x, w in zip(two, (parts[2], parts[4]) if order == "ymd" else (parts[0], parts[2]))]
    return parts[1].join([str(new.year), *two] if order == "ymd" else [*two, str(new.year)])


def _kind(day: datetime.date) -> tuple[int, bool]:
    """What a date keeps: whether its day and its month have one digit, so that it can be spelled as it was, and whether its day can be a month."""
    return (day.day > 9) + (day.day > 12), day.month > 9


@cache
def _days() -> dict[tuple[int, bool], list[int]]:
    out: dict[tuple[int, bool], list[int]] = {}
    for n in range(*_DATES):
        out.setdefault(_kind(datetime.date.fromordinal(n)), []).append(n)
    return out


def _ip(c: Cipher, s: str, back: bool) -> str:
    o = [int(v) for v in s.split(".")]
    if max(o) > 255:
        return s
    x = c.permute("ip", 1 << 32, (o[0] << 24) | (o[1] << 16) | (o[2] << 8) | o[3], back=back)
    return ".".join(str((x >> k) & 255) for k in (24, 16, 8, 0))


def _ssn(c: Cipher, s: str, back: bool) -> str:
    valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    return _digits(c, "ssn", s, back, ok=valid) if valid(s.replace("-", "")) else s


def _number(c: Cipher, s: str, back: bool) -> str:
    d = "".join(ch for ch in s if ch.isdigit())
    good = luhn(d)  # card numbers stay valid, other long numbers stay invalid
    return _digits(c, f"number{good}", s, back, ok=lambda v: luhn(v) == good)


def _phone(c: Cipher, s: str, back: bool) -> str:
    if "+" in s:
        d = "".join(ch for ch in s if ch.isdigit())
        return _digits(c, "phone", s, back, keep=1 if d[0] in "17" else 2 if d[:2] in _TWO else 3)
    zero = lambda v: v[0] == "0"  # noqa: E731  (pairs of digits are read as a number only from a 0 on)
    first = zero([ch for ch in s if ch.isdigit()])
    return _digits(c, "phone", s, back, ok=lambda v: zero(v) == first)


#: Country codes of two digits; those of one are 1 and 7, all others have three.
_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
KINDS = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "number": _number, "phone": _phone}


def rewrite(text: str, cipher: Cipher, back: bool = False) -> tuple[str, int]:
    """The text with pseudonyms, and how many values were replaced; with ``back``, the original of such a text."""
    n = 0

    def one(m: re.Match) -> str:
        nonlocal n
        out = KINDS[m.lastgroup](cipher, m[0], back) if m.lastgroup in KINDS else _named(m, cipher, back)
        n += out != m[0]
        return out

    return PATTERN.sub(one, text), n


def _named(m: re.Match, cipher: Cipher, back: bool) -> str:
    kind = next(k for k in KINDS if m[k] is not None)
    return KINDS[kind](cipher, m[0], back)


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, text, replaced) of every row: the text with pseudonyms for personal values, and their number.

    E-mail addresses (local part), secrets (hex keys and known key formats), IBANs with a right checksum (or in
    groups of four), calendar dates from 1900 to 2099, IPv4 addresses, social security numbers, card and other long numbers (12 to 19 digits)
    and telephone numbers are replaced by a keyed permutation within their format and validity, so a value gets the
    same pseudonym in every document and spelling, two values never share one, and the owner of the key can undo it. Telephone
    numbers keep their country code; dates keep whether day and month have one digit and whether the day exceeds 12.
    Values that only look like these (13/45/2020, 999.1.2.3) stay, but for wrong IBANs in groups of four, which get wrong ones.
    Ten digits in a row, in groups of 3, 3 and 4 or in pairs from a 0 on count as a telephone number.
    Not covered: national telephone numbers of other lengths, parts of local parts before a combining mark or in
    quotes, domains with non-ASCII letters, IBANs in groups of countries not in IBAN_LENGTHS or with other gaps than
    spaces and hyphens. Telephone numbers with a country code are not linked with those without, nor with those that add a
    trunk zero to it. A permutation may map a value to itself, one time in as many as its format has values: 26 for an
    address with a local part of one letter, 600 for a date in the last quarter of a year on its 10th to 12th, thousands to billions for others.

    Nulls: a null text stays null with 0 replaced; a null id is carried. Empty texts stay. Each row stands for itself,
    repeated or not. An empty table gives an empty one. Other columns, whatever their names, are left aside.
    """

    @F.arrow_udf("struct<text string, n int>")
    def run(texts: pa.Array) -> pa.Array:
        cipher = Cipher(key)
        out, n = [], []
        for t in texts:
            s, k = rewrite(t.as_py(), cipher) if t.is_valid else (None, None)
            out.append(s)
            n.append(k)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n, pa.int32())], ["text", "n"])

    new = HIDDEN + "new"
    text = q(text_col)
    done = docs.select(q(id_col).alias(id_col), text.alias(text_col), run(F.when(text.rlike(MAYBE), text)).alias(new))
    return done.select(q(id_col).alias(id_col), F.coalesce(F.col(f"{new}.text"), q(text_col)).alias(text_col), F.coalesce(F.col(f"{new}.n"), F.lit(0)).alias("replaced"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for the personal values in its text."""
    return pseudonymise(read(spark, sf_dir, "documents"))
