"""Format-preserving pseudonyms of personal data, by a keyed Feistel permutation.

Every kind of value has a pattern, a test of validity and a way to number the values of one format. A
value's number is permuted among the numbers of its format (a Feistel network on mixed radices, walked
on until it is again a valid number of that format), and written back in the same layout. The same key
takes equal values to equal pseudonyms in all documents, and back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docql.llm.common import ship

ROUNDS = 8


class Feistel:
    """A keyed permutation of 0 .. n-1 for any n, and its inverse."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mix(self, label: bytes, n: int, turn: int, half: int) -> int:
        said = b"%s|%d|%d|%d" % (label, n, turn, half)
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=24).digest(), "big")

    def _once(self, label: bytes, x: int, n: int, back: bool) -> int:
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        left, right = divmod(x, b)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2:
                right = (right + sign * self._mix(label, n, turn, left)) % b
            else:
                left = (left + sign * self._mix(label, n, turn, right)) % a
        return left * b + right

    def permute(self, label: bytes, x: int, n: int, back: bool = False, valid: Callable[[int], bool] = lambda _: True) -> int:
        """Walks on until below n and valid; x must be both."""
        if n < 2:
            return x
        while True:
            x = self._once(label, x, n, back)
            if x < n and valid(x):
                return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def refill(layout: str, new: str, take: Callable[[str], bool] = str.isdigit) -> str:
    """layout with its taken characters replaced by those of new, one after the other; letters keep their case."""
    it = iter(new)
    return "".join((n.upper() if c.isupper() else n) if take(c) and (n := next(it)) else c for c in layout)


def radix(text: str) -> list[int]:
    return [10 if c.isdigit() else 26 for c in text]


def number(text: str, sizes: list[int]) -> int:
    x = 0
    for c, size in zip(text, sizes, strict=True):
        x = x * size + (ord(c) - (48 if size == 10 else 97))
    return x


def unnumber(x: int, sizes: list[int]) -> str:
    out = []
    for size in reversed(sizes):
        x, d = divmod(x, size)
        out.append(chr(d + (48 if size == 10 else 97)))
    return "".join(reversed(out))


DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()
ASCII_ALNUM = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ").__contains__


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def card(f: Feistel, text: str, back: bool) -> str | None:
    """13 to 19 digits that satisfy Luhn's test: all but the last digit are permuted, the last follows."""
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or not luhn(digits):
        return None
    n = len(digits) - 1
    body = str(f.permute(b"card", int(digits[:-1]), 10**n, back)).zfill(n)
    return refill(text, body + next(c for c in "0123456789" if luhn(body + c)))


#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO EG GT HU LB NI PL SV", 29: "BR PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: The country codes of telephone numbers with one and two digits; all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def head(text: str, n: int, take: Callable[[str], bool]) -> str | None:
    """The start of text that holds n taken characters; None where text has fewer, or goes on with another such."""
    for i, c in enumerate(text):
        if take(c):
            n -= 1
            if n == 0:
                return text[: i + 1] if not (i + 1 < len(text) and take(text[i + 1])) else None
    return None


def iban(f: Feistel, text: str, back: bool) -> str | None:
    """An account number of its country's length; what follows that in text stays."""
    length = IBAN_LENGTHS.get(text[:2])
    text = length and head(text, length, ASCII_ALNUM)
    if not text or mod97(plain := text.replace(" ", "").lower()) != 1:
        return None
    sizes = radix(plain[4:])
    total = 1
    for s in sizes:
        total *= s
    body = unnumber(f.permute(b"iban" + plain[:2].encode(), number(plain[4:], sizes), total, back), sizes)
    check = 98 - mod97(plain[:2] + "00" + body)
    return refill(text, f"{plain[:2]}{check:02d}{body}", ASCII_ALNUM)


def country_code(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])


def phone(f: Feistel, text: str, back: bool) -> str | None:
    """A number with country code, whatever its layout, or of ten digits in the layout of country code 1.

    The digits after the country code are permuted, so one number has one pseudonym in all layouts. Numbers of codes 1
    and 7 have ten further digits, and what follows them in text stays; others have 5 to 15 digits in all.
    """
    code = country_code(_digits(text)) if text[0] == "+" else "1"
    skip = len(code) if text[0] == "+" else 0
    if code in ("1", "7"):
        text = head(text, skip + 10, str.isdigit) or ""
    digits = _digits(text)[skip:]
    if not (5 <= len(digits) and len(code) + len(digits) <= 15):
        return None
    new = str(f.permute(b"phone" + code.encode(), int(digits), 10 ** len(digits), back)).zfill(len(digits))
    return refill(text, code[:skip] + new)


def ip(f: Feistel, text: str, back: bool) -> str | None:
    """Four numbers up to 255, without leading zeros."""
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = f.permute(b"ip", int.from_bytes(bytes(map(int, parts)), "big"), 2**32, back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def ssn(f: Feistel, text: str, back: bool) -> str | None:
    def valid(x: int) -> bool:
        area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0

    x = int(_digits(text))
    return refill(text, str(f.permute(b"ssn", x, 10**9, back, valid)).zfill(9)) if valid(x) else None


def read_date(text: str) -> tuple[tuple[int, int, int], datetime.date] | None:
    """Places of year, month and day among the parts, and the date; month first only with slashes, where it can be."""
    parts = [int(p) for p in re.split(r"[-/.]", text)]
    order = (0, 1, 2) if re.match(r"\d{4}", text) else (2, 0, 1) if "/" in text and parts[0] <= 12 else (2, 1, 0)
    try:
        day = datetime.date(*(parts[p] for p in order))
    except ValueError:
        return None
    return (order, day) if DAYS[0] <= day.toordinal() < DAYS[1] else None


def date(f: Feistel, text: str, back: bool) -> str | None:
    """Calendar dates from 1900 to 2099: year first, or day and month first with a year of four digits."""
    if (found := read_date(text)) is None:
        return None
    order, day = found
    parts = re.split(r"([-/.])", text)

    def written(x: int) -> str:
        d, new = datetime.date.fromordinal(DAYS[0] + x), list(parts)
        for place, value in zip(order, (d.year, d.month, d.day), strict=True):
            new[2 * place] = str(value).zfill(len(parts[2 * place]))
        return "".join(new)

    def valid(x: int) -> bool:
        new = written(x)
        return len(new) == len(text) and [*map(len, re.split(r"[-/.]", new))] == [*map(len, parts[::2])] and read_date(new) == (order, datetime.date.fromordinal(DAYS[0] + x))

    label = b"date" + repr((order, [*map(len, parts[::2])], "/" in text)).encode()
    return written(f.permute(label, day.toordinal() - DAYS[0], DAYS[1] - DAYS[0], back, valid))


def email(f: Feistel, text: str, back: bool) -> str | None:
    """ASCII letters and digits of the part before @ are permuted, letters among letters; case and the domain stay."""
    local, _, domain = text.rpartition("@")
    plain = "".join(c for c in local if ASCII_ALNUM(c)).lower()
    if not plain:
        return None
    sizes = radix(plain)
    total = 1
    for s in sizes:
        total *= s
    label = b"email|" + re.sub("[0-9]", "9", re.sub("[a-z]", "a", local.lower())).encode() + b"@" + domain.lower().encode()
    return refill(local, unnumber(f.permute(label, number(plain, sizes), total, back), sizes), ASCII_ALNUM) + "@" + domain


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    change: Callable[[Feistel, str, bool], str | None]
    cuts: bool = False  # whether change may take a start of the text only, as long as what it gives


#: In the order in which they are tried at a place.
KINDS = (
    Kind("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])", email),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban, True),
    Kind("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w+.-])(?:\(\d{3}\) ?\d{3}[.-]\d{4}|\d{3}(?P<dash>[.-])\d{3}(?P=dash)\d{4})(?![\w-]|\.\d)", phone, True),
    Kind("ssn", r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d)", ssn),
    Kind("date", r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}(?P<sep>[./-])\d{1,2}(?P=sep)\d{4})(?![\w/-]|\.\d)", date),
    Kind("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", ip),
    Kind("card", r"(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w]|-\d)", card),
)
ANY = re.compile("|".join(f"(?P<{k.name}>{k.pattern})" for k in KINDS))
BY_NAME = {k.name: k for k in KINDS}
LIKELY = re.compile(r"[0-9@]")


def pseudonymise(text: str, feistel: Feistel, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with all valid values changed, and their kinds, starts and ends in the text given."""
    if not LIKELY.search(text):
        return text, []
    out, spans, at, start = [], [], 0, 0
    while m := ANY.search(text, start):
        name = next(k for k in BY_NAME if m[k] is not None)
        new = BY_NAME[name].change(feistel, m[0], back)
        start = m.start() + 1  # what begins within a value that isn't valid may be
        if new is not None:
            start = m.start() + len(new) if BY_NAME[name].cuts else m.end()
            out += [text[at : m.start()], new]
            spans.append((name, m.start(), start))
            at = start
    return ("".join([*out, text[at:]]), spans) if spans else (text, [])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def pseudonyms(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """The input's columns, text with pseudonyms, and pii (kind, start, end of each value in the text given).

    back with the same key restores the texts. Null texts stay null with no values. Numbers and dates that
    fail their test (check digit, calendar, range) are left alone. Rows are kept, also repeated ones; a column
    pii of the input is replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop("pii")
    schema = T.StructType([*docs.schema.fields, T.StructField("pii", SPANS)])
    at = docs.columns.index("text")

    def run(batches):
        feistel = Feistel(key.encode())
        for batch in batches:
            done = [pseudonymise(x.as_py() or "", feistel, back) if x.is_valid else (None, []) for x in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array([d[0] for d in done], columns[at].type)
            spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in d[1]] for d in done], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*columns, spans], names=schema.names)

    return docs.mapInArrow(run, schema)
