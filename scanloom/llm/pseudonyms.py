"""Replacing personal numbers, dates and addresses by pseudonyms of the same format."""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import arrays

_ROUNDS = 8
_FIRST_DAY, _LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


class Feistel:
    """A keyed permutation of 0 .. size - 1 for every size and kind: an unbalanced Feistel network over
    a times b >= size, walked along its cycles until the result is inside."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _round(self, kind: str, size: int, number: int, value: int, modulus: int) -> int:
        digest = hashlib.blake2b(f"{kind}|{size}|{number}|{value}".encode(), key=self.key, digest_size=32)
        return int.from_bytes(digest.digest(), "big") % modulus

    def _once(self, kind: str, size: int, value: int, a: int, b: int, back: bool) -> int:
        left, right = divmod(value, b)
        for number in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
            sign = -1 if back else 1
            if number % 2:
                right = (right + sign * self._round(kind, size, number, left, b)) % b
            else:
                left = (left + sign * self._round(kind, size, number, right, a)) % a
        return left * b + right

    def permute(self, kind: str, size: int, value: int, back: bool = False) -> int:
        if size < 2:
            return value
        b = max(2, round(size**0.5))
        a = -(-size // b)
        value = self._once(kind, size, value, a, b, back)
        while value >= size:
            value = self._once(kind, size, value, a, b, back)
        return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows these digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """The digits in the places of the digits of a value, all else as it was."""
    following = iter(digits)
    return "".join(next(following) if c.isdigit() else c for c in shape)


def _number(digits: str) -> int:
    return int(digits)


def _card(value: str, f: Feistel, back: bool) -> str | None:
    digits = re.sub(r"[^0-9]", "", value)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    # The first digit, which names the kind of card, and the check digit stay valid.
    body = digits[1:-1]
    other = digits[0] + str(f.permute("card", 10 ** len(body), _number(body), back)).zfill(len(body))
    return _refill(value, other + luhn_digit(other))


def _iban_check(country: str, rest: str) -> str:
    numeric = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(numeric) % 97:02d}"


def _iban(value: str, f: Feistel, back: bool) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    digits = re.sub(r"[^0-9]", "", plain[4:])
    if not digits:
        return None
    other = str(f.permute("iban", 10 ** len(digits), _number(digits), back)).zfill(len(digits))
    rest = _refill(plain[4:], other)
    following = iter(plain[:2] + _iban_check(plain[:2], rest) + rest)
    return "".join(c if c == " " else next(following) for c in value)


def _date(value: str, f: Feistel, back: bool) -> str | None:
    year_first = value[4:5] in "-/."
    parts = re.split(r"[-/.]", value)
    signs = re.findall(r"[-/.]", value)
    year, month, day = (parts if year_first else parts[::-1])
    swapped = False
    try:
        if not year_first and int(month) > 12:
            month, day, swapped = day, month, True
        ordinal = dt.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    if not _FIRST_DAY <= ordinal <= _LAST_DAY:
        return None
    size = _LAST_DAY - _FIRST_DAY + 1
    kind = "date"
    where = ordinal - _FIRST_DAY
    if not swapped and not year_first:
        kind = "day-first"
    if swapped:
        kind = "month-first"
    while True:
        where = f.permute(kind, size, where, back)
        other = dt.date.fromordinal(_FIRST_DAY + where)
        # Written month first only if that shows: days above 12 stay above 12.
        if not swapped or other.day > 12:
            break
    fields = [f"{other.year:04d}", f"{other.month:02d}", f"{other.day:02d}"]
    if not year_first:
        fields = [fields[1], fields[2], fields[0]] if swapped else fields[::-1]
    return fields[0] + signs[0] + fields[1] + signs[1] + fields[2]


def _address(value: str, f: Feistel, back: bool) -> str | None:
    try:
        number = int(ipaddress.IPv4Address(value))
    except ValueError:
        return None
    return str(ipaddress.IPv4Address(f.permute("ipv4", 1 << 32, number, back)))


def _social(value: str, f: Feistel, back: bool) -> str | None:
    area, group, serial = value.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    areas = [a for a in range(1, 900) if a != 666]
    place = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
    place = f.permute("social", len(areas) * 99 * 9999, place, back)
    place, serial = divmod(place, 9999)
    area, group = divmod(place, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(value: str, f: Feistel, back: bool) -> str | None:
    digits = re.sub(r"[^0-9]", "", value)
    if not 9 <= len(digits) <= 15:
        return None
    # The country's digits stay where they are marked; no group of the rest starts with 0 or 1 that did not.
    lead = len(re.match(r"\+?(\d{0,3})", value).group(1)) if value.startswith("+") else 0
    body = digits[lead:]
    if len(body) < 6:
        return None
    other = str(f.permute(f"phone{digits[:lead]}", 10 ** len(body), _number(body), back)).zfill(len(body))
    return _refill(value, digits[:lead] + other)


def _mail(value: str, f: Feistel, back: bool) -> str | None:
    local, _, domain = value.rpartition("@")
    # Letters and digits of the local part, each in its alphabet, as one number in a mixed base.
    bases = [26 if c.isascii() and c.isalpha() else 10 if c.isascii() and c.isdigit() else 1 for c in local]
    number = size = 0
    for c, base in zip(local, bases, strict=True):
        size = size * base if size else base
        if base > 1:
            number = number * base + (_LETTERS.index(c.lower()) if base == 26 else int(c))
    kind = "mail" + "".join("a" if b == 26 else "0" if b == 10 else c for c, b in zip(local, bases, strict=True)) + domain.lower()
    number = f.permute(kind, size, number, back)
    out = []
    for c, base in zip(reversed(local), reversed(bases), strict=True):
        if base == 1:
            out.append(c)
            continue
        number, digit = divmod(number, base)
        letter = _LETTERS[digit] if base == 26 else str(digit)
        out.append(letter.upper() if c.isupper() else letter)
    return "".join(reversed(out)) + "@" + domain


#: Kinds in the order in which they are tried: name, pattern, and what makes a pseudonym of a valid value.
KINDS = (
    ("mail", r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])", _mail),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9/-]|\.[0-9])", _date),
    ("social", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _social),
    ("address", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])", _address),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])", _card),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9])|\([0-9]{2,4}\)|0(?=[0-9]{1,4}[ ./-])|[0-9]{3}(?=[ .-][0-9]{3}[ .-][0-9]{4}))(?:[ ./()-]{0,2}[0-9]){5,13}(?![0-9A-Za-z])", _phone),
)
#: Characters of a card or IBAN without blanks and dashes, from and to.
_LENGTHS = {"card": (13, 19), "iban": (15, 34)}
#: Lengths of IBANs by country; of other countries all lengths are tried.
IBAN_LENGTHS = {
    code: int(length)
    for length, codes in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL SO",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR BI", 27: "DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB PL SV NI", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}


def _readings(kind: str, value: str) -> Iterator[tuple[int, int]]:
    """The other starts and ends, at group borders inside a match, of values as long as the kind allows;
    the earliest start first, then the longest."""
    least, most = _LENGTHS[kind]
    groups = [m.span() for m in re.finditer(r"[^ -]+", value)]
    for k, (a, _) in enumerate(groups):
        if kind == "iban":
            # Only the match's own start has the letters and digits of one.
            if k:
                return
            least, most = (IBAN_LENGTHS.get(value[:2], x) for x in _LENGTHS[kind])
        ends, length = [], 0
        for c, d in groups[k:]:
            length += d - c
            if least <= length <= most:
                ends.append(d)
        for d in reversed(ends):
            if (a, d) != (0, len(value)):
                yield a, d


_MARKS = np.zeros(256, dtype=bool)
_MARKS[[*range(0x30, 0x3A), 0x40]] = True


class Pseudonyms:
    """Finds valid values in a text and replaces them, or turns pseudonyms back with the same key."""

    def __init__(self, key: bytes, kinds=KINDS) -> None:
        self.feistel = Feistel(hashlib.blake2b(key, digest_size=32).digest())
        self.kinds = [(name, re.compile(pattern), make) for name, pattern, make in kinds]

    def replace(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with its values replaced, and kind, start and end (in the given text) of each."""
        taken: list[tuple[int, int, str, str]] = []
        for name, pattern, make in self.kinds:
            at = 0
            while m := pattern.search(text, at):
                at = m.end()
                spans = [m.span()]
                if name in _LENGTHS:
                    spans += [(m.start() + a, m.start() + b) for a, b in _readings(name, m.group(0))]
                for first, last in spans:
                    if any(a < last and first < b for a, b, _, _ in taken):
                        continue
                    other = make(text[first:last], self.feistel, back)
                    if other is not None:
                        taken.append((first, last, name, other))
                        at = last
                        break
                else:
                    if name in _LENGTHS:
                        # A value may begin later in the match and go on behind it.
                        at = m.start() + 1
        taken.sort()
        out, at = [], 0
        for a, b, _, other in taken:
            out += [text[at:a], other]
            at = b
        return "".join([*out, text[at:]]), [(name, a, b) for a, b, name, _ in taken]


_FOUND = "doc_id long, text string, n_found long, kinds string, spans array<struct<kind:string,first:int,last:int>>"


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, n_found, kinds, spans`` per row of ``docs`` (``doc_id, text``).

    Card numbers (Luhn), IBANs (mod 97), dates (of the calendar, 1900 to 2099), US social security
    numbers, IPv4 addresses, phone numbers and the local part of mail addresses are replaced by a keyed
    permutation within their format and validity, so equal values have equal pseudonyms in all
    documents, different values different ones, and the key turns them back. ``kinds``: distinct,
    sorted, comma-joined; ``spans``: where the values stood, in characters of the given text.

    Null texts stay null; bytes that are not UTF-8 are read as replacement characters; an empty table has
    no rows; rows with null or repeated ids have a row each. Texts of any length are searched whole, one at
    a time; other columns are not looked at. Values that fail their check
    stay as they are, unless a later kind knows them.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]):
        names = Pseudonyms(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            column = batch.column(1)
            if pa.types.is_large_string(column.type):
                column = column.cast(pa.string())
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            text = arrays.strings(column)
            count = np.zeros(len(batch), dtype=np.int64)
            kinds = [""] * len(batch)
            found: list[list] = [[] for _ in range(len(batch))]
            for part in arrays.parts(column):
                # Without a digit or an @ there is nothing to find.
                sums = np.concatenate(([0], np.cumsum(_MARKS[part.data])))
                some = np.flatnonzero(np.diff(sums[part.offsets])) + part.first
                for k in some[valid[some]]:
                    text[k], values = names.replace(text[k])
                    count[k] = len(values)
                    kinds[k] = ",".join(sorted({v[0] for v in values}))
                    found[k] = [{"kind": a, "first": b, "last": c} for a, b, c in values]
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "text": pa.array(text, pa.string()),
                    "n_found": pa.array(count),
                    "kinds": pa.array(kinds, pa.string()),
                    "spans": pa.array(found, kind),
                }
            )

    return texts.mapInArrow(rows, _FOUND)
