"""Format-preserving pseudonyms for personal data.

Values that pass their format's validation (cards by issuer range and Luhn digit, mod-97 IBANs, calendar
dates, assigned-range SSNs, IPv4 octets, telephone numbers, e-mail addresses, keys
and passwords) are numbered within their format, the number is permuted by a keyed
Feistel network (cycle-walked into the format's range), and written back in the
same shape with the check digits made right again. The permutation depends on key
and format alone, so equal values have equal pseudonyms in every document, and
different ones have different ones.

Digits or capitals after a card or an IBAN may be read with it (expiry, CVV,
currency): where the longest run is not valid, shorter ends between groups are
tried, for an IBAN also its country's length. All calendar dates of the years 1 to
9999 count; those from 1900 to 2099 stay in that range, the others outside it.

A pseudonym has its value's shape: a day or month written with one digit becomes
one of one digit, and a card keeps its issuer. Digits are 0-9; those of other scripts are
ordinary text. Three groups with blanks and neither + nor parentheses are a telephone
number only if area and exchange are assigned ones (200 upwards, not N11).

Everything happens within a row: no shuffle. Null text stays null, empty text empty, both with 0
values; repeated rows give repeated results; very long texts are scanned once. Extra columns pass
through, but one named like the count gives way to it. An empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import strings

ROUNDS = 10
DAY0, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()

FAR = datetime.date.max.toordinal() - DAYS   # days before and after those

#: Length of an IBAN by country.
IBAN_LENGTH = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}.items() for c in cs.split()}

HEX = "0123456789abcdef"

#: One scan of a text; a candidate is replaced only if it is valid.
CANDIDATE = re.compile(r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
  | (?P<assigned>(?:password|passwd|pwd|token|secret|api_key|apikey)\s{0,2}[=:]\s{0,2}["']?)(?P<secret>[^\s"',;]{6,})
  | (?P<key>\bAKIA[0-9A-Z]{16}\b)
  | (?P<iban>\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
  | (?P<iso>(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-]))
  | (?P<numeric>(?<![0-9/.])[0-9]{1,2}(?P<sep>[/.])[0-9]{1,2}(?P=sep)[0-9]{4}(?![0-9]))
  | (?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))
  | (?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
  | (?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]) | (?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9]))
  | (?P<card>(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))
""", re.X)


class Permutation:
    """A keyed permutation of range(n) for every n and format name."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key).digest()

    def __call__(self, name: str, n: int, x: int) -> int:
        if n < 2:
            return x
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, salt = (1 << half) - 1, f"{name}/{n}/".encode()
        while True:   # walk the cycle until the value is back in range
            a, b = x >> half, x & mask
            for i in range(ROUNDS):
                f = hashlib.blake2b(salt + b"%d/%d" % (i, b), key=self.key, digest_size=max(8, (half + 7) // 8)).digest()
                a, b = b, a ^ (int.from_bytes(f, "big") & mask)
            x = a << half | b
            if x < n:
                return x


def _by_class(permute: Permutation, name: str, text: str, hexadecimal: bool = True) -> str:
    """Letters to letters and digits to digits, hexadecimal strings to such if they may be some, all at once; other characters stay."""
    kinds = (string.digits, string.ascii_lowercase, string.ascii_uppercase)
    if hexadecimal and len(text) > 8 and set(text) <= set(HEX) and set(text) & set(string.digits):
        kinds = (HEX,)
    sets = [next((k for k in kinds if c in k), None) for c in text]
    n, x = 1, 0
    for c, k in zip(text, sets):
        if k:
            n, x = n * len(k), x * len(k) + k.index(c)
    x = permute(f"{name}/{''.join('.' if k is None else k[0] for k in sets)}", n, x)
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if sets[i]:
            x, r = divmod(x, len(sets[i]))
            out[i] = sets[i][r]
    return "".join(out)


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in string.digits else c for c in shape)


def luhn(digits: str) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10


#: Number ranges of card issuers, by leading digits and length.
ISSUED = re.compile(r"""(?x)
    4(?:[0-9]{12}|[0-9]{15}|[0-9]{18}) | 5[1-5][0-9]{14} | 2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}
  | 3[47][0-9]{13} | 3(?:0[0-5]|[689][0-9])[0-9]{11,16} | 35(?:2[89]|[3-8][0-9])[0-9]{12,15}
  | 6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12,15} | 62[0-9]{14,17} | (?:5[06-9]|6[0-9])[0-9]{11,17}""")


def is_card(digits: str) -> bool:
    return not luhn(digits) and ISSUED.fullmatch(digits) is not None


def _card(permute, value: str) -> str | None:
    digits = "".join(c for c in value if c in string.digits)
    if not is_card(digits):
        return None
    kept = 1 if digits[0] == "4" else 4          # the issuer's range
    n = len(digits) - kept - 1
    body = digits[:kept] + str(permute(f"card{len(digits)}{digits[:kept]}", 10 ** n, int(digits[kept:-1]))).zfill(n)
    return _refill(value, body + str(-luhn(body + "0") % 10))


DIGIT_GROUPS = re.compile(r"[0-9]+(?:[ -][0-9]+)*")


def _shorter_card(text: str, start: int, end: int) -> int | None:
    """The end of the card that begins at ``start``, where the run to ``end`` is none: the
    longest valid run of whole groups, unless it meets a longer one that begins later."""
    stop = min(len(text), end + 40)
    groups = [g.span() for g in re.finditer(r"[0-9]+", DIGIT_GROUPS.match(text, start, stop)[0])]
    if start + groups[-1][1] == stop < len(text) and text[stop].isdigit():
        groups.pop()   # cut
    valid = []
    for i, (s, _) in enumerate(groups):
        if start + s >= end or s and text[start + s - 1] == "-":
            continue
        digits = ""
        for a, b in groups[i:]:
            digits += text[start + a:start + b]
            if len(digits) > 19:
                break
            if len(digits) >= 13 and is_card(digits):
                valid.append((len(digits), -s, b))
    best = None
    while valid:
        best = max(valid)
        valid = [v for v in valid if v[2] <= -best[1]]
    return start + best[2] if best and best[1] == 0 else None


def _ssn(permute, value: str) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = permute("ssn", 898 * 99 * 9999, ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(permute, value: str) -> str | None:
    octets = value.split(".")
    if any(int(o) > 255 or o != str(int(o)) for o in octets):
        return None
    x = permute("ip", 1 << 32, sum(int(o) << 8 * (3 - i) for i, o in enumerate(octets)))
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _phone(permute, value: str) -> str | None:
    digits = "".join(c for c in value if c in string.digits)
    bare = re.fullmatch(r"([0-9]{3}) ([0-9]{3}) [0-9]{4}", value)
    if bare and any(g < "200" or g.endswith("11") for g in bare.groups()):
        return None       # three numbers in a row
    own = 10 if re.search(r"[0-9]{3}\)? ?[ .-]?[0-9]{3}[ .-][0-9]{4}$", value) else max(0, len(digits) - 2)
    if not 7 <= len(digits) <= 15 or not 6 <= own <= len(digits):
        return None
    x = int(digits[-own:])
    while True:       # walk the cycle until a bare number is one of assigned area and exchange again
        x = permute(f"phone{len(digits)}/{own}{'/bare' if bare else ''}", 10 ** own, x)
        new = _refill(value, digits[:-own] + str(x).zfill(own))
        if not bare or not any(g < "200" or g.endswith("11") for g in new.split()[:2]):
            return new


def _day(year: int, month: int, day: int) -> int | None:
    """Days from DAY0; negative or from DAYS on outside the years 1900 to 2099."""
    try:
        return datetime.date(year, month, day).toordinal() - DAY0
    except ValueError:
        return None


def _other_day(permute, name: str, x: int) -> datetime.date:
    """A day of 1900 to 2099 for such a day, one outside for one outside."""
    if 0 <= x < DAYS:
        return datetime.date.fromordinal(DAY0 + permute(name, DAYS, x))
    y = permute(name + "/far", FAR, x + DAY0 - 1 - (DAYS if x >= DAYS else 0))
    return datetime.date.fromordinal(y + 1 + (DAYS if y + 1 >= DAY0 else 0))


def _iso(permute, value: str) -> str | None:
    x = _day(*map(int, value.split("-")))
    return None if x is None else _other_day(permute, "iso", x).isoformat()


#: Days past the 12th, where day and month cannot be taken for each other.
def _late_days() -> list[int]:
    return [x for x in range(DAYS) if datetime.date.fromordinal(DAY0 + x).day > 12]


def _numeric(permute, value: str, late: list[int], late_at: dict[int, int]) -> str | None:
    sep = "/" if "/" in value else "."
    a, b, year = value.split(sep)
    day_first = sep == "." or int(a) > 12
    x = _day(int(year), int(b if day_first else a), int(a if day_first else b))
    if x is None:
        return None
    past_12 = day_first and sep == "/"           # else day and month would be taken for each other
    order = lambda d: (d.day, d.month) if day_first else (d.month, d.day)
    while True:       # walk the cycle until the date has the shape again
        if not past_12:
            d = _other_day(permute, "numeric" + sep, x)
        elif x in late_at:
            d = datetime.date.fromordinal(DAY0 + late[permute("late", len(late), late_at[x])])
        else:
            d = _other_day(permute, "late", x)
        first, second = order(d)
        if (not past_12 or d.day > 12) and first < 10 ** len(a) and second < 10 ** len(b):
            return f"{first:0{len(a)}d}{sep}{second:0{len(b)}d}{sep}{d.year:04d}"
        x = d.toordinal() - DAY0


def _iban(permute, value: str) -> str | None:
    flat = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _by_class(permute, "iban" + flat[:2], flat[4:], hexadecimal=False)   # all digits stay digits
    it = iter(flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(it) for c in value)


def _iban_ends(value: str) -> list[int]:
    """Ends to try: the country's length if a group ends there, all, shorter ones between groups, the country's length within a group."""
    n, at = IBAN_LENGTH.get(value[:2], 0), [i for i, c in enumerate(value) if c != " "]
    own = [at[n - 1] + 1] if 0 < n <= len(at) else []
    groups = [len(value), *(i for i in range(len(value) - 1, 0, -1) if value[i] == " ")]
    return list(dict.fromkeys([*(e for e in own if e in groups), *groups, *own]))


class Pseudonymizer:
    def __init__(self, key: bytes):
        self.permute = Permutation(key)
        self.late = _late_days()
        self.late_at = {x: i for i, x in enumerate(self.late)}

    def value(self, kind: str, value: str) -> str | None:
        p = self.permute
        if kind == "email":
            local, at, host = value.rpartition("@")
            return _by_class(p, "email", local) + at + host
        if kind in ("secret", "key"):
            head = "AKIA" if kind == "key" else ""
            return head + _by_class(p, kind, value[len(head):])
        if kind == "numeric":
            return _numeric(p, value, self.late, self.late_at)
        return {"card": _card, "ssn": _ssn, "ip": _ip, "phone": _phone, "iso": _iso, "iban": _iban}[kind](p, value)

    def text(self, text: str) -> tuple[str, int]:
        """The text with its values replaced, and their number."""
        out, at, n, pos = [], 0, 0, 0
        while m := CANDIDATE.search(text, pos):
            kind = next(k for k in ("email", "secret", "key", "iban", "iso", "numeric", "ip", "ssn", "phone", "card") if m[k] is not None)
            start, end = m.span(kind)
            if kind == "iban":
                new, end = next(((v, start + e) for e in _iban_ends(m[kind]) if (v := self.value(kind, m[kind][:e])) is not None), (None, end))
            else:
                new = self.value(kind, m[kind])
            if new is None and kind == "card" and (e := _shorter_card(text, start, end)):
                new, end = self.value(kind, text[start:e]), e
            if new is None:   # not valid as this: something else may begin within it
                pos = m.start() + 1
                while pos < m.end() and text[pos].isalnum():
                    pos += 1
                continue
            out += [text[at:start], new]
            at = pos = end
            n += 1
        return "".join([*out, text[at:]]), n


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str = "n_values") -> DataFrame:
    """The rows with pseudonyms for personal values in ``text_col``, and their number."""
    source = docs.drop(count_col).withColumn(text_col, strings(docs, text_col))
    at = source.schema.names.index(text_col)

    def run(batches):
        change = Pseudonymizer(key)
        for batch in batches:
            done = [(None, 0) if t is None else change.text(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int64())], names=[*batch.schema.names, count_col])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(count_col, T.LongType())]))
