"""Operator 8: format-preserving Feistel pseudonyms for personal data.

Numbers and dates are found by pattern, validated (check digits, ranges, calendar) and replaced by a keyed permutation of
the values of their format: a card number stays a valid card number of its issuer, a date a real date of its century, a phone number
keeps its country code and punctuation. As the permutation depends on the key and the format alone, equal values stay
equal in all documents, different ones stay different, and the key's holder can undo it. E-mail names, access keys,
tokens and passwords go through the same permutation, character class by character class.

Formats: e-mail, payment card (issuer, length and Luhn), IBAN (mod 97), US social security number, IPv4 address, phone number (with
+code, with an area code in brackets, of groups 3-3-4, or national with a leading 0 in usual groups), date (ISO, also within a time stamp, d.m.y, d/m/y or m/d/y), access key id, token or password after its name.

Of cards and IBANs every reading between borders of groups is tried. Where a pseudonym would make another reading of its
neighbours valid, the next of its cycle is taken: undoing stays exact among them, and only there equal values may part.
Digit groups taken for a phone number can still become a valid card by chance, and are then undone as one.

Defined cases: null and empty texts stay; a null doc_id stays null; values that fail validation stay; overlapping finds go to the format listed
first; repeated rows get equal results; empty input gives an empty result. Whole texts are searched, at any length.
Extra columns, whatever their names, pass through ``pseudonymise``; ``pii_report`` reads doc_id and text only.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import warnings
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.common import small_batches, table
from docsift.llm.kernel import release_memory

#: Setting of the session that holds the key of queries, and the key of sessions that have none (tests): with that one
#: anyone can undo the pseudonyms, so a warning is given.
KEY_SETTING, DEMO_KEY = "spark.docsift.pii.key", b"docsift-demo-key"
ROUNDS = 8
UPPER, LOWER_CASE, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _letters(first: int, last: int, upper: bool) -> str:
    return "".join(c for c in map(chr, range(first, last + 1)) if c.isalpha() and c.isupper() == upper)


#: Classes of the letters of names beyond ASCII: Latin, Greek and Cyrillic ones, each case by itself.
NAME_CLASSES = (DIGITS, UPPER, LOWER_CASE, *(_letters(a, b, upper) for a, b in ((0xC0, 0xFF), (0x100, 0x17F), (0x386, 0x3CE), (0x400, 0x45F)) for upper in (True, False)))

#: Usual digit groups of cards, lengths of IBANs by country, and a bound of the characters of either.
CARD_GROUPS = frozenset({(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)})
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE BI", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BF CM CG DJ FR GA GR IT MC MG MR SM", 28: "AL AO AZ BJ BY CI CV CY DO GT GW HN HU LB ML MZ NE NI PL SN SV TG",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
LONGEST = 80
#: First digits of payment cards by issuer, with the lengths of their numbers.
ISSUERS = (
    ("4", {13, 16, 19}), ("5[1-5]", {16}), ("222[1-9]|22[3-9]|2[3-6]|27[01]|2720", {16}), ("3[47]", {15}), ("30[0-5]|3[689]", {14, 16, 17, 18, 19}), ("35(?:2[89]|[3-8])", {16, 17, 18, 19}),
    ("6011|64[4-9]|65", {16, 17, 18, 19}), ("62", {16, 17, 18, 19}), ("220[0-4]", {16, 17, 18, 19}), ("50|5[6-9]|6[0-9]", {13, 14, 15, 16, 17, 18, 19}),
)
_ISSUERS = tuple((re.compile(first), lengths) for first, lengths in ISSUERS)
#: Calling codes of one and two digits; all others have three.
CALLING_CODE = "(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-689][0-9]{2})"
_GROUP = re.compile("[0-9]+")
_IBAN_TAIL = re.compile("[A-Z0-9]+(?: [A-Z0-9]+)*")


class Feistel:
    """Keyed permutation of mixed-radix numbers: each round adds a hash of one half to the other, modulo its size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key).digest() if len(key) > 64 else key

    def _round(self, tweak: str, no: int, half: int, size: int) -> int:
        # as many digest bytes as the size needs, and eight more against bias
        need, out, part = (size.bit_length() + 7) // 8 + 8, b"", 0
        while len(out) < need:
            out += hashlib.blake2b(f"{tweak}|{no}|{part}|{half}".encode(), key=self.key, digest_size=64).digest()
            part += 1
        return int.from_bytes(out[:need], "big") % size

    def number(self, value: int, size: int, tweak: str, undo: bool = False) -> int:
        """Permutes 0 .. size - 1. Values beyond it, which the split by a square leaves room for, walk on."""
        if size < 2:
            return value
        left = int(size**0.5) + 1
        while True:
            a, b = divmod(value, left)
            value = self._halves(a, b, -(-size // left), left, tweak, undo)
            if value < size:
                return value

    def _halves(self, a: int, b: int, rows: int, columns: int, tweak: str, undo: bool) -> int:
        for no in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            sign = -1 if undo else 1
            if no % 2:
                b = (b + sign * self._round(tweak, no, a, columns)) % columns
            else:
                a = (a + sign * self._round(tweak, no, b, rows)) % rows
        return a * columns + b

    def digits(self, values: list[int], radixes: list[int], tweak: str, undo: bool = False) -> list[int]:
        """Permutes the digit strings of the given radixes."""
        size, value = 1, 0
        for v, r in zip(values, radixes, strict=True):
            size, value = size * r, value * r + v
        value, out = self.number(value, size, f"{tweak}|{','.join(map(str, radixes))}", undo), []
        for r in reversed(radixes):
            value, v = divmod(value, r)
            out.append(v)
        return out[::-1]

    def characters(self, text: str, tweak: str, undo: bool = False, classes: tuple[str, ...] = (DIGITS, UPPER, LOWER_CASE)) -> str:
        """Permutes the characters of the classes, each within its own; all others stay."""
        of = [next((c for c in classes if ch in c), None) for ch in text]
        own = [(c.index(ch), len(c)) for ch, c in zip(text, of, strict=True) if c]
        new = iter(self.digits([v for v, _ in own], [r for _, r in own], tweak, undo)) if own else iter(())
        return "".join(c[next(new)] if c else ch for ch, c in zip(text, of, strict=True))


def luhn_digit(payload: str) -> int:
    total = 0
    for k, ch in enumerate(reversed(payload)):
        d = int(ch) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    spelled = "".join(str(int(ch, 36)) for ch in rest + country + "00")
    return f"{98 - int(spelled) % 97:02d}"


def _fill(shape: str, digits: str) -> str:
    """The digits in place of those of the shape."""
    new = iter(digits)
    return "".join(next(new) if ch in DIGITS else ch for ch in shape)


def _plain(shape: str) -> str:
    return shape.replace(" ", "").replace("-", "")


def _is_issued(digits: str) -> bool:
    """Whether an issuer has numbers that begin like this and are as long."""
    return any(len(digits) in lengths and first.match(digits) for first, lengths in _ISSUERS)


def _is_card(shape: str) -> bool:
    digits = _plain(shape)
    return int(digits[-1]) == luhn_digit(digits[:-1]) and _is_issued(digits)


def _card(shape: str, f: Feistel, undo: bool) -> str:
    """The first four digits stay, as they tell the issuer: so no other issuer's number comes of it."""
    digits = _plain(shape)
    payload = digits[:4] + f.characters(digits[4:-1], f"card-{digits[:4]}", undo)
    return _fill(shape, payload + str(luhn_digit(payload)))


def _card_readings(text: str, runs: re.Pattern) -> Iterator[tuple[tuple, int, int]]:
    """(precedence, start, end) of what may be a card: 13 to 19 digits from a border of digit groups to another. Usual
    groupings come first, then the earlier start, then the longer reading."""
    for run in runs.finditer(text):
        groups = [(run.start() + g.start(), run.start() + g.end()) for g in _GROUP.finditer(run[0])]
        for i, (start, _) in enumerate(groups):
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                if digits > 19:
                    break
                if digits >= 13:
                    usual = tuple(b - a for a, b in groups[i : j + 1]) in CARD_GROUPS or i == j
                    yield (not usual, start, -digits), start, groups[j][1]


def _is_iban(shape: str) -> bool:
    plain = shape.replace(" ", "")
    return iban_check(plain[:2], plain[4:]) == plain[2:4]


def _iban(shape: str, f: Feistel, undo: bool) -> str:
    plain = shape.replace(" ", "")
    country, rest = plain[:2], f.characters(plain[4:], "iban-" + plain[:2], undo)
    chars = iter(country + iban_check(country, rest) + rest)
    return "".join(" " if ch == " " else next(chars) for ch in shape)


def _iban_readings(text: str, starts: re.Pattern) -> Iterator[tuple[tuple, int, int]]:
    """(precedence, start, end) of what may be an IBAN: readings of the country's length come first, then the earlier
    start, then the longer reading."""
    for begin in starts.finditer(text):
        start, chars = begin.start(), 0
        tail = _IBAN_TAIL.match(text, start)
        for at in range(start, tail.end()):
            chars += text[at] != " "
            if chars > 34:
                break
            if chars >= 15 and text[at] != " " and not text[at + 1 : at + 2].isalnum() and text[at + 1 : at + 2] != "_":
                yield (IBAN_LENGTHS.get(begin[0][:2]) != chars, start, -chars), start, at + 1


def _read(text: str, readings: Iterable, valid: Callable[[str], bool], change: Callable, f: Feistel, undo: bool, taken: list[tuple]) -> list[tuple[int, int, str]]:
    """(start, end, new value) of the valid readings that neither overlap one of higher precedence nor a taken span.

    A value on which a reading of higher precedence would become valid walks on to the next of its cycle, so that the
    new text is read as the old one was and can be undone. Readings change in order of place, or back in reverse.
    """
    blocked: list[tuple[int, int]] = []
    for a, b in sorted((x[0], x[1]) for x in taken):
        if blocked and a < blocked[-1][1]:
            blocked[-1] = (blocked[-1][0], max(b, blocked[-1][1]))
        else:
            blocked.append((a, b))
    all_ = [x for x in readings if not _overlaps(x[1:], blocked)]
    chosen: dict[tuple[int, int], tuple] = {}
    places: list[tuple[int, int]] = []
    for order, a, b in sorted(all_):
        if not _overlaps((a, b), places) and valid(text[a:b]):
            _insert(places, (a, b))
            chosen[a, b] = order
    if not chosen:
        return []
    all_.sort(key=lambda x: x[1:])
    at, chars, out = [x[1] for x in all_], list(text), []
    for a, b in reversed(places) if undo else places:
        near = [(o, c, d) for o, c, d in all_[bisect_left(at, a - LONGEST) : bisect_left(at, b)] if d > a and o < chosen[a, b]]
        rivals = [(c, d) for o, c, d in near if not any(p[1] > c and chosen[p] < o for p in places[bisect_left(places, (c - LONGEST, 0)) : bisect_left(places, (d, 0))])]
        while True:
            chars[a:b] = change("".join(chars[a:b]), f, undo)
            if valid("".join(chars[a:b])) and not any(valid("".join(chars[c:d])) for c, d in rivals):
                break
    for a, b in places:
        out.append((a, b, "".join(chars[a:b])))
    return out


def _ssn(m: re.Match, f: Feistel, undo: bool) -> str | None:
    area, group, serial = int(m["area"]), int(m["group"]), int(m["serial"])
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    area, group, serial = f.digits([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], "ssn", undo)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(m: re.Match, f: Feistel, undo: bool) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    return ".".join(map(str, f.digits([int(p) for p in parts], [256] * 4, "ip", undo)))


def _phone(m: re.Match, f: Feistel, undo: bool) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    keep = len(m["code"] or m["compact"] or m["spaced"] or m["first"] or m["area"] or "")
    if not (9 if m["area"] else 7) <= len(digits) <= 15 or not 7 <= len(digits) - keep:
        return None
    return _fill(m[0], digits[:keep] + f.characters(digits[keep:], f"phone-{digits[:keep]}", undo))


def _date(m: re.Match, f: Feistel, undo: bool) -> str | None:
    if m["y1"]:
        year, month, day = int(m["y1"]), int(m["mo1"]), int(m["d1"])
    else:
        year, a, b = int(m["y2"]), int(m["a2"]), int(m["b2"])
        # d.m.y and d/m/y, unless only m/d/y is a date
        month, day = (b, a) if b <= 12 else (a, b)
    try:
        date = datetime.date(year, month, day)
    except ValueError:
        return None
    swapped = not m["y1"] and int(m["b2"]) > 12
    first = datetime.date(max(1, year // 100 * 100), 1, 1)
    size = (datetime.date(year // 100 * 100 + 99, 12, 31) - first).days + 1
    # m/d/y with a day beyond 12 is a format of its own: its values are permuted among themselves
    if swapped:
        while True:
            date = first + datetime.timedelta(f.number((date - first).days, size, f"date-{year // 100}-mdy", undo))
            if date.day > 12:
                break
        return f"{date.month:0{len(m['a2'])}d}{m['s2']}{date.day:02d}{m['s2']}{date.year:04d}"
    narrow = not m["y1"] and (len(m["a2"]) == 1 or len(m["b2"]) == 1)
    date = first + datetime.timedelta(f.number((date - first).days, size, f"date-{year // 100}", undo))
    if m["y1"]:
        return f"{date.year:04d}{m['s1']}{date.month:02d}{m['s1']}{date.day:02d}"
    return f"{date.day}{m['s2']}{date.month}{m['s2']}{date.year:04d}" if narrow else f"{date.day:02d}{m['s2']}{date.month:02d}{m['s2']}{date.year:04d}"


def _email(m: re.Match, f: Feistel, undo: bool) -> str | None:
    return f.characters(m["name"], "email", undo, NAME_CLASSES) + "@" + m["host"]


def _access(m: re.Match, f: Feistel, undo: bool) -> str | None:
    return m[0][:4] + f.characters(m[0][4:], "access", undo, (UPPER + DIGITS,))


def _secret(m: re.Match, f: Feistel, undo: bool) -> str | None:
    value = m["value"]
    if re.fullmatch(r"[0-9a-f]+", value):
        return m["before"] + f.characters(value, "secret-hex", undo, ("0123456789abcdef",))
    return m["before"] + f.characters(value, "secret", undo)


#: (kind, pattern, replacement), in order of precedence.
FORMATS = (
    ("secret", re.compile(r"(?P<before>\b(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)(?P<value>[A-Za-z0-9+/_\-]{8,}(?=[\"'\s,;.]|\Z))", re.I), _secret),
    ("access", re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"), _access),
    ("email", re.compile(r"(?<![\w.%+-])(?P<name>[\w.%+\-]{1,64})@(?P<host>[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+)"), _email),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])"), _iban),
    ("card", re.compile(r"(?<![\w.+])[0-9]+(?:[ -][0-9]+)*(?!\w)"), _card),
    ("ssn", re.compile(r"(?<![\w-])(?P<area>\d{3})-(?P<group>\d{2})-(?P<serial>\d{4})(?![\w-])"), _ssn),
    ("date", re.compile(r"(?<![\w.-])(?:(?P<y1>\d{4})(?P<s1>[-/.])(?P<mo1>\d{2})(?P=s1)(?P<d1>\d{2})|(?P<a2>\d{1,2})(?P<s2>[./-])(?P<b2>\d{1,2})(?P=s2)(?P<y2>\d{4}))(?:(?![\w-]|\.\d)|(?(y1)(?=T\d{2}:?\d{2}(?!\d{3}))|(?!)))"), _date),
    ("ip", re.compile(r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"), _ip),
    ("phone", re.compile(rf"(?<![\w+])(?:\+(?P<compact>{CALLING_CODE})\d{{7,14}}|\+(?P<spaced>{CALLING_CODE})[ .-]\d{{1,5}}(?:[ .-]\d{{2,8}}){{1,4}}|(?:\+(?P<code>\d{{1,3}})[ .-]?)?\(\d{{2,4}}\)[ .-]?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,3}}|(?:\+(?P<first>\d{{1,3}})[ .-])?\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}|(?P<area>0[1-9])(?:(?:[ .-]\d{{2}}){{4}}|\d{{1,3}}[ /-]\d{{5,8}}))(?![\w-]|[ .]\d)"), _phone),
)
#: Formats of which several readings are tried.
READINGS = {"iban": (_iban_readings, _is_iban), "card": (_card_readings, _is_card)}


def replace(text: str, feistel: Feistel, undo: bool = False) -> tuple[str, list[str]]:
    """The text with its values permuted, and the kinds found, in order of place."""
    found: list[tuple[int, int, str, str]] = []
    has_digit = any(ch in text for ch in DIGITS)
    for kind, pattern, change in FORMATS:
        if kind == "email" and "@" not in text or kind not in ("email", "secret") and not has_digit:
            continue
        if kind in READINGS:
            readings, valid = READINGS[kind]
            found += [(a, b, kind, new) for a, b, new in _read(text, readings(text, pattern), valid, change, feistel, undo, found)]
            continue
        for m in pattern.finditer(text):
            new = change(m, feistel, undo)
            if new is not None:
                found.append((m.start(), m.end(), kind, new))
    if not found:
        return text, []
    taken, end = [], 0
    rank = {k: n for n, (k, _, _) in enumerate(FORMATS)}
    chosen: list[tuple[int, int, str, str]] = []
    for span in sorted(found, key=lambda x: (rank[x[2]], x[0])):  # few per text
        if all(span[1] <= o[0] or span[0] >= o[1] for o in chosen[-64:]) and not _overlaps(span, taken):
            chosen.append(span)
            _insert(taken, span)
    out = []
    for a, b, _, new in sorted(chosen):
        out += [text[end:a], new]
        end = b
    return "".join([*out, text[end:]]), [k for _, _, k, _ in sorted(chosen)]


def _overlaps(span: tuple, taken: list[tuple[int, int]]) -> bool:
    k = bisect_left(taken, (span[0], span[1]))
    return k < len(taken) and taken[k][0] < span[1] or k > 0 and taken[k - 1][1] > span[0]


def _insert(taken: list[tuple[int, int]], span: tuple) -> None:
    insort(taken, (span[0], span[1]))


def _candidates(column: pa.Array) -> pa.Array:
    """Which texts can hold a value: an Arrow search spares all others the Python patterns."""
    return pc.fill_null(pc.match_substring_regex(column, "[0-9@]|(?i:password|passwd|pwd|token|secret|api[_-]?key)"), False)


def _changed(batch: pa.RecordBatch, feistel: Feistel) -> tuple[pa.Array, list[list[str]]]:
    column = batch.column("text")
    texts, kinds = column.to_pylist(), [[] for _ in range(len(column))]
    for i, maybe in enumerate(_candidates(column).to_pylist()):
        if maybe:
            texts[i], kinds[i] = replace(texts[i], feistel)
    return pa.array(texts, column.type), kinds


def key_of(spark: SparkSession) -> bytes:
    """The session's key."""
    given = spark.conf.get(KEY_SETTING, None)
    if not given:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms use a key that everyone knows", stacklevel=2)
    return given.encode() if given else DEMO_KEY


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """The documents with their personal data permuted; all columns pass through. One pass, no shuffle."""
    feistel, at = Feistel(key), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), _changed(batch, feistel)[0])
        release_memory()

    return small_batches(docs).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def pii_report(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per document: doc_id, n_found, kinds (comma-joined, in order of place), text."""
    feistel = Feistel(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = _changed(batch, feistel)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(k) for k in kinds], pa.int64()), pa.array([",".join(k) for k in kinds], pa.string()), texts], ["doc_id", "n_found", "kinds", "text"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_found long, kinds string, text string")


def op8_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"), key_of(spark))
