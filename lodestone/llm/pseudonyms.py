"""Operator 4, PII: format-preserving Feistel pseudonyms.

Numbers and dates that pass their validation are replaced by a keyed permutation
of their own format: digits stay digits, a card number keeps a right check digit,
a date stays a real date in the same notation.  Equal values get equal
pseudonyms in all documents, whatever their punctuation, case or notation, and the
key holder can invert them.  Prefixes, domains and punctuation stay.  Only where
digits stand next to each other so that the pseudonym would be read in other parts,
a value gets the pseudonym of its pseudonym, so that the text can be inverted.
"""

from __future__ import annotations

import datetime
import hmac
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lodestone.llm.tables import row_of

KINDS = ("email", "card", "iban", "ssn", "phone", "ipv4", "date")
ROUNDS = 8


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of the integers below a bound."""

    key: bytes

    def _round(self, i: int, tweak: bytes, value: int, below: int) -> int:
        digest = hmac.digest(self.key, b"%d|%s|%d|%d" % (i, tweak, value, below), "sha256")
        return int.from_bytes(digest, "big") % below

    def permute(self, value: int, below: int, tweak: bytes, back: bool = False) -> int:
        """An alternating Feistel network over left * b + right with a * b >= below;
        values beyond the bound are permuted again until one is below it."""
        if not 0 <= value < below:
            raise ValueError("value out of range")
        if below == 1:
            return 0
        b = math.isqrt(below - 1) + 1
        a = -(-below // b)
        while True:
            left, right = divmod(value, b)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if i % 2:
                    right = (right + sign * self._round(i, tweak, left, b)) % b
                else:
                    left = (left + sign * self._round(i, tweak, right, a)) % a
            value = left * b + right
            if value < below:
                return value

    def until(self, value: int, below: int, tweak: bytes, allowed: Callable[[int], bool], back: bool = False) -> int:
        """The permutation of the allowed values that repeated permuting gives."""
        while True:
            value = self.permute(value, below, tweak, back)
            if allowed(value):
                return value


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """The digits in the places of the digits of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _card(f: Feistel, text: str, back: bool) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or d[0] not in "23456" or luhn_digit(d[:-1]) != d[-1]:
        return None
    n = len(d) - 2
    new = d[0] + str(f.permute(int(d[1:-1]), 10**n, b"card" + d[0].encode(), back)).zfill(n)
    return _refill(text, new + luhn_digit(new))


#: The length of an IBAN by country, of the public registry.
IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
        "GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
        "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_IBAN = {n: re.compile(rf"[A-Za-z]{{2}}[0-9]{{2}}(?:[ -]?[A-Za-z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    """Letters stay, in their case; the digits of the account part are permuted and the check digits made anew."""
    s = re.sub("[ -]", "", text).upper()
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if len(s) != IBAN_LENGTHS.get(s[:2]) or number(s[4:] + s[:4]) % 97 != 1:
        return None
    d = _digits(s[4:])
    shape = re.sub(r"\d", "0", s[4:])
    account = _refill(s[4:], str(f.permute(int(d), 10 ** len(d), f"iban{s[:2]}{shape}".encode(), back)).zfill(len(d))) if d else s[4:]
    return _refill(text, str(98 - number(account + s[:2] + "00") % 97).zfill(2) + _digits(account))


def _ssn(f: Feistel, text: str, back: bool) -> str | None:
    def good(v: int) -> bool:
        area, group, serial = v // 10**6, v // 10**4 % 100, v % 10**4
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    v = int(_digits(text))
    if not good(v):
        return None
    return _refill(text, str(f.until(v, 10**9, b"ssn", good, back)).zfill(9))


def _phone(f: Feistel, text: str, back: bool) -> str | None:
    """Ten North American digits are valid if neither area nor exchange begins with 0 or 1, and stay so;
    those that are not need a leading +1.  Others keep their first three digits: the country code or the area."""
    d = _digits(text)
    if not text.startswith(("+", "0", "00")) and not (len(d) == 9 and text[0] in "6789") or d[:1] == "1":
        national = d[-10:]
        if len(d) not in (10, 11) or len(d) == 11 and d[0] != "1":
            return None

        def good(v: int) -> bool:
            s = str(v).zfill(10)
            return s[0] >= "2" and s[3] >= "2"

        valid = good(int(national))
        if not valid and not text.startswith("+"):
            return None
        return _refill(text, d[:-10] + str(f.until(int(national), 10**10, b"phone", lambda v: good(v) == valid, back)).zfill(10))
    if not 9 <= len(d) <= 15:
        return None
    n = len(d) - 3
    return _refill(text, d[:3] + str(f.permute(int(d[3:]), 10**n, b"phone" + d[:3].encode(), back)).zfill(n))


def _ipv4(f: Feistel, text: str, back: bool) -> str | None:
    """Private and local ranges stay.  Others are permuted within their class: host addresses, and
    those that begin with 0 or with 224 and more."""
    parts = text.split(".")
    if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
        return None

    def local(v: int) -> bool:
        a, b = v >> 24, v >> 16 & 255
        return a in (10, 127) or (a, b) in ((169, 254), (192, 168)) or a == 172 and 16 <= b < 32

    def host(v: int) -> bool:
        return 0 < v >> 24 < 224

    v = int.from_bytes(bytes(map(int, parts)), "big")
    if local(v):
        return None
    of_host = host(v)
    allowed = lambda x: host(x) == of_host and not local(x)
    return ".".join(map(str, f.until(v, 1 << 32, b"ipv4", allowed, back).to_bytes(4, "big")))


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(f: Feistel, text: str, back: bool) -> str | None:
    """yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd/mm/yyyy, or mm/dd/yyyy where only that is a date.

    A day is permuted once, whatever its notation.  Days after the 12th of a month stay such
    days, so that a date with slashes is read in the same order again."""
    sep = next(c for c in text if not c.isdigit())
    parts = text.split(sep)
    orders = ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1)) if sep == "/" else ((2, 1, 0),)
    for order in orders:
        try:
            day = datetime.date(*(int(parts[i]) for i in order))
        except ValueError:
            continue
        if not _FIRST <= day.toordinal() <= _LAST:
            return None
        late = day.day > 12
        allowed = lambda v: (datetime.date.fromordinal(_FIRST + v).day > 12) == late  # noqa: B023, E731
        new = datetime.date.fromordinal(_FIRST + f.until(day.toordinal() - _FIRST, _LAST - _FIRST + 1, b"date", allowed, back))
        values = {order[0]: f"{new.year:04}", order[1]: f"{new.month:02}", order[2]: f"{new.day:02}"}
        return sep.join(values[i] for i in range(3))
    return None


_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _email(f: Feistel, text: str, back: bool) -> str | None:
    """Letters of the local part stay letters of their case, digits stay digits; the domain stays."""
    local, _, domain = text.rpartition("@")
    radix = [10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 1 for c in local]
    value, below = 0, 1
    for c, r in zip(local, radix):
        value = value * r + (0 if r == 1 else int(c) if r == 10 else _LOWER.index(c.lower()))
        below *= r
    if below == 1:
        return None
    shape = "".join("9" if r == 10 else "a" if r == 26 else c for c, r in zip(local, radix))
    value = f.permute(value, below, f"email{shape}@{domain.lower()}".encode(), back)
    out = []
    for c, r in zip(reversed(local), reversed(radix)):
        value, x = divmod(value, r)
        out.append(c if r == 1 else str(x) if r == 10 else _LOWER[x].upper() if c.isupper() else _LOWER[x])
    return "".join(reversed(out)) + "@" + domain


#: What stands between groups of digits: one or two spaces, which may be no-break ones, or a hyphen.
_SPACE = r"[ \xa0\u2007\u202f]"
_GAP = rf"(?:{_SPACE}{{1,2}}|-)"
#: Fixed values, of the national plans: North American numbers; + or 00 and a country code; ten French digits in pairs;
#: German area codes of two to five digits and a number; nine Spanish digits.  Without any gap only the first of these are read.
_PHONE = rf"""(?:(?:\+?1(?:{_SPACE}{{1,2}}|[.-])?)?(?:\([0-9]{{3}}\)(?:{_SPACE}{{1,2}}|[.-])?|[0-9]{{3}}(?:{_SPACE}{{1,2}}|[.-]))[0-9]{{3}}(?:{_SPACE}{{1,2}}|[.-])[0-9]{{4}}
        |\+[0-9]{{1,3}}(?:(?:{_SPACE}{{1,2}}|[.-])?\([0-9]{{1,4}}\))?(?:(?:{_SPACE}{{1,2}}|[.-])?[0-9]{{1,8}}){{1,5}}
        |00[1-9][0-9](?:(?:{_SPACE}{{1,2}}|[.-])[0-9]{{1,8}}){{1,5}}
        |0[1-9](?P<fr>{_SPACE}{{1,2}}|[.-])[0-9]{{2}}(?P=fr)[0-9]{{2}}(?P=fr)[0-9]{{2}}(?P=fr)[0-9]{{2}}
        |0[1-9][0-9]{{1,3}}(?:{_SPACE}{{1,2}}|[/-])[0-9]{{3,8}}(?:(?:{_SPACE}|-)[0-9]{{2,4}})?
        |[6-9][0-9]{{2}}(?P<es>{_SPACE}|[.-])(?:[0-9]{{3}}(?P=es)[0-9]{{3}}|[0-9]{{2}}(?P=es)[0-9]{{2}}(?P=es)[0-9]{{2}}))(?![0-9A-Za-z]|[.,-][0-9])"""
#: Where a value may be; what may begin there; what an e-mail may begin with.
_HIT = re.compile("[0-9]+|@", re.ASCII)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_BEGIN = re.compile(
    r"""(?P<ipv4>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))
    |(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-]|\.[0-9]))
    |(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
    |(?P<card>(?<![0-9+-])(?<![0-9]\.)[0-9](?:"""
    + _GAP
    + r"""?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9]))
    |(?P<phone>(?<![0-9A-Za-z+-])(?<![0-9]\.)"""
    + _PHONE
    + ")",
    re.ASCII | re.VERBOSE,
)
_KINDS_HERE = ("ipv4", "date", "ssn", "card", "phone")


def _word_before(text: str, at: int, longest: int = 20) -> bool:
    """Whether what touches the digits at ``at`` is nothing, or a word of letters only, such as VISA."""
    start = at
    while start > max(0, at - longest) and text[start - 1].isalpha():
        start -= 1
    return start == at or start > at - longest and (not start or text[start - 1] not in "0123456789_.@%+-")


#: A run of digit groups, without the beginning of an address or date; its groups, and what can begin at one.
_RUN = re.compile(rf"[0-9](?:{_GAP}?[0-9])*(?![0-9A-Za-z@_%+]|[.-][0-9]|/[0-9]{{2}}/)", re.ASCII)
_GROUP = re.compile(r"[0-9]+", re.ASCII)
_IN_RUN = {
    "date": re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9/-]|\.[0-9])", re.ASCII), "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", re.ASCII), "phone": re.compile(_PHONE, re.ASCII | re.VERBOSE),
}
#: How cards are usually grouped; as such they come before phones, in other groups after them.
_CARD_GROUPS = re.compile(rf"\d{{13,19}}|\d{{4}}({_GAP})\d{{4}}\1\d{{4}}\1\d{{1,4}}(?:\1\d{{1,3}})?|\d{{4}}({_GAP})\d{{6}}\2\d{{4,5}}", re.ASCII)
#: A value changes only how values are read that begin at most so many values before it: cards have 19 digits at most, dates 8.
_NEAR = 3
_MAKE: dict[str, Callable[[Feistel, str, bool], str | None]] = {
    "email": _email, "card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "ipv4": _ipv4, "date": _date,
}


class Pseudonymizer:
    """Replaces the values in a text; ``back`` restores the originals."""

    def __init__(self, key: bytes, kinds: tuple[str, ...] = KINDS, back: bool = False):
        self.feistel, self.kinds, self.back = Feistel(key), kinds, back
        self.known: dict[tuple[str, str], str | None] = {}

    def value(self, kind: str, text: str) -> str | None:
        """The pseudonym of one value; None if it is not valid."""
        if kind not in self.kinds:
            return None
        at = (kind, text)
        if at not in self.known:
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[at] = _MAKE[kind](self.feistel, text, self.back)
        return self.known[at]

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with its pseudonyms, and how many values of each kind it had."""
        counts: dict[str, int] = {}
        out: list[str] = []
        done = at = 0
        while (hit := _HIT.search(text, at)) is not None:
            found = self._value_at(text, hit.start(), done)
            if found is None:
                at = hit.end()
                continue
            start, at, new, kinds = found
            out += (text[done:start], new)
            done = at
            for k in kinds:
                counts[k] = counts.get(k, 0) + 1
        out.append(text[done:])
        return "".join(out), counts

    def _value_at(self, text: str, at: int, done: int) -> tuple[int, int, str, list[str]] | None:
        """Start, end, pseudonym and kinds of what is around the digits or the at sign at ``at``, not before ``done``."""
        if text.find("@", at, at + 65) >= 0:
            start = at
            while start > max(done, at - 64) and text[start - 1] in _LOCAL:
                start -= 1
            m = _EMAIL.match(text, start)
            if m and m.end() > at and (new := self.value("email", m[0])) is not None:
                return start, m.end(), new, ["email"]
        if text[at] == "@":
            return None
        if at - 2 >= done and (n := IBAN_LENGTHS.get(text[at - 2 : at].upper())) and (at == 2 or not text[at - 3].isalnum()):
            m = _IBAN[n].match(text, at - 2)
            if m and (new := self.value("iban", m[0])) is not None:
                return at - 2, m.end(), new, ["iban"]
        for start in (at - 1, at) if at > done and text[at - 1] in "+(" else (at,):
            m = _BEGIN.match(text, start)
            if m is None:
                continue
            kind, end = next(k for k in _KINDS_HERE if m[k] is not None), m.end()
            if kind == "card" and not _word_before(text, start):
                continue
            if kind == "card":
                run = _RUN.match(text, start)
                end = run.end() if run else end
                return start, end, *self._run(text[start:end])
            if kind == "phone":
                end = self._phone_end(text, start, end)
            if (new := self.value(kind, text[start:end])) is not None:
                return start, end, new, [kind]
        return None

    def _phone_end(self, text: str, start: int, end: int) -> int:
        """Where a phone number ends: groups that make it too long are not its own."""
        for b in reversed([m.end() for m in _GROUP.finditer(text, start, end)]):
            if self.value("phone", text[start:b]) is not None:
                return b
        return end

    def _run(self, run: str) -> tuple[str, list[str]]:
        """A run of digit groups with pseudonyms, and the kinds of its values.

        One value after the other (backwards the last one first, so the others are then as they
        were) is permuted until the values around it are read as before."""
        groups = [m.span() for m in _GROUP.finditer(run)]
        parts = list(self._parts(run, groups, 0))
        chars = list(run)
        for i in reversed(range(len(parts))) if self.back else range(len(parts)):
            a, b, kind = parts[i]
            first = max(i - _NEAR, 0)
            lo = parts[first - 1][1] if first else 0
            near = parts[first : i + 1]
            hi = groups[min(bisect_left(groups, (b, 0)) + 19, len(groups) - 1)][1]
            within = groups[bisect_left(groups, (lo, 0)) : bisect_right(groups, (hi, hi))]
            shifted = [(x - lo, y - lo) for x, y in within]
            value = run[a:b]
            while True:
                value = self.value(kind, value)
                chars[a:b] = value
                if [(x + lo, y + lo, k) for x, y, k in islice(self._parts("".join(chars[lo:hi]), shifted, 0), len(near))] == near:
                    break
        return "".join(chars), [kind for _, _, kind in parts]

    def _parts(self, run: str, groups: list[tuple[int, int]], at: int) -> Iterator[tuple[int, int, str]]:
        """The values in a run: from each group on the longest card as cards are grouped, else a date, SSN or
        phone, else the longest card of whole groups."""
        for i, (a, _) in enumerate(groups):
            if a < at:
                continue
            ends, n = [], 0
            for first, last in groups[i : i + 19]:
                n += last - first
                if 13 <= n <= 19:
                    ends.insert(0, last)
            usual = [b for b in ends if _CARD_GROUPS.fullmatch(run, a, b)]
            found = [(b, "card") for b in usual] + [(m.end(), kind) for kind, p in _IN_RUN.items() if (m := p.match(run, a)) is not None] + [(b, "card") for b in ends if b not in usual]
            for b, kind in found:
                if self.value(kind, run[a:b]) is not None:
                    yield a, b, kind
                    at = b
                    break


def pseudonymize(documents: DataFrame, key: str, kinds: tuple[str, ...] = KINDS, keep: tuple[str, ...] = (), back: bool = False) -> DataFrame:
    """doc_id, the columns ``keep``, text with pseudonyms, and a count for each kind.

    Only documents with a digit or an at sign go to Python.  A null text stays null with
    counts of 0, an empty one empty; null ids stay null, repeated rows give repeated
    results, an empty table an empty result.  A value that fails its validation stays as
    it is.  ``key`` is the secret of the permutation; ``back`` undoes it, for texts
    of which nothing else was changed."""
    names = ("doc_id", *keep)
    counts = [f"n_{k}" for k in KINDS]
    fields = [*documents.select(*names).schema, StructField("text", StringType()), *(StructField(c, IntegerType()) for c in counts)]
    schema = StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Pseudonymizer(key.encode(), kinds, back)
        for batch in batches:
            texts, found = [], []
            for text in batch.column(len(names)).to_pylist():
                new, n = maker.text(text)
                texts.append(new)
                found.append(n)
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), *(pa.array([n.get(k, 0) for n in found], pa.int32()) for k in KINDS)], names=[*names, "text", *counts]
            )

    rows = documents.select(*names, "text")
    suspect = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    clean = rows.filter(~suspect).select(*names, "text", *(F.lit(0).alias(c) for c in counts))
    return clean.unionByName(rows.filter(suspect).mapInArrow(run, schema))


def pseudonymized(documents: DataFrame, key: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``documents`` with pseudonyms in ``text``, in the same columns; where a text
    has changed, ``n_chars`` is its new length.  Other cases as in ``pseudonymize``."""
    rows = documents.select(row_of([c for c in documents.columns if c != "text"]).alias("doc_id"), "text")
    done = pseudonymize(rows, key, kinds)
    found = F.lit(0)
    for kind in KINDS:
        found = found + F.col(f"n_{kind}")
    own = {c: F.col("doc_id").getField(c).alias(c) for c in documents.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in own:
        as_type = documents.schema["n_chars"].dataType
        own["n_chars"] = F.when(found > 0, F.length("text").cast(as_type)).otherwise(F.col("doc_id").getField("n_chars")).alias("n_chars")
    return done.select(*(own[c] for c in documents.columns))
