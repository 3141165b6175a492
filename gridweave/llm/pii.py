"""Format-preserving pseudonyms: validated numbers, dates and addresses, permuted by a keyed Feistel network."""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, whole

ROUNDS = 10
#: Who has the key can undo pseudonyms: this one is for the registered query and tests alone.
QUERY_KEY = b"gridweave-pseudonyms"
KINDS = ("email", "iban", "date", "ip", "phone", "ssn", "number")

#: Each form starts at a word's edge and is bounded, so a scan is linear. Forms look at the class of a character only, which pseudonyms keep.
_FORMS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9@])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "date": r"(?<![\w/-])(?:\d{4}(?P<s1>[-/.])\d{2}(?P=s1)\d{2}|\d{2}(?P<s2>[-/.])\d{2}(?P=s2)\d{4})(?!(?![Tt]\d)[\w/-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[\x20.-]?\(?\d{2,4}\)?[\x20.-]?\d{3,4}[\x20.-]?\d{3,4}|\(\d{3}\)\x20?\d{3}[\x20.-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
    # in pairs: after a country code, or ten digits from 01 to 09 that are no part of a longer row of pairs
    r"|\+\d{1,3}[\x20.-]?(?:\(0\)\x20?)?(?:\d(?P<s5>[\x20.-])\d{2}(?:(?P=s5)\d{2}){3}|\d{2,4}(?P<s6>[\x20.-])\d{2}(?:(?P=s6)\d{2}){2,3}|\d{1,4}(?P<s7>[\x20.-])\d{3}(?:(?P=s7)\d{2}){2})"
    r"|(?<!\d\d[\x20.-])0[1-9](?P<s8>[\x20.-])\d{2}(?:(?P=s8)\d{2}){3}(?!(?P=s8)\d\d(?![\w@])|-[A-Za-z0-9]{2}(?![\w@])))(?!\d)",
    "number": r"(?<![A-Za-z0-9.-])(?:\d{13,19}|\d{4}(?P<s3>[\x20-])\d{4}(?P=s3)\d{4}(?P=s3)\d{1,7}|\d{4}(?P<s4>[\x20-])\d{6}(?P=s4)\d{5})(?![A-Za-z0-9-])",
}
#: No form but an address is longer, and addresses do not fail.
MOST = 64
_FORM = {k: re.compile(p, re.ASCII) for k, p in _FORMS.items()}
_PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _FORMS.items()), re.ASCII)
#: Characters of an IBAN by country.
IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in cs.split()}
_IBAN = {n: re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){%d}%s(?![A-Za-z0-9])" % ((n - 4) // 4, r"\x20?[A-Z0-9]{%d}" % (n % 4) if n % 4 else "")) for n in set(IBAN_LENGTHS.values())}
_ANY = re.compile(r"[0-9@]")


class Feistel:
    """A keyed permutation of 0 .. n - 1: an unbalanced mixed-radix network, walked along its cycle into range."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.a = max(1, int(n**0.5))
        while self.a * self.a < n:
            self.a += 1
        self.key, self.tweak = hashlib.blake2b(key, digest_size=32).digest(), f"{tweak}:{n}:".encode()

    def _round(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(self.tweak + b"%d:%d" % (i, x), key=self.key, digest_size=16).digest(), "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.a)
        for i in range(ROUNDS):
            left, right = right, (left + self._round(i, right)) % self.a
        return left * self.a + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.a)
        for i in reversed(range(ROUNDS)):
            left, right = (right - self._round(i, left)) % self.a, left
        return left * self.a + right

    def __call__(self, x: int) -> int:
        x = self._once(x)
        while x >= self.n:  # the square is less than twice as large for n > 8, so few steps
            x = self._once(x)
        return x

    def invert(self, x: int) -> int:
        x = self._back(x)
        while x >= self.n:
            x = self._back(x)
        return x


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _refill(template: str, new: str, keep: Callable[[str], bool] = str.isdigit) -> str:
    """template with the characters that keep picks replaced by those of new, in turn."""
    it = iter(new)
    return "".join(next(it) if keep(c) else c for c in template)


class Pseudonyms:
    """Pseudonyms under one key. A value of a kind and format goes to another of that kind and format, one to one."""

    def __init__(self, key: bytes, invert: bool = False):
        self.key, self.invert, self.networks = key, invert, {}

    def permuted(self, tweak: str, n: int, x: int) -> int:
        f = self.networks.get((tweak, n)) or self.networks.setdefault((tweak, n), Feistel(self.key, tweak, n))
        return f.invert(x) if self.invert else f(x)

    def digits(self, tweak: str, s: str) -> str:
        return str(self.permuted(tweak, 10 ** len(s), int(s))).zfill(len(s))

    def number(self, s: str) -> str | None:
        """Card and account numbers with a valid Luhn sum; the check digit is computed anew."""
        d = re.sub(r"\D", "", s)
        if luhn(d):
            return None
        body = self.digits("number", d[:-1])
        return _refill(s, body + str(-luhn(body + "0") % 10))

    def phone(self, s: str) -> str:
        """The country code after a plus stays, and the leading 0 of ten digits in pairs."""
        if s[0] == "0":
            return _refill(s, f"{10**8 + self.permuted('phone0', 9 * 10**8, int(re.sub(r'\D', '', s)) - 10**8):010d}")
        head = re.match(r"\+\d{1,3}(?:[\x20.-]?\(0\)|(?=[\x20.(-]))", s)
        at = head.end() if head else 0
        d = re.sub(r"\D", "", s[at:])
        return s[:at] + _refill(s[at:], self.digits("phone", d))

    def ssn(self, s: str) -> str | None:
        """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
        area, group, serial = map(int, s.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        area -= 1 + (area > 666)
        x = self.permuted("ssn", 898 * 99 * 9999, (area * 99 + group - 1) * 9999 + serial - 1)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        area += 1
        return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def ip(self, s: str) -> str | None:
        """Octets of 0 to 255 without leading zeros, permuted within their widths' values."""
        parts = s.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        low, size = zip(*(((0, 10), (10, 90), (100, 156))[len(p) - 1] for p in parts), strict=True)
        x = n = 0
        for p, a, k in zip(parts, low, size, strict=True):
            x, n = x * k + int(p) - a, max(n, 1) * k
        x = self.permuted("ip" + ",".join(map(str, size)), n, x)
        out = []
        for a, k in zip(reversed(low), reversed(size), strict=True):
            x, r = divmod(x, k)
            out.append(str(a + r))
        return ".".join(reversed(out))

    def date(self, s: str) -> str | None:
        """Real days of 1900 to 2099; a day first or a month first date stays what it can be read as."""
        form = "%Y{0}%m{0}%d".format(s[4]) if s[:4].isdigit() else "%d{0}%m{0}%Y".format(s[2])
        for form in (form, form.replace("%d", "%x").replace("%m", "%d").replace("%x", "%m")) if form[1] == "d" else (form,):
            try:
                day = datetime.datetime.strptime(s, form).date()  # noqa: DTZ007
            except ValueError:
                continue
            first = datetime.date(1900, 1, 1).toordinal()
            days = datetime.date(2100, 1, 1).toordinal() - first
            if not 0 <= day.toordinal() - first < days:
                return None
            if form[1] != "m":
                return datetime.date.fromordinal(first + self.permuted("date", days, day.toordinal() - first)).strftime(form)
            # month first: among the days that cannot be read day first (13 to 31), by their place
            good, at = _late_days()
            return datetime.date.fromordinal(good[self.permuted("date-m", len(good), at[day.toordinal()])]).strftime(form)
        return None

    def iban(self, s: str) -> str | None:
        """Checked modulo 97; country and format stay, check digits are computed anew."""
        raw = s.replace(" ", "")
        number = lambda x: int("".join(str(int(c, 36)) for c in x)) % 97
        if not 15 <= len(raw) <= 34 or number(raw[4:] + raw[:4]) != 1:
            return None
        body = raw[4:]
        x, n = 0, 1
        for c in body:
            k = 10 if c.isdigit() else 26
            x, n = x * k + (int(c) if c.isdigit() else ord(c) - 65), n * k
        x, out = self.permuted("iban" + re.sub("[A-Z]", "A", re.sub(r"\d", "0", body)), n, x), []
        for c in reversed(body):
            x, r = divmod(x, 10 if c.isdigit() else 26)
            out.append(str(r) if c.isdigit() else chr(65 + r))
        body = "".join(reversed(out))
        return _refill(s, raw[:2] + f"{98 - number(body + raw[:2] + '00'):02d}" + body, lambda c: c != " ")

    def email(self, s: str) -> str:
        """Letters and digits of the local part are permuted within their classes; the domain stays."""
        local, domain = s.rsplit("@", 1)
        sizes = [10 if c.isdigit() else 26 for c in local if c.isalnum()]
        form = re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", local)))
        x, n = 0, 1
        for c, k in zip(filter(str.isalnum, local), sizes, strict=True):
            x, n = x * k + (int(c) if k == 10 else ord(c.lower()) - 97), n * k
        if n == 1:
            return s
        x, out = self.permuted("email" + form, n, x), []
        for c in reversed(local):
            if c.isalnum():
                x, r = divmod(x, 10 if c.isdigit() else 26)
                c = str(r) if c.isdigit() else chr((65 if c.isupper() else 97) + r)
            out.append(c)
        return "".join(reversed(out)) + "@" + domain

    def _find(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """What is valid, and what has a kind's form but fails its check; the search goes on inside the latter."""
        spans: list[tuple[int, int, str]] = []
        failed: list[tuple[int, int, str]] = []
        at = 0
        while m := _PATTERN.search(text, at):
            start, at = m.start(), m.start() + 1
            for end, kind in _readings(text, m):
                if getattr(self, kind)(text[start:end]) is not None:
                    spans.append((start, end, kind))
                    at = end
                    break
                failed.append((start, end, kind))
        return spans, failed

    def rewrite(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and (start, end, kind) of each in the original's code points.

        Pseudonyms are as long as their values. One that would make valid what
        failed around it is permuted once more, as the text could not be restored.
        """
        if not _ANY.search(text):
            return text, []
        spans, failed = self._find(text)
        if not spans:
            return text, spans
        out, starts = list(text), [a for a, _, _ in failed]
        for start, end, kind in reversed(spans) if self.invert else spans:
            new = "".join(out[start:end])
            around = [f for f in failed[bisect_left(starts, start - MOST) : bisect_left(starts, end)] if f[1] > start]
            while True:
                new = getattr(self, kind)(new)
                out[start:end] = new
                if all(getattr(self, k)("".join(out[a:b])) is None for a, b, k in around):
                    break
        return "".join(out), spans


def _readings(text: str, m: re.Match) -> Iterator[tuple[int, str]]:
    """(end, kind) of all that may start where m does: an IBAN by its country's length, then what m is, then later kinds."""
    kinds = list(_FORMS)
    kind = next(k for k in kinds if m[k] is not None)
    if kind == "iban" and (form := _IBAN.get(IBAN_LENGTHS.get(m[0][:2], 0))) and (own := form.match(text, m.start())) and own.end() != m.end():
        yield own.end(), kind
    yield m.end(), kind
    for later in kinds[kinds.index(kind) + 1 :]:
        if other := _FORM[later].match(text, m.start()):
            yield other.end(), later


@cache
def _late_days() -> tuple[list[int], dict[int, int]]:
    """The days of 1900 to 2099 after a month's 12th, and the place of each; made once for each worker."""
    first, end = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()
    good = [d for d in range(first, end) if datetime.date.fromordinal(d).day > 12]
    return good, {d: i for i, d in enumerate(good)}


def pseudonymize(docs: DataFrame, key: bytes, invert: bool = False) -> DataFrame:
    """doc_id, text and spans of every row: each valid value is replaced by its pseudonym.

    Numbers of 13 to 19 digits with a valid Luhn sum, IBANs, phone and social
    security numbers, IPv4 addresses, dates and mail addresses are checked where
    their kind has a check, and keyed-permuted within their format; equal values
    stay equal in all documents and different ones different. key has no default,
    as its holder can undo every pseudonym. What fails its check stays as it is,
    but what lies in it is looked at on its own. An IBAN ends where its country's
    length says, else with its longest match. invert restores the original texts.
    One pass, no shuffle; whole texts.

    Null text gives an empty text. Other columns of docs are ignored; each row
    gives a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, invert)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for b in batches:
            done = [names.rewrite(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([[{"start": x, "end": y, "kind": k} for x, y, k in s] for _, s in done], span)], names=["doc_id", "text", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")).mapInArrow(run, "doc_id long, text string, spans array<struct<start:int,end:int,kind:string>>")


def query(spark, sf_dir: str) -> DataFrame:
    out = pseudonymize(documents(spark, sf_dir), QUERY_KEY)
    count = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", "text", *map(count, KINDS))
