"""Format-preserving pseudonyms by a keyed Feistel permutation (op5).

Values are found by pattern, validated (Luhn, mod 97, octets, calendar, number
plans), turned into a rank within their format, permuted by a modular Feistel
network keyed per format, with cycle walking back into the format, and written
in the places of the old characters: separators and letter case stay, check
digits are computed anew. Equal values get equal pseudonyms in every document,
whatever their separators, and the permutation can be undone with the key.

Formats: card numbers, IBAN, US social security and telephone numbers, other
international numbers, IPv4 addresses, dates from 1900 to 2099, the local part
of mail addresses, and keys or passwords (digits and letters keep their kind).

Defined cases: null text stays null with no finds; empty text stays empty;
values that fail validation stay, as do version numbers; dates keep the digits
of day and month, so their widths; repeated rows are treated alike; an empty
table gives no rows; further columns pass through untouched, but
for one named ``n_replaced``.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

PATTERN = re.compile(
    r"(?P<mail>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+(?=@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+))"
    r"|(?P<key>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))"
    r"|(?i:(?P<name>(?<![A-Za-z])(?:token|password|passwd|secret|api[_-]?key)\s?[=:]\s?[\"']?)(?P<secret>[A-Za-z0-9+/_\-]{8,}))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\d.])(?<![Vv])(?<![Vv]ersion )\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))"
    r"|(?P<iso>(?<![\d-])\d{4}(?P<s1>[-/.])\d{2}(?P=s1)\d{2}(?![\d-]))"
    r"|(?P<dmy>(?<![\d./])\d{1,2}(?P<s2>[./])\d{1,2}(?P=s2)\d{4}(?!\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\w+])(?:\d{13,19}|\d{4}(?P<s3>[ -])\d{4}(?P=s3)\d{4}(?P=s3)\d{1,7}|\d{4}(?P<s4>[ -])\d{6}(?P=s4)\d{5})(?!\w))"
    r"|(?P<nanp>(?<![\w+])(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\w))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?){2,6}(?!\w))"
)
#: Characters of an IBAN by country.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 "
    "GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 "
    "MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 "
    "XK20 YE30").split()}
_WORTH = re.compile(r"[@0-9]|(?i:token|password|passwd|secret|key)")


class Feistel:
    """Keyed permutations of the numbers below a size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tag: str, size: int, i: int, x: int) -> int:
        n = (size.bit_length() + 7) // 8 + 8
        text = f"{tag}/{size}/{i}/{x}".encode()
        out, k = b"", 0
        while len(out) < n:
            out += hashlib.blake2b(text + b"/%d" % k, key=self.key).digest()
            k += 1
        return int.from_bytes(out[:n], "big")

    def permute(self, x: int, size: int, tag: str, valid=None) -> int:
        """Image of x below ``size``; with ``valid`` (true of x) the first valid image on x's cycle."""
        side = math.isqrt(size - 1) + 1
        while True:
            left, right = divmod(x, side)
            for i in range(ROUNDS):
                left, right = right, (left + self._round(tag, size, i, right)) % side
            x = left * side + right
            if x < size and (valid is None or valid(x)):
                return x

    def undo(self, x: int, size: int, tag: str, valid=None) -> int:
        side = math.isqrt(size - 1) + 1
        while True:
            left, right = divmod(x, side)
            for i in reversed(range(ROUNDS)):
                left, right = (right - self._round(tag, size, i, left)) % side, left
            x = left * side + right
            if x < size and (valid is None or valid(x)):
                return x


_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
_HEX = re.compile(r"(?=.*[a-f])[0-9a-f]{8,}|(?=.*[A-F])[0-9A-F]{8,}")


def _read(x: int, alphabet: list[str]) -> str:
    """Characters of a mixed-radix number."""
    out = []
    for a in reversed(alphabet):
        x, r = divmod(x, len(a))
        out.append(a[r])
    return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _written(old: str, new: str) -> str:
    """``new`` characters in the places of ``old``'s letters and digits; upper case stays upper."""
    it = iter(new)
    return "".join((next(it).upper() if c.isupper() else next(it)) if c.isalnum() else c for c in old)


class _Days:
    """All dates by kind: a day of one digit, of 10 to 12, or above, and a month of one digit or two."""

    def __init__(self):
        self.alike: dict[int, list[int]] = {}
        self.place = []
        for n in range(FIRST_DAY, LAST_DAY + 1):
            d = datetime.date.fromordinal(n)
            kind = 2 * (0 if d.day < 10 else 1 if d.day <= 12 else 2) + (d.month >= 10)
            same = self.alike.setdefault(kind, [])
            self.place.append((kind, len(same)))
            same.append(n)


_DAYS = _Days()


class Pseudonymizer:
    """One method per format; each returns the pseudonym or None if the value isn't valid."""

    def __init__(self, key: bytes, undo: bool = False):
        f = Feistel(key)
        self.move = f.undo if undo else f.permute

    def _digits(self, digits: str, tag: str, valid=None) -> str:
        n = len(digits)
        return str(self.move(int(digits), 10**n, f"{tag}{n}", valid)).zfill(n)

    def _kinds(self, text: str, tag: str) -> str:
        """Permute as one mixed-radix number: every character keeps its kind (digit, lower or upper case)."""
        alphabet = [_DIGITS if c.isdigit() else _DIGITS[10:] if c.islower() else _DIGITS[10:].upper() for c in text]
        alphabet = [a[:10] if c.isdigit() else a for a, c in zip(alphabet, text)]
        x = 0
        for c, a in zip(text, alphabet):
            x = x * len(a) + a.index(c)
        shape = "".join(a[0] for a in alphabet)
        x = self.move(x, math.prod(map(len, alphabet)), f"{tag}{shape}")
        return _read(x, alphabet)

    def _hex(self, text: str, tag: str) -> str:
        """Hexadecimal with a letter in it stays so."""
        digits = _DIGITS[:16] if text.lower() == text else _DIGITS[:16].upper()

        def lettered(x):
            return any(c > "9" for c in f"{x:x}")

        return _read(self.move(int(text, 16), 16 ** len(text), f"{tag}{len(text)}", lettered), [digits] * len(text))

    def mail(self, s):
        plain = "".join(c for c in s.lower() if c.isalnum())
        return _written(s, self._kinds(plain, "mail")) if plain else None

    def key(self, s):
        return s[:4] + self._kinds(s[4:], "key")

    def secret(self, s):
        if not any(c.isdigit() for c in s):  # prose about passwords
            return None
        if _HEX.fullmatch(s):
            return self._hex(s, "hex")
        return _written(s, self._kinds("".join(c for c in s if c.isalnum()), "secret"))

    def iban_head(self, s):
        """The beginning of a match that is a valid number of its country's length, where words follow it; else None."""
        n, end = IBAN_LENGTHS.get(s[:2], 0), 0
        while n and end < len(s):
            n -= s[end].isalnum()
            end += 1
        if n or not end or s[end:end + 1] not in ("", " ") or not self._iban_valid(s[:end]):
            return None
        return s[:end]

    def _iban_valid(self, s) -> bool:
        plain = s.replace(" ", "")
        return 15 <= len(plain) <= 34 and _iban_number(plain[4:] + plain[:4]) % 97 == 1

    def _iban_moved(self, s):
        plain = s.replace(" ", "")
        rest = plain[4:]
        body = self._digits(rest, "iban" + plain[:2]) if rest.isdigit() else self._kinds(rest, "iban" + plain[:2])
        check = 98 - _iban_number(body + plain[:2] + "00") % 97
        return _written(s, plain[:2] + f"{check:02d}" + body)

    def iban(self, s):
        if self.iban_head(s) == s:
            return self._iban_moved(s)
        if not self._iban_valid(s):
            return None
        new = self._iban_moved(s)
        while self.iban_head(new):  # walked on, as it would be read back as a shorter number
            new = self._iban_moved(new)
        return new

    def ip(self, s):
        octets = [int(o) for o in s.split(".")]
        if max(octets) > 255 or any(len(o) > 1 and o[0] == "0" for o in s.split(".")):
            return None
        x = self.move(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _day(self, year: str, month: str, day: str):
        """Another date whose day and month have as many digits, so that it can be written as the old one was."""
        try:
            n = datetime.date(int(year), int(month), int(day)).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= n <= LAST_DAY:
            return None
        kind, at = _DAYS.place[n - FIRST_DAY]
        alike = _DAYS.alike[kind]
        return datetime.date.fromordinal(alike[self.move(at, len(alike), f"day{kind}")])

    def iso(self, s):
        d = self._day(s[:4], s[5:7], s[8:])
        return d and f"{d.year:04d}{s[4]}{d.month:02d}{s[7]}{d.day:02d}"

    def dmy(self, s):
        mark = "/" if "/" in s else "."
        a, b, y = s.split(mark)
        day_first = mark == "." or int(a) > 12  # month first with slashes where both readings are dates
        d = self._day(y, b, a) if day_first else self._day(y, a, b)
        if d is None:
            return None
        # a day above 12 stays above 12, so the same rule reads the new date back
        first, second = (d.day, d.month) if day_first else (d.month, d.day)
        return f"{str(first).zfill(len(a))}{mark}{str(second).zfill(len(b))}{mark}{d.year:04d}"

    def ssn(self, s):
        def valid(x):
            return x // 10**6 not in (0, 666) and x < 900_000_000 and x // 10**4 % 100 and x % 10**4

        x = int(s.replace("-", ""))
        return _written(s, f"{self.move(x, 10**9, 'ssn', valid):09d}") if valid(x) else None

    def card(self, s):
        plain = re.sub(r"[ -]", "", s)
        if luhn_digit(plain[:-1]) != plain[-1] or len(set(plain)) == 1:
            return None
        body = self._digits(plain[:-1], "card")
        return _written(s, body + luhn_digit(body))

    def nanp(self, s):
        plain = re.sub(r"\D", "", s)
        lead, number = plain[:-10], plain[-10:]

        def real(x):  # area and exchange codes start with 2 to 9
            return x // 10**9 >= 2 and x // 10**6 % 10 >= 2  # first digits of both

        if not real(int(number)):
            return None
        return _written(s, lead + str(self.move(int(number), 10**10, "nanp", real)).zfill(10))

    def phone(self, s):
        plain = re.sub(r"\D", "", s)
        if not 8 <= len(plain) <= 15:
            return None
        return _written(s, plain[:2] + self._digits(plain[2:], "phone" + plain[:2]))

    def text(self, text: str | None) -> tuple[str | None, int]:
        """The text with pseudonyms, and the number of values replaced."""
        if not text or not _WORTH.search(text):
            return text, 0
        found, out, at = 0, [], 0
        m = PATTERN.search(text)
        while m:
            kind = m.lastgroup
            value, end = m.group(kind), m.end()
            if kind == "iban" and (head := self.iban_head(value)):
                value, end = head, m.start() + len(head)
            new = getattr(self, kind)(value)
            if new is not None:
                found += 1
                out += [text[at:m.start()], m.group("name") or "" if kind == "secret" else "", new]
                at = end
            m = PATTERN.search(text, end)
        return "".join(out) + text[at:], found


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", undo: bool = False) -> DataFrame:
    """All columns, with ``text`` replaced and ``n_replaced`` added; a column of that name is replaced too.

    Who has the key can undo the pseudonyms: it belongs in the cluster's secrets.
    """

    @F.pandas_udf("text string, n int")
    def run(texts):
        import pandas as pd

        p = Pseudonymizer(key, undo)
        return pd.DataFrame([p.text(t) for t in texts], columns=["text", "n"])

    found = uuid.uuid4().hex  # no column of the input has this name
    out = docs.withColumn(found, run(F.col(text)))
    return out.withColumns({text: F.col(f"{found}.text"), "n_replaced": F.col(f"{found}.n")}).drop(found)
