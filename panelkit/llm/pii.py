"""Format-preserving pseudonyms for personal data (operator 6).

Found values are validated (Luhn, mod 97, calendar, octets, area rules), then
read as a number of their own format's domain and permuted there by a keyed
Feistel network.  The pseudonym has the same format (length, separators, case,
check digits), and equal values get equal pseudonyms in every document, with
no table of values and nothing to join.

The permutation of a domain of size N is ``P^-1(P(x) + 1 mod N)``: P is the
Feistel network (unbalanced halves, cycle walking where N is no product).
Being conjugate to a rotation it has no fixed point, so no value stays as it
is, and it is inverted with the key by the opposite rotation.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import re
from collections.abc import Iterator
from datetime import date

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of

ROUNDS = 8
DEFAULT_KEY = b"replace this key in production"
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutation of ``range(n)`` without fixed points (n > 1)."""

    def __init__(self, key: bytes, kind: str, n: int):
        self.n = n
        self.a = math.isqrt(max(n - 1, 0)) + 1
        self.b = -(-n // self.a)
        self.salt = hashlib.blake2b(f"{kind}/{n}".encode(), key=key[:64], digest_size=32).digest()

    def _f(self, i: int, half: int, mod: int) -> int:
        size = (half.bit_length() + 7) // 8
        h = hashlib.blake2b(bytes([i]) + half.to_bytes(size, "big"), key=self.salt, digest_size=48).digest()
        return int.from_bytes(h, "big") % mod

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(0, ROUNDS, 2):
            left = (left + self._f(i, right, self.a)) % self.a
            right = (right + self._f(i + 1, left, self.b)) % self.b
        return left * self.b + right

    def _back(self, y: int) -> int:
        left, right = divmod(y, self.b)
        for i in range(ROUNDS - 2, -1, -2):
            right = (right - self._f(i + 1, left, self.b)) % self.b
            left = (left - self._f(i, right, self.a)) % self.a
        return left * self.b + right

    def _walk(self, step, x: int) -> int:
        x = step(x)
        while x >= self.n:
            x = step(x)
        return x

    def permute(self, x: int, by: int = 1) -> int:
        if self.n < 2:
            return x
        return self._walk(self._back, (self._walk(self._once, x) + by) % self.n)


# -- formats ------------------------------------------------------------------

def luhn_digit(body: str) -> str:
    """The digit that makes ``body`` plus it pass the Luhn test."""
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _refill(shape: str, chars: str) -> str:
    """``shape`` with its ASCII digits replaced in turn by ``chars``."""
    it = iter(chars)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _classes(s: str, hexadecimal: bool = False) -> list[str | None]:
    """The alphabet each character is permuted in; None where it stays."""
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    if hexadecimal:
        alphabet = digits + (upper[:6] if any(c in upper for c in s) else lower[:6])
        return [alphabet] * len(s)
    return [next((a for a in (digits, lower, upper) if c in a), None) for c in s]


@functools.cache
def _days(wide_month: bool, wide_day: bool) -> list[int]:
    """The days whose month and day fit fields of one digit, or of two."""
    days = map(date.fromordinal, range(FIRST_DAY, LAST_DAY + 1))
    return [d.toordinal() for d in days if (wide_month or d.month < 10) and (wide_day or d.day < 10)]


# -- values within a match ------------------------------------------------------
# A pattern takes as much as it can, so a match may hold a value and a neighbour of it.  Each function gives the spans
# of a match that may be the value, the likeliest first.

#: Digits in the groups of a card as it is printed (a single group is one too).
PRINTED_CARDS = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4)}
#: Length of a country's IBAN.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 "
    "FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 "
    "LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 "
    "RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}
#: Most digits behind a calling code, where the plan is of (nearly) fixed length; elsewhere 14.
PHONE_DIGITS = {"1": 10, "7": 10, "20": 10, "27": 9, "30": 10, "31": 9, "32": 9, "33": 9, "34": 9, "36": 9, "40": 9,
                "41": 9, "44": 10, "45": 8, "46": 9, "47": 8, "48": 9, "51": 9, "52": 10, "54": 11, "55": 11, "56": 9,
                "57": 10, "60": 10, "61": 9, "63": 10, "64": 10, "65": 8, "66": 9, "81": 10, "82": 10, "84": 10, "86": 11,
                "90": 10, "91": 10, "92": 10, "351": 9, "352": 9, "353": 9, "358": 10, "380": 9, "420": 9, "421": 9}


def _whole(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    yield a, b


CARD_GROUP = 4


def _card_spans(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Groups of 13 to 19 digits in a run of groups: printed forms before
    others, then left before right and long before short.  Other forms than the
    printed ones have no group below CARD_GROUP digits, or any list of small
    numbers would be a card now and then."""
    groups = [(m.start() + a, m.end() + a) for m in re.finditer("[0-9]+", text[a:b])]
    windows = []
    for i in range(len(groups)):
        widths, total = (), 0
        for x, y in groups[i:i + 19]:
            widths, total = (*widths, y - x), total + y - x
            if total > 19:
                break
            plain = len(widths) == 1 or widths in PRINTED_CARDS
            if total >= 13 and (plain or min(widths) >= CARD_GROUP):
                windows.append((not plain, groups[i][0], -y))
    for _, x, y in sorted(windows):
        yield x, -y


def _iban_spans(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Up to each blank of a match: the country's length first, then long
    before short."""
    ends = [e for e in range(a + 15, b + 1) if e == b or text[e] == " "]
    want = IBAN_LENGTHS.get(text[a:a + 2])
    for e in sorted(ends, key=lambda e: (len(text[a:e].replace(" ", "")) != want, -e)):
        yield a, e


def _phone_spans(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Up to each group of a number with calling code: the longest that the
    code's plan allows first, then long before short."""
    if text[a] != "+":
        yield a, b
        return
    most = 14
    code = re.match("[0-9]{1,3}(?=[ .(-])", text[a + 1:b])
    for n in (len(code.group()),) if code else (1, 2, 3):
        most = PHONE_DIGITS.get(text[a + 1:a + 1 + n], most)
    n = len(code.group()) if code else next((n for n in (1, 2, 3) if text[a + 1:a + 1 + n] in PHONE_DIGITS), 1)
    ends = [a + m.end() for m in re.finditer("[0-9]+", text[a:b])]
    ends = [e for e in ends if e == b or PHONE.fullmatch(text, a, e)]
    for e in sorted(ends, key=lambda e: (len(_digits(text[a + 1 + n:e])) > most, -e)):
        yield a, e


class Pseudonyms:
    """Finds and replaces the values of a text under one key."""

    def __init__(self, key: bytes = DEFAULT_KEY):
        self.key = key
        self._nets: dict[tuple[str, int], Feistel] = {}

    def _permute(self, kind: str, n: int, x: int, by: int) -> int:
        net = self._nets.get((kind, n))
        if net is None:
            if len(self._nets) > 10_000:
                self._nets.clear()
            net = self._nets[kind, n] = Feistel(self.key, kind, n)
        return net.permute(x, by)

    def _decimal(self, kind: str, digits: str, by: int) -> str:
        return str(self._permute(kind, 10 ** len(digits), int(digits), by)).zfill(len(digits))

    def _mixed(self, kind: str, s: str, by: int, hexadecimal: bool = False) -> str | None:
        """Permute a string within the character classes of its places."""
        classes = _classes(s, hexadecimal)
        n, x = 1, 0
        for c, alphabet in zip(s, classes):
            if alphabet:
                x, n = x * len(alphabet) + alphabet.index(c), n * len(alphabet)
        if n < 2:
            return None
        shape = "".join("-" if a is None else "h" if len(a) == 16 else a[0] for a in classes)
        x = self._permute(f"{kind}/{shape}", n, x, by)
        out = []
        for c, alphabet in zip(reversed(s), reversed(classes)):
            if alphabet:
                x, d = divmod(x, len(alphabet))
                c = alphabet[d]
            out.append(c)
        return "".join(reversed(out))

    # Each returns the pseudonym, or None if the value isn't valid.
    def card(self, s: str, by: int = 1) -> str | None:
        d = _digits(s)
        if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1]:
            return None
        body = self._decimal("card", d[:-1], by)
        return _refill(s, body + luhn_digit(body))

    def iban(self, s: str, by: int = 1) -> str | None:
        raw = s.replace(" ", "")
        number = lambda t: int("".join(str(int(c, 36)) for c in t))
        if not 15 <= len(raw) <= 34 or number(raw[4:] + raw[:4]) % 97 != 1:
            return None
        body = self._mixed("iban" + raw[:2], raw[4:], by)
        if body is None:
            return None
        check = 98 - number(body + raw[:2] + "00") % 97
        it = iter(f"{raw[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in s)

    def ssn(self, s: str, by: int = 1) -> str | None:
        a, g, n = int(s[:3]), int(s[4:6]), int(s[7:])
        if a in (0, 666) or a >= 900 or not g or not n:
            return None
        area = a - 1 - (a > 666)                      # 898 areas
        x = self._permute("ssn", 898 * 99 * 9999, (area * 99 + g - 1) * 9999 + n - 1, by)
        x, n = divmod(x, 9999)
        area, g = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}{s[3]}{g + 1:02d}{s[6]}{n + 1:04d}"

    def phone(self, s: str, by: int = 1) -> str | None:
        head = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]|", s).group()
        d = _digits(s[len(head):])
        if not 7 <= len(d) <= 14:
            return None
        return head + _refill(s[len(head):], self._decimal("phone", d, by))

    def ip(self, s: str, by: int = 1) -> str | None:
        parts = [int(p) for p in s.split(".")]
        if max(parts) > 255:
            return None
        x = self._permute("ip", 1 << 32, int.from_bytes(bytes(parts), "big"), by)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, s: str, by: int = 1) -> str | None:
        parts = re.findall("[0-9]+", s)
        for order in ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1)):
            try:
                day = date(*(int(parts[k]) for k in order)).toordinal()
            except ValueError:
                continue
            if not FIRST_DAY <= day <= LAST_DAY:
                return None
            month, of_month = len(parts[order[1]]), len(parts[order[2]])
            days = _days(month > 1, of_month > 1)
            kind = "date" if month > 1 and of_month > 1 else f"date/{month}{of_month}"
            new = date.fromordinal(days[self._permute(kind, len(days), bisect.bisect_left(days, day), by)])
            fields = {order[0]: f"{new.year:04d}", order[1]: f"{new.month:0{month}d}", order[2]: f"{new.day:0{of_month}d}"}
            return _refill(s, "".join(fields[k] for k in range(3)))
        return None

    def email(self, s: str, by: int = 1) -> str | None:
        local, _, host = s.rpartition("@")
        new = self._mixed("email", local, by)
        if new is None:                               # nothing to permute in it: the host's name
            name, dot, rest = host.partition(".")
            new_name = self._mixed("email", name, by)
            return None if new_name is None else f"{local}@{new_name}{dot}{rest}"
        return f"{new}@{host}"

    def secret(self, s: str, by: int = 1) -> str | None:
        return self._mixed("secret", s, by, hexadecimal=re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) is not None)

    # -- texts ----------------------------------------------------------------
    def find(self, text: str, by: int = 1) -> list[tuple[int, int, str, str]]:
        """``(start, end, kind, pseudonym)`` of all valid values, left to
        right; of overlapping ones the first in the order of KINDS wins.
        Where a match as a whole isn't valid, its shorter and later parts are
        tried (SPANS)."""
        found: list[tuple[int, int, str, str]] = []
        for kind, needle, pattern in KINDS:
            if needle and not needle(text):
                continue
            spans, start = SPANS.get(kind, _whole), 0
            while m := pattern.search(text, start):
                start = m.start() + 1 if kind in LATER else m.end()
                for a, b in spans(text, *(m.span(1) if pattern.groups else m.span())):
                    at = bisect.bisect_left(found, (a,))   # found is sorted and free of overlaps
                    if (at < len(found) and found[at][0] < b) or (at and found[at - 1][1] > a):
                        continue
                    new = getattr(self, kind)(text[a:b], by)
                    if new is not None:
                        found.insert(at, (a, b, kind, new))
                        if kind in LATER:                  # a single value; what follows it is searched again
                            start = b
                            break
        return found

    def replace(self, text: str, by: int = 1) -> tuple[str, list[tuple[int, int, str, str]]]:
        found = self.find(text, by)
        if not found:
            return text, found
        out, at = [], 0
        for a, b, _, new in found:
            out += [text[at:a], new]
            at = b
        return "".join(out) + text[at:], found


_HAS_DIGITS = re.compile("[0-9]{2}").search
PHONE = re.compile(
    r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])")
#: Kinds in order of precedence, a cheap test of the text, and the pattern
#: (its group, if any, is the value).
KINDS = [
    ("secret", re.compile(r"[=:]").search, re.compile(
        r"(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?"
        r"([0-9A-Za-z][0-9A-Za-z+/_-]{15,})")),
    ("secret", lambda t: "AKIA" in t or "ASIA" in t, re.compile(r"(?<![0-9A-Za-z])(?:AKIA|ASIA)([0-9A-Z]{16})(?![0-9A-Za-z])")),
    ("email", lambda t: "@" in t, re.compile(r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    ("iban", _HAS_DIGITS, re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
    ("ip", re.compile(r"[0-9]\.[0-9]").search, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])")),
    ("date", _HAS_DIGITS, re.compile(r"(?<![0-9./-])([0-9]{4}([-/.])[0-9]{1,2}\2[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\3[0-9]{4})"
                                     r"(?![0-9]|[./-][0-9])")),
    ("ssn", _HAS_DIGITS, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])")),
    ("phone", _HAS_DIGITS, PHONE),
    ("card", _HAS_DIGITS, re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}(?![0-9])")),
]
#: The parts of a match to try, where that isn't the match itself.
SPANS = {"iban": _iban_spans, "phone": _phone_spans, "card": _card_spans}
#: Kinds whose match may hide the start of another value.
LATER = {"iban", "phone"}


def pseudonymise(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """Replace personal values in every whole text.

    Returns ``doc_id, text, n_found int, kinds array<string>`` (the kind of
    each value, in order).  A text without values comes back unchanged; a null
    text stays null; null doc_ids and repeated rows are passed through; other
    columns of ``docs`` are ignored.  One narrow pass, no shuffle.
    """
    fields = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_found", pa.int32()),
                        ("kinds", pa.list_(pa.string()))])

    def run(batches):
        names = Pseudonyms(key)
        for ids, texts in columns_of(batches):
            rows = [(None, []) if t is None else names.replace(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([t for t, _ in rows], pa.string()),
                 pa.array([len(f) for _, f in rows], pa.int32()),
                 pa.array([[k for _, _, k, _ in f] for _, f in rows], pa.list_(pa.string()))], schema=fields)

    read = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, text string, n_found int, kinds array<string>")


def pseudonymise_column(docs: DataFrame, key: bytes = DEFAULT_KEY, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, the text column replaced as in
    :func:`pseudonymise`."""

    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        names = Pseudonyms(key)
        return pd.Series([None if t is None else names.replace(t)[0] for t in texts], dtype=object)

    return docs.withColumn(text_col, replace(F.col(text_col).cast("string")))
