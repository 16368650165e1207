"""Format-preserving pseudonyms for personal data: a keyed Feistel permutation within each value's own format.

Found and validated: e-mail addresses, payment card numbers (13 to 19 digits, Luhn), IBANs (mod 97), US social security
numbers, IPv4 addresses, telephone numbers in international or North American writing (ten digits without marks too), and
calendar dates, also before a time. Digits are 0 to 9; other scripts' digits are text. Each value is
permuted within the values of its format: digits stay digits, separators stay, a card keeps its length and its Luhn sum, an
IBAN its country and check sum, a date is again a date of 1900 to 2099 in the same notation, a local part keeps its letter,
digit and mark places. The same value gets the same pseudonym in every document under one key, however it is separated or
cased, so records stay linked; the permutation can be undone by who has the key.

A null text stays null and has no spans; an empty text stays empty. Equal rows get equal results; each row is returned.
Spans are code points of the original text, ends exclusive. Columns besides doc_id and text are not read. Two findings never
overlap: of those that begin first, the longer one counts. An empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame

from shalegrid.llm.common import fields, map_rows

KINDS = ("email", "card", "iban", "ssn", "ip", "phone", "date")
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?\Z")
EMAIL_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: A run that begins with a digit, + or ( and holds digits and separators; what it is, is decided after. A time may follow.
NUMBER = re.compile(r"(?<![\w.])(?:\+|\()?[0-9](?:[ ().,/-]{0,2}[0-9])+(?:(?!\w)|(?=T[0-9]{2}:))")
#: Where a run of several values is cut: blanks, commas, slashes, brackets, and a sentence's end.
CUT = re.compile(r"[).]*[ ,/]+|\)[.-]*(?=[(0-9])|(?=\()")
#: Characters of the longest value: 19 digits of a card with a separator between each, and brackets.
LONGEST = 41
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,18}\Z")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}([- ])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}\Z")
IP = re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}\Z")
#: With + or 00 before the country; ten digits in groups of 3, 3 and 4; ten digits that begin as an area code does.
PHONE = re.compile(r"(?:(?:\+|00[ .-]?)[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9](?:[ .-]?[0-9]){5,12}|\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([-. ])[0-9]{3}\1[0-9]{4}|[2-9][0-9]{9})\Z")
COUNTRY = re.compile(r"(?:\+|00[ .-]?)[0-9]{1,3}(?=[ .(-])|\+[0-9]|00(?=[0-9]{8})|")
DATE = re.compile(r"(?:(?P<y>[0-9]{4})(?P<s>[-/.])(?P<m>[0-9]{1,2})(?P=s)(?P<d>[0-9]{1,2})|(?P<d2>[0-9]{1,2})(?P<s2>[-/.])(?P<m2>[0-9]{1,2})(?P=s2)(?P<y2>[0-9]{4}))\Z")
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
ROUNDS = 10


@lru_cache(maxsize=65536)
def permuted(key: bytes, kind: str, value: int, size: int, back: bool = False) -> int:
    """A keyed permutation of range(size): a Feistel network over the next a * b >= size, walked until it falls inside."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    width = (a.bit_length() + 7) // 8 + 16
    while True:
        left, right = divmod(value, a)
        for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            known = left if back else right
            f = int.from_bytes(hashlib.blake2b(f"{kind}:{size}:{r}:{known}".encode(), key=key[:64], digest_size=min(64, width)).digest(), "big")
            left, right = ((right - f) % a, left) if back else (right, (left + f) % a)
        value = left * a + right
        if value < size:
            return value


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _refill(shape: str, chars: str) -> str:
    """shape with its letters and digits replaced, in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _mixed(key: bytes, kind: str, text: str, back: bool) -> str:
    """Letters to letters and digits to digits, place by place; case stays."""
    sizes = [10 if c.isdigit() else 26 for c in text]
    value, size = 0, 1
    for c, n in zip(text, sizes, strict=True):
        value, size = value * n + (int(c) if n == 10 else ord(c.lower()) - 97), size * n
    value, out = permuted(key, kind, value, size, back), []
    for c, n in zip(reversed(text), reversed(sizes), strict=True):
        value, x = divmod(value, n)
        out.append(str(x) if n == 10 else chr(97 + x).upper() if c.isupper() else chr(97 + x))
    return "".join(reversed(out))


def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str:
    """The pseudonym of a value of that kind; with back, the value of a pseudonym."""
    if kind == "email":
        local, _, domain = text.partition("@")
        plain = "".join(c for c in local if c.isalnum())
        return f"{_refill(local, _mixed(key, f'email@{domain.lower()}', plain, back))}@{domain}"
    digits = "".join(c for c in text if c.isdigit())
    if kind == "card":
        body = str(permuted(key, f"card{len(digits)}", int(digits[:-1]), 10 ** (len(digits) - 1), back)).zfill(len(digits) - 1)
        return _refill(text, body + next(c for c in "0123456789" if luhn(body + c)))
    if kind == "iban":
        plain = text.replace(" ", "")
        body = _mixed(key, f"iban{plain[:2]}", plain[4:], back)
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        return _refill(text, f"{plain[:2]}{check:02d}{body}")
    if kind == "ssn":
        areas = [a for a in range(1, 900) if a != 666]
        area, group, serial = areas.index(int(digits[:3])), int(digits[3:5]) - 1, int(digits[5:]) - 1
        v = permuted(key, kind, (area * 99 + group) * 9999 + serial, len(areas) * 99 * 9999, back)
        return _refill(text, f"{areas[v // 9999 // 99]:03d}{v // 9999 % 99 + 1:02d}{v % 9999 + 1:04d}")
    if kind == "ip":
        v = permuted(key, kind, int.from_bytes(bytes(map(int, text.split("."))), "big"), 1 << 32, back)
        return ".".join(map(str, v.to_bytes(4, "big")))
    if kind == "phone":
        prefix = COUNTRY.match(text)[0]
        rest = text[len(prefix) :]
        own = "".join(c for c in rest if c.isdigit())
        return prefix + _refill(rest, str(permuted(key, f"phone{len(own)}", int(own), 10 ** len(own), back)).zfill(len(own)))
    m = DATE.match(text)
    y, mo, d, sep, first = (m["y"], m["m"], m["d"], m["s"], True) if m["y"] else (m["y2"], m["m2"], m["d2"], m["s2"], False)
    day = datetime.date.fromordinal(FIRST_DAY + permuted(key, kind, datetime.date(int(y), int(mo), int(d)).toordinal() - FIRST_DAY, DAYS, back))
    return f"{day.year:04d}{sep}{day.month:02d}{sep}{day.day:02d}" if first else f"{day.day:02d}{sep}{day.month:02d}{sep}{day.year:04d}"


def _kind(text: str) -> str | None:
    """What a run of digits and separators is, or None."""
    if IP.match(text):
        return "ip" if all(int(x) < 256 and (x == "0" or x[0] != "0") for x in text.split(".")) else None
    if SSN.match(text):
        return "ssn"
    if m := DATE.match(text):
        y, mo, d = (int(m[k]) for k in (("y", "m", "d") if m["y"] else ("y2", "m2", "d2")))
        try:
            return "date" if 0 <= datetime.date(y, mo, d).toordinal() - FIRST_DAY < DAYS else None
        except ValueError:
            return None
    if CARD.match(text):
        digits = re.sub(r"[^0-9]", "", text)
        if luhn(digits) and len(set(digits)) > 1:
            return "card"
    return "phone" if PHONE.match(text) else None


def _trimmed(text: str, a: int, b: int) -> tuple[int, int, str] | None:
    """(start, end, kind) of the value that text[a:b] is, with or without a bracket before it and marks behind."""
    bare = a
    while bare < b and text[bare] == "(":
        bare += 1
    end = b
    while end > bare and text[end - 1] in ".),":
        end -= 1
    # A telephone number may begin with its own bracket.
    for begin in dict.fromkeys((a, bare)):
        if end - begin >= 6 and (kind := _kind(text[begin:end])):
            return begin, end, kind
    return None


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each finding, in order, none overlapping."""
    out = []
    at = text.find("@")
    while at >= 0:
        domain = EMAIL_DOMAIN.match(text, at + 1)
        begin = at
        while begin > 0 and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        while begin < at and not text[begin].isalnum():
            begin += 1
        if domain and begin < at and EMAIL_LOCAL.match(text[begin:at]):
            out.append((begin, domain.end(), "email"))
        at = text.find("@", at + 1)
    for m in NUMBER.finditer(text):
        a, b = m.span()
        if b - a < 6:
            continue
        if found := _trimmed(text, a, b):
            out.append(found)
            continue
        # Several values may stand side by side: the pieces between separators are looked at, longest first from the left.
        cuts = [a, *(x for p in CUT.finditer(text, a, b) for x in p.span()), b]
        starts, ends, i = cuts[::2], cuts[1::2], 0
        while i < len(starts):
            # No value has more than LONGEST characters, so pieces beyond that are not looked at.
            for j in range(bisect_right(ends, starts[i] + LONGEST) - 1, i - 1, -1):
                if found := _trimmed(text, starts[i], ends[j]):
                    out.append(found)
                    i = j
                    break
            i += 1
    if any(c.isdigit() for c in text):
        out += [(m.start(), m.end(), "iban") for m in IBAN.finditer(text) if iban_ok(m[0])]
    out.sort(key=lambda s: (s[0], -s[1]))
    clean, end = [], 0
    for s in out:
        if s[0] >= end:
            clean.append(s)
            end = s[1]
    return clean


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    spans = find(text)
    if not spans:
        return text, spans
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], pseudonym(kind, text[a:b], key)]
        at = b
    return "".join([*parts, text[at:]]), spans


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, n_<kind> for each kind, spans, text with pseudonyms) of each row."""

    def make():
        def run(columns: list[list]) -> list[list]:
            counts, spans, texts = [], [], []
            for t in columns[1]:
                new, found = replaced(t or "", key)
                counts.append([sum(k == kind for _, _, k in found) for kind in KINDS])
                spans.append([{"kind": k, "start": a, "end": b} for a, b, k in found])
                texts.append(None if t is None else new)
            return [columns[0], *([c[i] for c in counts] for i in range(len(KINDS))), spans, texts]

        return run

    return map_rows(docs, ["doc_id", "text"], make, fields("doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", spans array<struct<kind:string,start:bigint,end:bigint>>, text string"))
