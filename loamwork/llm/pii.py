"""Format-preserving pseudonyms for validated personal data.

A value's variable characters form one number in a mixed radix. A keyed Feistel
network permutes that number within its range (cycle-walking keeps it inside), so the
pseudonym has the same format, check digits hold, and equal values stay linked.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame

from loamwork.llm.common import append_columns, check_columns, texts_of

KINDS = ("email", "secret", "iban", "card", "phone", "ssn", "ip", "date", "mac")
ROUNDS = 8
_LOWER, _UPPER, _DIGIT, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY
#: IBAN lengths by country (ISO 13616 registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

#: Country calling codes of one and of two digits (ITU E.164); all others have three.
SHORT_CODES = {"1", "7"} | set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_MAIL_CHAR = re.compile(r"[\w.%+-]")
_AT_RIGHT = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_SECRET = re.compile(r"(?i:\b(?:token|secret|key|password|passwd|api[_-]?key)\s*[=:]\s*[\"']?)([0-9a-f]{32,}(?![0-9A-Za-z])|[0-9A-F]{32,}(?![0-9A-Za-z])|[0-9A-Za-z_+/-]{16,}(?![0-9A-Za-z_+/-]))")
#: How issuers' keys begin, and what follows.
_ISSUED = re.compile(
    r"(?<![0-9A-Za-z_-])(?:AKIA([0-9A-Z]{16})|gh[pousr]_([0-9A-Za-z]{36})|sk_(?:live|test)_([0-9A-Za-z]{16,})|xox[abprs]-([0-9A-Za-z-]{16,})|AIza([0-9A-Za-z_-]{35}))(?![0-9A-Za-z_-])"
)
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:]|\.[0-9])")
_MAC = re.compile(r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}([:-])[0-9A-Fa-f]{2}(?:\1[0-9A-Fa-f]{2}){4}(?![0-9A-Za-z:-])")
_IBAN_START = re.compile(r"(?<![0-9A-Za-z])([A-Z]{2}|[a-z]{2})[0-9]{2}(?= ?[0-9A-Za-z]{4})")
#: An IBAN of each length: groups of four with or without blanks between them, and a rest.
_IBAN = {n: re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[0-9A-Za-z]{4}){%d}%s(?![0-9A-Za-z])" % (n // 4 - 1, " ?[0-9A-Za-z]{%d}" % (n % 4) if n % 4 else "")) for n in set(IBAN_LENGTHS.values())}
_START = re.compile(r"(?<![0-9A-Za-z.])[+(]?[0-9]")
#: Local and long forms, in groups; a long form with a leading 1; pairs after a leading 0; any groups after an international prefix.
_PHONES = (
    r"(?<![0-9][ .-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[ .-][0-9])",
    r"\+[0-9]{8,15}(?![0-9A-Za-z])",
    r"(?<![0-9][ .-])1(?:[ .-]?\([0-9]{3}\)[ .-]?|[ .-][0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[ .-][0-9])",
    r"(?<![0-9][ .-])0[0-9]([ .-])[0-9]{2}(?:\1[0-9]{2}){3}(?![0-9A-Za-z]|[ .-][0-9])",
    r"(?:\+|(?<![0-9][ .-])00)[1-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\)[ .-]?|[ .-])[0-9]{1,8}(?:[ .-][0-9]{1,8}){0,6}(?![0-9A-Za-z])",
)
_PAIRS = re.compile(r"0[0-9](?:[ .-][0-9]{2}){4}$")
_NUMBERS = (
    ("card", re.compile(r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z]|[.-][0-9])")),
    ("date", re.compile(r"(?:([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})|([0-9]{1,2})([-/.])([0-9]{1,2})\6([0-9]{4}))(?![0-9A-Za-z]|[./-][0-9])")),
    ("ip", re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])")),
    ("ssn", re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])")),
    ("phone", re.compile("|".join(_PHONES))),
)


def feistel(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        a, b = value >> half, value & mask
        for r in range(ROUNDS):
            a, b = b, a ^ (_digest(key, tweak + bytes([r]), b.to_bytes(width, "big"), width) & mask)
        value = a << half | b
        if value < size:
            return value


def _digest(key: bytes, salt: bytes, data: bytes, width: int) -> int:
    out, block = b"", 0
    while len(out) < width:
        out += hashlib.blake2b(block.to_bytes(4, "big") + salt + b"\0" + data, key=key if len(key) <= 64 else hashlib.blake2b(key).digest()).digest()
        block += 1
    return int.from_bytes(out[:width], "big")


@lru_cache(1 << 12)
def _others(char: str) -> str:
    """The class of a letter or digit that isn't ASCII: what is of its kind among the 128 code points around it. Letters with a capital of their own are a kind."""

    def kind(c: str) -> tuple[str, bool]:
        return unicodedata.category(c), len(c.upper()) == len(c.lower()) == 1 and c.upper().lower() == c.lower()

    start = ord(char) & ~127
    return "".join(c for c in map(chr, range(start, start + 128)) if c.isalnum() and kind(c) == kind(char)) if char.isalnum() and not char.isascii() else ""


def permute(text: str, key: bytes, kind: str, classes: tuple[str, ...] = (_DIGIT, _LOWER, _UPPER)) -> str:
    """text with its letters and digits permuted together, each within its class: one of classes, or what _others gives."""
    of = [next((c for c in classes if ch in c), "") or _others(ch) for ch in text]
    value, size = 0, 1
    for ch, c in zip(text, of, strict=True):
        if c:
            value, size = value * len(c) + c.index(ch), size * len(c)
    form = "".join(c[0] if c else ch for ch, c in zip(text, of, strict=True))
    value, out = feistel(value, size, key, f"{kind}:{form}".encode()), list(text)
    for i in reversed(range(len(text))):
        if of[i]:
            value, at = divmod(value, len(of[i]))
            out[i] = of[i][at]
    return "".join(out)


def luhn(digits: str) -> int:
    """The Luhn sum of digits modulo ten; 0 when the last digit checks the others."""
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10


def iban_rest(iban: str) -> int:
    """The ISO 7064 remainder of an IBAN; 1 when it is valid."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _spread(form: str, chars: str) -> str:
    """chars put where form has letters or digits."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in form)


def _card(value: str, key: bytes) -> str | None:
    digits = re.sub(r"[^0-9]", "", value)
    if luhn(digits) or len(set(digits)) == 1:
        return None
    head = permute(digits[:-1], key, "card")
    return _spread(value, head + str(-luhn(head + "0") % 10))


def _iban(value: str, key: bytes) -> str | None:
    plain = value.replace(" ", "").upper()
    if len(plain) != IBAN_LENGTHS.get(plain[:2]) or iban_rest(plain) != 1:
        return None
    body = permute(plain[4:], key, "iban", (_DIGIT, _UPPER))
    new = _spread(value, plain[:2] + f"{98 - iban_rest(plain[:2] + '00' + body):02d}" + body)
    return new.lower() if value == value.lower() else new


def _date(value: str, key: bytes) -> str | None:
    sep = re.search("[-/.]", value)[0]
    fields = value.split(sep)
    first = len(fields[0]) == 4
    y, m, d = fields if first else fields[::-1]
    swapped = not first and int(m) > 12  # month first
    if swapped:
        m, d = d, m
    try:
        at = datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None
    day, late = at.toordinal() - _FIRST_DAY, at.day > 12
    if not 0 <= day < _DAYS:
        return None
    while True:  # a date is the same day in all forms, and one that shows which field is the month still does
        day = feistel(day, _DAYS, key, b"date")
        at = datetime.date.fromordinal(day + _FIRST_DAY)
        if (at.day > 12) == late:
            break
    short = any(len(x) == 1 for x in (m, d))  # without leading zeros
    y, m, d = f"{at.year:04d}", *(str(x) if short else f"{x:02d}" for x in (at.month, at.day))
    return sep.join((y, m, d) if first else (m, d, y) if swapped else (d, m, y))


def _ip(value: str, key: bytes) -> str | None:
    """An address of version 6 has one pseudonym in all its forms, which is written in the short one."""
    if ":" in value:
        try:
            at = ipaddress.IPv6Address(value)
        except ValueError:
            return None
        if sum(map(bool, value.split(":"))) < 3:  # a::b may be anything
            return None
        new = str(ipaddress.IPv6Address(feistel(int(at), 1 << 128, key, b"ip6")))
        return new.upper() if value != value.lower() else new
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    new = feistel(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ip")
    return ".".join(map(str, new.to_bytes(4, "big")))


def _mac(value: str, key: bytes) -> str | None:
    """The twelve digits are permuted together, whatever stands between them."""
    new = _spread(value, permute(re.sub("[:-]", "", value).lower(), key, "mac", (_HEX,)))
    return new.upper() if value != value.lower() else new


def _phone(value: str, key: bytes) -> str | None:
    """The national digits are permuted, whatever stands between them; the calling code or trunk digit before them stays.

    So a number keeps one pseudonym in all its forms: +1 (017) 555-7713, 1-017-555-7713 and (017) 555-7713.
    """
    digits = re.sub("[^0-9]", "", value)
    if not 8 <= len(digits) <= 15:
        return None
    lead = 0
    if value[0] == "+" or value.startswith("00"):
        lead = 0 if value[0] == "+" else 2
        lead += next((n for n in (1, 2) if digits[lead : lead + n] in SHORT_CODES), 3)
    elif (digits[0] == "1" and len(digits) == 11) or _PAIRS.match(value):
        lead = 1
    return _spread(value, digits[:lead] + permute(digits[lead:], key, "phone", (_DIGIT,)))


def _ssn(value: str, key: bytes) -> str | None:
    def valid(v: str) -> bool:
        return v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"

    if not valid(value):
        return None
    while True:  # cycle-walks over the numbers that are never issued
        value = permute(value, key, "ssn", (_DIGIT,))
        if valid(value):
            return value


def _cased(text: str, like: str) -> str:
    """text with capitals where like has them."""
    return "".join(c.upper() if o.isupper() else c for c, o in zip(text, like, strict=True))


def _email(value: str, key: bytes) -> str | None:
    """Mails that differ in letter case alone have pseudonyms that do so, too."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    name, _, host = low.rpartition("@")
    labels, _, top = host.rpartition(".")
    return _cased(f"{permute(name, key, 'name')}@{permute(labels, key, 'host')}.{top}", value)


def _secret(value: str, key: bytes) -> str | None:
    """Hex digits, in either case; other secrets need digits and letters, and each character stays in its class."""
    if re.fullmatch("[0-9a-f]{32,}|[0-9A-F]{32,}", value):
        new = permute(value.lower(), key, "secret", (_HEX,))
        return new if value == value.lower() else new.upper()
    if not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
        return None
    return permute(value, key, "secret")


_MAKERS = {"card": _card, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "email": _email, "secret": _secret, "mac": _mac}


@lru_cache(1 << 16)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The pseudonym of a value; None when the value is not valid."""
    return _MAKERS[kind](value, key)


def _within(phone: str) -> str:
    """A phone number without the last groups that make it longer than numbers can be."""
    while sum(c.isdigit() for c in phone) > 15 and (at := max(map(phone.rfind, " .-"))) > 0:
        phone = phone[:at]
    return phone


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of validated values; longer checks come first."""
    found: list[tuple[int, int, str]] = []
    at, before = text.find("@"), 0
    while at >= 0:
        start = at
        while start > before and _MAIL_CHAR.match(text, start - 1):
            start -= 1
        right = _AT_RIGHT.match(text, at + 1)
        if start < at and right:
            found.append((start, right.end(), "email"))
        before, at = at + 1, text.find("@", at + 1)
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret") for m in _SECRET.finditer(text) if pseudonym("secret", m[1], b"?") is not None]
    for m in _ISSUED.finditer(text):
        if pseudonym("secret", m[m.lastindex], b"?") is not None:
            found.append((*m.span(m.lastindex), "secret"))
    if ":" in text or "-" in text:
        macs = [(*m.span(), "mac") for m in _MAC.finditer(text)]
        found += macs
        found += [(*m.span(), "ip") for m in _IP6.finditer(text) if pseudonym("ip", m[0], b"?") is not None and not any(a < m.end() and m.start() < b for a, b, _ in macs)]
    for m in _IBAN_START.finditer(text):
        hit = _IBAN[n].match(text, m.start()) if (n := IBAN_LENGTHS.get(m[1].upper())) else None
        if hit and iban_rest(hit[0].replace(" ", "").upper()) == 1:
            found.append((*hit.span(), "iban"))
    end, taken = 0, sorted(found)
    for m in _START.finditer(text):
        if m.start() < end or any(a <= m.start() < b for a, b, _ in taken):
            continue
        for kind, pattern in _NUMBERS:
            if not (hit := pattern.match(text, m.start())):
                continue
            value = _within(hit[0]) if kind == "phone" else hit[0]
            if pseudonym(kind, value, b"?") is not None:
                end = m.start() + len(value)
                found.append((m.start(), end, kind))
                break
    return sorted(found)


def mask(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms in place of validated values, and how many of each kind."""
    out, at, counts = [], 0, {}
    for start, end, kind in spans(text):
        if start < at or (new := pseudonym(kind, text[start:end], key)) is None:
            continue
        out += [text[at:start], new]
        at = end
        counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[at:]]), counts


def pseudonymize(docs: DataFrame, key: bytes, counts: bool = True) -> DataFrame:
    """docs with pseudonyms in text; with counts, also n_<kind> columns and n_found. Who has the key can find the values again.

    A null text stays null, an empty one empty; a text without valid values is returned
    unchanged. Count columns take the place of columns of the same name; all others pass
    through. Rows are handled one by one, in place: nothing is shuffled.
    """
    check_columns(docs, "text")
    added = ", ".join(f"n_{k} long" for k in (*KINDS, "found")) if counts else ""

    def make():
        def apply(part):
            nulls = [t is None for t in part.column("text").to_pylist()]
            done = [mask(t, key) for t in texts_of(part)]
            out = {"text": [None if null else t for null, (t, _) in zip(nulls, done, strict=True)]}
            if counts:
                out |= {f"n_{k}": [c.get(k, 0) for _, c in done] for k in KINDS}
                out["n_found"] = [sum(c.values()) for _, c in done]
            return out

        return apply

    return append_columns(docs, make, added, ("text",))
