"""Format-preserving pseudonyms for personal data.

A value is found by its form, validated (check digits, calendar, ranges), read as a number below
the size of its format, permuted by a keyed Feistel network that is walked back into that range,
and written in the same format with valid check digits. Equal values therefore get equal pseudonyms
in every document, different values different ones, and the holder of the key can undo them.

Texts: null stays null, empty stays empty; texts without personal data come back unchanged; texts of
any length are read whole. All other columns pass through. Values that fail validation stay.

Cards, IBANs and phones are read to each place where they may end, so that a number or a word after
one is no part of it. Where a number is valid at two ends the shorter one is taken (for IBANs that of
the country's length first). A phone ends at the length of its country, or at a stop or comma.

Found are e-mail addresses, IBANs in capitals, cards of 13 to 19 digits, US social security numbers with
hyphens, phones with a country code or in US form, IPv4 addresses, dates of digits (year first, day
first, month first) and secrets by form or after a name such as ``password =``. Not read: IBANs in small
letters, IPv6, dates with month names, phones of other countries without their code.
"""

import calendar
import datetime
import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quadweave.llm.common import each_slice, give_back, numbered, quoted

#: For tests and the registered query; a real run takes its key from a secret store.
DEMO_KEY = b"quadweave demonstration key"
ROUNDS = 10
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY


class Permuter:
    """Keyed permutations of the numbers below a size, one for each kind of value."""

    def __init__(self, key: bytes, inverse=False):
        self.key, self.inverse = key, inverse

    def _mix(self, kind, size, r, right, bits):
        mac = hashlib.shake_256(self.key + f"|{kind}|{size}|{r}|{right}".encode()).digest(-(-bits // 8))
        return int.from_bytes(mac, "big") & ((1 << bits) - 1)

    def __call__(self, value: int, size: int, kind: str, allowed=None) -> int:
        """The image of ``value``; walks on until it is below ``size`` and allowed."""
        if size < 2:
            return value
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        low = (1 << half) - 1
        while True:
            left, right = value >> half, value & low
            if self.inverse:
                for r in reversed(range(ROUNDS)):
                    left, right = right ^ self._mix(kind, size, r, left, half), left
            else:
                for r in range(ROUNDS):
                    left, right = right, left ^ self._mix(kind, size, r, right, half)
            value = left << half | right
            if value < size and (allowed is None or allowed(value)):
                return value


# --- alphabets --------------------------------------------------------------------------------

_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789abcdef", "0123456789ABCDEF")


def permute_text(text: str, kind: str, permuter: Permuter, alphabets=_CLASSES) -> str:
    """Every character that is in an alphabet goes to one of the same alphabet; others stay."""
    value, size, places = 0, 1, []
    for i, c in enumerate(text):
        for alphabet in alphabets:
            if (at := alphabet.find(c)) >= 0:
                value, size = value * len(alphabet) + at, size * len(alphabet)
                places.append((i, alphabet))
                break
    value, out = permuter(value, size, kind), list(text)
    for i, alphabet in reversed(places):
        value, at = divmod(value, len(alphabet))
        out[i] = alphabet[at]
    return "".join(out)


def luhn_digit(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _with_digits(template: str, digits: str) -> str:
    """``template`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isascii() and c.isdigit() else c for c in template)


def _digits(text):
    return re.sub(r"[^0-9]", "", text)


# --- kinds ------------------------------------------------------------------------------------


def _prefixes(digits):
    """At which lengths below its own a number would pass for a card."""
    return [n for n in range(13, len(digits)) if luhn_digit(digits[: n - 1]) == int(digits[n - 1])]


def card_ends(m):
    """Every end between 13 and 19 digits that is no place inside a run, shortest first."""
    n = 0
    for i, c in enumerate(m[0]):
        n += c.isdigit()
        if n > 19:
            return
        if n >= 13 and c.isdigit() and _ends(m.string, m.start() + i + 1):
            yield m.start() + i + 1


def _ends(text, at):
    return at == len(text) or not (text[at].isalnum() or text[at] == "_")


def card(m, end, permuter):
    text = m.string[m.start() : end]
    digits = _digits(text)
    if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits[:-1])) == 1:
        return None
    n, short = len(digits) - 1, _prefixes(digits)

    def allowed(v):
        # An image passes at the same shorter lengths, so that reading it back ends at the same place.
        body = str(v).zfill(n)
        return len(set(body)) > 1 and _prefixes(body + str(luhn_digit(body))) == short

    body = str(permuter(int(digits[:-1]), 10**n, f"card{n}", allowed)).zfill(n)
    return _with_digits(text, body + str(luhn_digit(body)))


#: Letters and digits of an IBAN by country.
IBAN_CHARS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
        "GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 "
        "PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}


def iban_ends(m):
    """The end at the country's length, then every other end, shortest first."""
    ends, n = [], 0
    for i, c in enumerate(m[0]):
        n += c != " "
        if c != " " and 15 <= n <= 34 and _ends(m.string, m.start() + i + 1):
            ends.append((n != IBAN_CHARS.get(m[0][:2]), m.start() + i + 1))
    return [end for _, end in sorted(ends)]


def iban(m, end, permuter):
    own = m.string[m.start() : end]
    text = own.replace(" ", "")
    if _mod97(text[4:] + text[:4]) != 1:
        return None
    body = permute_text(text[4:], f"iban{text[:2]}", permuter)
    check = 98 - _mod97(body + text[:2] + "00")
    new = iter(f"{text[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(new) for c in own)


#: Fewest and most digits after the country's, where a plan of numbers tells.
PHONE_DIGITS = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9),
    "39": (6, 11), "40": (9, 9), "41": (9, 9), "43": (7, 13), "44": (9, 10), "45": (8, 8), "46": (7, 9), "47": (8, 8), "48": (9, 9), "49": (6, 11),
    "52": (10, 10), "54": (10, 11), "55": (10, 11), "61": (9, 9), "64": (8, 10), "65": (8, 8), "81": (9, 10), "82": (8, 10), "86": (10, 11), "90": (10, 10),
    "91": (10, 10), "351": (9, 9), "352": (6, 9), "353": (7, 9), "358": (6, 10), "420": (9, 9), "421": (9, 9),
}
_PART = re.compile(r"[0-9]+")
_STOP = re.compile(r"[^\w\n]*?[.,;]\s")


def phone_ends(m):
    """The one end of a phone: at its country's length, else at the first stop or comma, else the last."""
    if not m["country"]:
        return [m.end()]
    text, have = m.string, len(m["country"]) - 1
    low, high = PHONE_DIGITS.get(m["country"][1:], (max(6, 7 - have), 15 - have))
    n, ends = 0, []
    for part in _PART.finditer(text, m.end("country"), m.end()):
        n += len(part[0])
        if _ends(text, part.end()):
            ends.append((n, part.end(), _STOP.match(text, part.end())))
    # Numbers outside the plan are read by what every phone must have.
    for least, most in ((low, high), (max(6, 7 - have), 15 - have)):
        last = None
        for n, end, stop in ends:
            if least <= n <= most:
                last = end
                if stop:
                    break
        if last is not None:
            return [last]
    return []


def phone(m, end, permuter):
    """International numbers keep their country digits, domestic ones are permuted whole."""
    text = m.string[m.start() : end]
    head = m["country"] or ""
    digits = _digits(text[len(head):])
    n = len(digits)
    return head + _with_digits(text[len(head):], str(permuter(int(digits), 10**n, f"phone{head}{n}")).zfill(n))


def _valid_ssn(v):
    area, group, serial = v // 1_000_000, v // 10_000 % 100, v % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def ssn(m, permuter):
    value = int(_digits(m[0]))
    if not _valid_ssn(value):
        return None
    return _with_digits(m[0], f"{permuter(value, 10**9, 'ssn', _valid_ssn):09d}")


def ipv4(m, permuter):
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return None
    value = permuter(int.from_bytes(bytes(parts), "big"), 1 << 32, "ipv4")
    return ".".join(str(x) for x in value.to_bytes(4, "big"))


def _day(y, mo, d):
    if 1900 <= y < 2100 and 1 <= mo <= 12 and 1 <= d <= calendar.monthrange(y, mo)[1]:
        return datetime.date(y, mo, d).toordinal() - FIRST_DAY
    return None


def iso_date(m, permuter):
    day = _day(int(m["y"]), int(m["m"]), int(m["d"]))
    if day is None:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + permuter(day, DAYS, "date"))
    return f"{new.year:04d}{m['s']}{new.month:02d}{m['s']}{new.day:02d}"


def short_date(m, permuter):
    """Day first where that is a date, else month first; a pseudonym keeps to the same reading."""
    a, b, y = int(m["a"]), int(m["b"]), int(m["yy"])
    s = m["t"]
    if (day := _day(y, b, a)) is not None:
        new = datetime.date.fromordinal(FIRST_DAY + permuter(day, DAYS, "date"))
        return f"{new.day:02d}{s}{new.month:02d}{s}{new.year:04d}"
    if (day := _day(y, a, b)) is not None:
        new = datetime.date.fromordinal(
            FIRST_DAY + permuter(day, DAYS, "month-first", lambda v: datetime.date.fromordinal(FIRST_DAY + v).day > 12)
        )
        return f"{new.month:02d}{s}{new.day:02d}{s}{new.year:04d}"
    return None


@lru_cache(maxsize=256)
def _alphabet(page, category):
    """The characters beyond ASCII of one category among 256 code points."""
    return "".join(c for c in map(chr, range(max(128, page << 8), page + 1 << 8)) if unicodedata.category(c) == category)


def email(m, permuter):
    """Local part and host keep their shape; the top-level domain stays.

    A character beyond ASCII goes to one of its kind and of the same 256 code points, so that
    different names stay different.
    """
    local, _, host = m[0].rpartition("@")
    host, dot, top = host.rpartition(".")
    alphabets = _CLASSES + tuple(dict.fromkeys(_alphabet(ord(c) >> 8, unicodedata.category(c)) for c in local if not c.isascii()))
    return permute_text(local, "mailbox", permuter, alphabets) + "@" + permute_text(host, "mailhost", permuter) + dot + top


def secret(m, permuter):
    text = m[0]
    if not (re.search("[0-9]", text) and re.search("[A-Za-z]", text)):
        return None
    return permute_text(text, "secret", permuter, _alphabets(text))


def _alphabets(text):
    if len(text) >= 16 and re.fullmatch("[0-9a-f]+|[0-9A-F]+", text):
        return (_HEX[text.upper() == text],)
    return _CLASSES


def assigned(m, permuter):
    """The value after a name such as ``password =``."""
    return m["name"] + permute_text(m["value"], "secret", permuter, _alphabets(m["value"]))


# White space, brackets and marks that stand between the parts of a number.
_GAP = r"[^\w\n+@]{1,6}"
KINDS = {
    "email": (email, r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "iban": (iban, r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?"),
    "secret": (secret, r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|(?:sk|ghp|xox[bp])[-_][0-9A-Za-z-]{16,})(?![0-9A-Za-z])"),
    "assigned": (assigned, r"(?P<name>\b(?i:passw(?:or)?d|pwd|secret|api[_-]?key|access[_-]?token|token)\b\s*[=:]\s*[\"']?)(?P<value>[^\s\"']{6,})(?=[\"'\s]|$)"),
    "iso_date": (iso_date, r"(?<![\w./-])(?P<y>[0-9]{4})(?P<s>[-/.])(?P<m>[0-9]{2})(?P=s)(?P<d>[0-9]{2})(?![\w/-]|\.[0-9])"),
    "short_date": (short_date, r"(?<![\w./-])(?P<a>[0-9]{1,2})(?P<t>[-/.])(?P<b>[0-9]{1,2})(?P=t)(?P<yy>[0-9]{4})(?![\w/-]|\.[0-9])"),
    "ssn": (ssn, r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "ipv4": (ipv4, r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])"),
    "card": (card, r"(?<![\w+-])(?=[0-9]{4}(?:[ -]?[0-9]){9})[0-9]{4,}+(?:[ -][0-9]{2,}+){0,8}+"),
    "phone": (phone, rf"(?<![\w+-])(?:(?P<country>\+[0-9]{{1,3}})(?:{_GAP}[0-9]{{1,5}}){{2,6}}|(?:\+[0-9]{{8,15}}|\([0-9]{{3}}\)[ .-]{{0,2}}[0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}})(?![\w-]))"),
}
#: Kinds that are tried at several ends.
ENDS = {"card": card_ends, "iban": iban_ends, "phone": phone_ends}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, (_, p) in KINDS.items()))
_ALONE = {k: re.compile(p) for k, (_, p) in KINDS.items()}
# A text without any of these holds nothing to look for.
_HINT = re.compile(r"[0-9@]|(?i:passw|pwd|secret|key|token)")


def _read(kind, m, permuter):
    """(pseudonym, end) of the value of a kind at a match, or None."""
    change = KINDS[kind][0]
    if kind not in ENDS:
        new = change(m, permuter)
        return None if new is None else (new, m.end())
    return next(((new, end) for end in ENDS[kind](m) if (new := change(m, end, permuter)) is not None), None)


def pseudonymise(text: str, permuter: Permuter) -> tuple[str, int]:
    """The text with its personal values replaced, and how many there were."""
    if not text or not _HINT.search(text):
        return text, 0
    out, at, count = [], 0, 0
    pos = 0
    while (m := _FIND.search(text, pos)) is not None:
        found = None
        # The first kind that validates at this place wins.
        for kind in KINDS:
            own = m if kind == m.lastgroup else _ALONE[kind].match(text, m.start())
            if own and (found := _read(kind, own, permuter)) is not None:
                break
        if found is None:
            pos = _skip(text, m.start())
            continue
        new, end = found
        out += [text[at : m.start()], new]
        at = pos = end
        count += 1
    return ("".join(out) + text[at:] if count else text), count


_RUN = re.compile(r"[0-9A-Za-z]+")


def _skip(text, i):
    """Past the run of letters and digits at ``i``: no value starts inside one."""
    m = _RUN.match(text, i)
    return m.end() if m else i + 1


def pseudonymised(docs: DataFrame, key: bytes = DEMO_KEY, text="text", count="n_pseudonyms") -> DataFrame:
    """``docs`` with personal values of ``text`` replaced, and their number in ``count`` (if named).

    A column of the input that is called ``count`` gives way to the new one.
    """
    permuter = Permuter(key)

    @F.arrow_udf("struct<text: string, n: long>")
    def change(texts: pa.Array) -> pa.Array:
        def arrays(part):
            pairs = [pseudonymise(t, permuter) for t in part]
            return pa.StructArray.from_arrays(
                [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], names=["text", "n"]
            )

        parts = each_slice(texts, arrays) or [arrays([])]
        give_back()
        return pa.concat_arrays(parts)

    names = [c for c in docs.columns if c != count]
    docs, at = numbered(docs.select(*[quoted(c) for c in names]), text)
    done = docs.select(*[c for c in docs.columns if c != at], change(F.col(at)).alias("changed"))
    picked = [F.col("changed.text") if c == at else F.col(c) for c in docs.columns]
    return done.select(*picked, *([F.col("changed.n")] if count else [])).toDF(*names, *([count] if count else []))
