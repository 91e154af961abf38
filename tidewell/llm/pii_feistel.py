"""Personal data replaced by format-preserving pseudonyms.

Validated values are permuted by a keyed Feistel network within the set of values of their own
format, so the same value gets the same pseudonym in every document and a pseudonym is again valid:
card numbers (Luhn) and IBANs (mod 97) get new check digits, dates stay dates in the same notation,
phone numbers, addresses and secrets keep every separator and length.

The network alternates between the two halves of a value split as a * b >= size; results outside
the format are permuted again (cycle walking), which keeps the map one-to-one.

Defined cases: a null text stays null and has no findings, an empty one stays empty; repeated rows
are all returned; all columns of the input are kept. Digit runs that fail their check are left.
"""

from __future__ import annotations

import datetime
import re
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "email", "ip", "date", "secret")
#: Years whose dates count as personal dates; both ends are part of the permuted set.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: IBAN lengths by country: fixed values of the registry.
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 "
    "FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 "
    "LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 "
    "RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}

PATTERN = re.compile(
    r"""(?P<secret>(?i:\b(?:token|secret|password|passwd|api[_-]?key|key)\b["']?\s*[=:]\s*["']?)(?P<hidden>[0-9A-Za-z_\-/+]{16,}))
      | (?P<email>(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@-]))
      | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9]))
      | (?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9](?:[ .-]?[0-9]){5,12}|\([0-9]{3}\)[ ]?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})(?![\w]))
      | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
      | (?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9]))
      | (?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![\w/-]|\.[0-9]))
      | (?P<card>(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|3[0-9]{3}(?P<wide>[ -])[0-9]{6}(?P=wide)[0-9]{5})(?![\w-]|\.[0-9]))""",
    re.X,
)
#: Every finding holds an at sign, a key word, a plus before a digit, or a digit before another one or a dot.
HINT = re.compile(r"@|[0-9][0-9.]|\+[0-9]|(?i:token|secret|passw|key)")


class Cipher:
    """Keyed permutations of {0, ..., size-1}, one for each kind of value and size."""

    def __init__(self, key: bytes):
        self.key = key
        self.permute = lru_cache(maxsize=100_000)(self._permute)

    def _round(self, kind: str, size: int, step: int, half: int) -> int:
        data = f"{kind}:{size}:{step}:{half}".encode()
        return int.from_bytes(blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def _once(self, kind: str, size: int, a: int, b: int, value: int) -> int:
        left, right = divmod(value, b)
        for step in range(0, ROUNDS, 2):
            left = (left + self._round(kind, size, step, right)) % a
            right = (right + self._round(kind, size, step + 1, left)) % b
        return left * b + right

    def _permute(self, kind: str, size: int, value: int) -> int:
        if size < 2:
            return value
        b = 1
        while b * b < size:
            b *= 2
        a = -(-size // b)
        value = self._once(kind, size, a, b, value)
        while value >= size:
            value = self._once(kind, size, a, b, value)
        return value

    def spell(self, kind: str, text: str, letters: bool = True) -> str:
        """Permute a string among those with the same class of character at every place (0-9, a-z, A-Z)."""
        if len(text) > 40:
            return "".join(self.spell(kind, text[i : i + 40], letters) for i in range(0, len(text), 40))
        radix = [10 if c.isdigit() and c.isascii() else 26 if letters and c.isascii() and c.isalpha() else 1 for c in text]
        base = ["0" if r == 10 else ("a" if c.islower() else "A") if r == 26 else c for c, r in zip(text, radix, strict=True)]
        value, size = 0, 1
        for c, r, b in zip(text, radix, base, strict=True):
            value, size = value * r + (ord(c) - ord(b) if r > 1 else 0), size * r
        value = self.permute(kind + ":" + "".join("d" if r == 10 else "l" if r == 26 else c for c, r in zip(text, radix, strict=True)), size, value)
        out = []
        for r, b in zip(reversed(radix), reversed(base), strict=True):
            value, digit = divmod(value, r)
            out.append(chr(ord(b) + digit) if r > 1 else b)
        return "".join(reversed(out))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _fill(shape: str, digits: str) -> str:
    """The shape's digits and letters replaced one after the other."""
    following = iter(digits)
    return "".join(next(following) if c.isalnum() else c for c in shape)


def _card(cipher: Cipher, text: str) -> str | None:
    digits = re.sub(r"[ -]", "", text)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    body = cipher.spell("card", digits[:-1])
    return _fill(text, body + next(c for c in "0123456789" if luhn(body + c)))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(cipher: Cipher, text: str) -> str | None:
    flat = text.replace(" ", "")
    if IBAN_LENGTHS.get(flat[:2]) != len(flat) or _mod97(flat[4:] + flat[:4]) != 1:
        return None
    body = cipher.spell("iban" + flat[:2], flat[4:])
    return _fill(text, f"{flat[:2]}{98 - _mod97(body + flat[:2] + '00'):02d}{body}")


def _iban_part(text: str) -> str:
    """The beginning of a match as long as its country's numbers are, or "" if no blank or end follows there."""
    left = IBAN_LENGTHS.get(text[:2], 0)
    for end, c in enumerate(text):
        if not left:
            return text[:end] if c == " " else ""
        left -= c != " "
    return "" if left else text


def _ssn(cipher: Cipher, text: str) -> str | None:
    area, group, serial = map(int, text.split("-"))
    areas = [n for n in range(1, 900) if n != 666]
    if area not in areas or not group or not serial:
        return None
    value = cipher.permute("ssn", len(areas) * 99 * 9999, (areas.index(area) * 99 + group - 1) * 9999 + serial - 1)
    rest, serial = divmod(value, 9999)
    area, group = divmod(rest, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(cipher: Cipher, text: str) -> str | None:
    """The country code stays."""
    head = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
    at = head.end() if head else 0
    if not 7 <= sum(c.isdigit() for c in text) <= 15:
        return None
    digits = "".join(c for c in text[at:] if c.isdigit())
    return text[:at] + _fill(text[at:], cipher.spell("phone", digits))


def _email(cipher: Cipher, text: str) -> str | None:
    """The last label of the domain stays."""
    name, _, domain = text.rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{cipher.spell('name', name)}@{cipher.spell('host', host)}.{top}"


def _ip(cipher: Cipher, text: str) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    value = cipher.permute("ip", 1 << 32, int.from_bytes(bytes(parts), "big"))
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(cipher: Cipher, text: str) -> str | None:
    """ISO, or day before month unless only month before day is a date; the notation stays."""
    sep = next(c for c in text if not c.isdigit())
    parts = text.split(sep)
    if len(set(c for c in text if not c.isdigit())) > 1:
        return None
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
    for order in orders:
        try:
            day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + cipher.permute("date", LAST_DAY - FIRST_DAY + 1, day - FIRST_DAY))
        out = [""] * 3
        for value, i in zip((new.year, new.month, new.day), order, strict=True):
            out[i] = f"{value:0{len(parts[i])}d}"
        return sep.join(out)
    return None


def _secret(cipher: Cipher, text: str) -> str | None:
    if re.fullmatch(r"[0-9a-f]{1,80}", text):
        value = cipher.permute("hex", 16 ** len(text), int(text, 16))
        return f"{value:0{len(text)}x}"
    return cipher.spell("secret", text) if re.search("[0-9]", text) else None


_MAKERS = {"card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "email": _email, "ip": _ip, "date": _date, "secret": _secret}


def pseudonymise(text: str, cipher: Cipher) -> tuple[str, dict[str, int]]:
    """The text with every validated value replaced, and how many of each kind there were."""
    counts: dict[str, int] = {}
    if not HINT.search(text):
        return text, counts

    def replace(m: re.Match) -> tuple[str, int]:
        """What stands for the text from the match's start to the returned place, where the search goes on."""
        kind = next(k for k in KINDS if m[k] is not None)
        found = m["hidden"] if kind == "secret" else _iban_part(m[0]) if kind == "iban" else m[0]
        new = _MAKERS[kind](cipher, found) if found else None
        if new is None and kind == "iban":  # what it holds, or begins, may be something else
            return m[0][0], m.start() + 1
        end = m.start() + len(found) if kind == "iban" else m.end()
        if new is None and kind in ("phone", "secret"):  # what it holds may be something else
            inner = found if kind == "secret" else found[1:]
            if kind == "phone" and (card := _card(cipher, found)):
                new, kind = card, "card"
            elif inner:
                return m[0][: len(m[0]) - len(inner)] + scan(inner), end
        if new is None:
            return m[0], end
        counts[kind] = counts.get(kind, 0) + 1
        return new if kind == "iban" else m[0][: len(m[0]) - len(found)] + new, end

    def scan(part: str) -> str:
        out, at = [], 0
        while m := PATTERN.search(part, at):
            new, end = replace(m)
            out += part[at : m.start()], new
            at = end
        return "".join(out) + part[at:]

    return scan(text), counts


def replace_private(docs: DataFrame, key: bytes, counts: bool = True) -> DataFrame:
    """``docs`` with its ``text`` pseudonymised; with ``counts`` also n_private and a map of counts by kind."""
    at = docs.columns.index("text")
    docs = docs.select(*docs.columns)
    schema = T.StructType([f for f in docs.schema.fields if not counts or f.name not in ("n_private", "private")])
    kept = [docs.columns.index(f.name) for f in schema.fields]
    names = [f.name for f in schema.fields]
    if counts:
        schema = schema.add("n_private", T.LongType()).add("private", T.MapType(T.StringType(), T.LongType()))

    def run(batches):
        cipher = Cipher(key)
        for batch in batches:
            texts, found = [], []
            for text in batch.column(at).to_pylist():
                new, n = pseudonymise(text, cipher) if text is not None else (None, {})
                texts.append(new)
                found.append(n)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in kept]
            if counts:
                columns += [pa.array([sum(n.values()) for n in found], pa.int64()), pa.array([list(n.items()) for n in found], pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, *(["n_private", "private"] if counts else [])])

    return docs.mapInArrow(run, schema)
