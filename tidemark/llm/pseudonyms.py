"""Format-preserving pseudonyms for personal data.

Validated values (card numbers by their check digit, bank accounts by modulo 97,
calendar dates, network addresses, telephone and social security numbers, mail
addresses, quoted secrets) are replaced by other values of the same format. The
replacement is a keyed Feistel permutation of the format's value space: it is one
to one, has an inverse for holders of the key, and maps equal values alike in all
documents, so records stay linked.
"""

from __future__ import annotations

import datetime
import hashlib
import math
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Account lengths by country (fixed values of the IBAN registry).
LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutation of range(size) for any size, by cycle walking on an a x b grid."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tag: bytes, number: int, half: int) -> int:
        data = tag + number.to_bytes(1, "big") + half.to_bytes((half.bit_length() + 8) // 8, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def _grid(self, size: int) -> tuple[int, int]:
        a = math.isqrt(size - 1) + 1
        return a, -(-size // a)

    def permute(self, value: int, size: int, tag: str, inverse: bool = False) -> int:
        """Image of ``value``; ``tag`` separates the permutations of different formats."""
        if size < 2:
            return value
        a, b = self._grid(size)
        mark = f"{tag}/{size}/".encode()
        while True:
            left, right = divmod(value, b)
            for number in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
                sign = -1 if inverse else 1
                if number % 2:
                    right = (right + sign * self._round(mark, number, left)) % b
                else:
                    left = (left + sign * self._round(mark, number, right)) % a
            value = left * b + right
            if value < size:
                return value


def luhn_digit(body: str) -> str:
    """Check digit that completes ``body``."""
    total = 0
    for place, digit in enumerate(reversed(body)):
        d = int(digit) * (2 if place % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _mod97(account: str) -> int:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97


def _card_ok(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def _account_ok(flat: str) -> bool:
    return 15 <= len(flat) <= 34 and _mod97(flat) == 1


def _ends(kind: str, text: str) -> list[int]:
    """Places where a value that begins ``text`` may end, shortest first; a pattern also takes what follows a value.

    Cards and accounts end before a separator. Where the country's length is one
    of the ends, it is the only one.
    """
    if kind not in ("card", "iban"):
        return [len(text)]
    ends = [i for i, ch in enumerate(text) if ch in " -"] + [len(text)]
    flat = {end: sum(ch not in " -" for ch in text[:end]) for end in ends}
    if kind == "card":
        return [end for end in ends if flat[end] >= 13]
    of_country = [end for end in ends if flat[end] == LENGTHS.get(text[:2])]
    return of_country or [end for end in ends if flat[end] >= 15] or ends[-1:]


class Pseudonyms:
    """Finds and replaces values in a text; ``inverse`` restores them."""

    #: Fixed formats, tried in this order at each place.
    PATTERN = regex.compile(
        r"(?P<email>(?<![\w.+-])[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w]))"
        r"|(?P<unicode_email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
        r"|(?P<secret>(?i:(?<=\b(?:token|secret|password|passwd|api_?key|key)\s*[=:]\s*[\"'])[A-Za-z0-9+/_=.-]{8,}(?=[\"'])))"
        r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
        r"|(?P<date>(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\d/-]|\.\d))"
        r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))"
        r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
        r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d))"
        r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    )

    def __init__(self, key: bytes, inverse: bool = False):
        self.feistel, self.inverse = Feistel(key), inverse
        self.replace = lru_cache(maxsize=1 << 14)(self._replace)

    def _number(self, digits: str, tag: str) -> str:
        return str(self.feistel.permute(int(digits), 10 ** len(digits), tag, self.inverse)).zfill(len(digits))

    def _string(self, text: str, tag: str) -> str:
        """Permuted among strings of the same shape; hexadecimal ones are a shape of their own."""
        hexadecimal = regex.compile(r"[0-9a-f]+")
        made = self._shaped(text, tag)
        while bool(hexadecimal.fullmatch(made)) != bool(hexadecimal.fullmatch(text)):
            made = self._shaped(made, tag, bool(hexadecimal.fullmatch(text)))
        return made

    def _shaped(self, text: str, tag: str, hexadecimal: bool | None = None) -> str:
        """Letters and digits of ``text`` as one number of mixed base, each staying in its class."""
        classes = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
        if hexadecimal is None:
            hexadecimal = bool(regex.fullmatch(r"[0-9a-f]+", text))
        if hexadecimal:
            classes = ["0123456789abcdef"]
        of = [next((c for c in classes if ch in c), "") for ch in text]
        size, value = 1, 0
        for alphabet, ch in zip(of, text):
            if alphabet:
                size, value = size * len(alphabet), value * len(alphabet) + alphabet.index(ch)
        value = self.feistel.permute(value, size, tag, self.inverse)
        out = []
        for alphabet, ch in zip(reversed(of), reversed(text)):
            if alphabet:
                value, digit = divmod(value, len(alphabet))
                ch = alphabet[digit]
            out.append(ch)
        return "".join(reversed(out))

    def _replace(self, kind: str, text: str) -> str | None:
        """Pseudonym of one value, or None if it isn't valid."""
        if kind in ("email", "unicode_email"):
            name, _, host = text.rpartition("@")
            plain = name.translate(str.maketrans("", "", "_.+-"))
            if not plain:
                return None
            if plain.isascii():
                return f"{self._string(name, 'email')}@{host}"
            # letters beyond a-z move within the Latin letters of their case
            return f"{self._wide(name)}@{host}"
        if kind == "secret":
            return self._string(text, "secret")
        digits = _digits(text)
        if kind == "card":
            if not _card_ok(digits):
                return None
            body = digits[:-1]
            while True:  # stay among valid numbers that end here
                body = self._number(body, "card")
                made = _refill(text, body + luhn_digit(body))
                if _card_ok(_digits(made)) and not any(_card_ok(_digits(made[:end])) for end in _ends(kind, text)[:-1]):
                    return made
        if kind == "iban":
            flat = text.replace(" ", "")
            if not _account_ok(flat):
                return None
            body = flat[4:]
            while True:
                body = self._shaped(body, "iban", False)  # digits stay digits
                rest = iter(flat[:2] + f"{98 - _mod97(flat[:2] + '00' + body):02d}" + body)
                made = "".join(c if c == " " else next(rest) for c in text)
                if not any(_account_ok(made[:end].replace(" ", "")) for end in _ends(kind, text)[:-1]):
                    return made
        if kind == "date":
            return self._date(text)
        if kind == "ip":
            parts = [int(p) for p in text.split(".")]
            if any(p > 255 or str(p) != t for p, t in zip(parts, text.split("."))):
                return None
            value = self.feistel.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", self.inverse)
            return ".".join(map(str, value.to_bytes(4, "big")))
        if kind == "ssn":
            area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
            if area in (0, 666) or area > 899 or not group or not serial:
                return None
            rank = area - 1 - (area > 666)
            value = self.feistel.permute((rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn", self.inverse)
            value, serial = divmod(value, 9999)
            rank, group = divmod(value, 99)
            return f"{rank + 1 + (rank >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
        if kind == "phone":
            lead = len(digits) - 10
            return _refill(text, digits[:lead] + self._number(digits[lead:], "phone"))
        return None

    def _wide(self, text: str) -> str:
        letters = [chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()] + [chr(c) for c in range(ord("a"), ord("z") + 1)]
        capitals = [chr(c) for c in range(0xC0, 0xDF) if chr(c).isalpha()] + [chr(c) for c in range(ord("A"), ord("Z") + 1)]
        size, value, of = 1, 0, []
        for ch in text:
            table = next((t for t in ("0123456789", letters, capitals) if ch in t), None)
            of.append(table)
            if table:
                size, value = size * len(table), value * len(table) + list(table).index(ch)
        value = self.feistel.permute(value, size, "wide", self.inverse)
        out = []
        for table, ch in zip(reversed(of), reversed(text)):
            if table:
                value, digit = divmod(value, len(table))
                ch = table[digit]
            out.append(ch)
        return "".join(reversed(out))

    def _date(self, text: str) -> str | None:
        mark = next(c for c in text if not c.isdigit())
        parts = text.split(mark)
        if len(parts) != 3 or any(not p.isdigit() for p in parts):
            return None
        year, month, day = (parts[0], parts[1], parts[2]) if len(parts[0]) == 4 else (parts[2], *((parts[1], parts[0]) if mark == "." else (parts[0], parts[1])))
        try:
            ordinal = datetime.date(int(year), int(month), int(day)).toordinal()
        except ValueError:
            return None
        if not _FIRST <= ordinal <= _LAST:
            return None
        other = datetime.date.fromordinal(_FIRST + self.feistel.permute(ordinal - _FIRST, _LAST - _FIRST + 1, "date", self.inverse))
        # two digits unless the original shows that single ones are in use
        narrow = any(len(p) == 1 for p in parts)
        two = (lambda v: str(v)) if narrow else (lambda v: f"{v:02d}")
        if len(parts[0]) == 4:
            return f"{other.year}{mark}{two(other.month)}{mark}{two(other.day)}"
        first, second = (other.day, other.month) if mark == "." else (other.month, other.day)
        return f"{two(first)}{mark}{two(second)}{mark}{other.year}"

    def rewrite(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """(text with pseudonyms, spans (kind, start, length) in the original text)."""
        if not text or not regex.search(r"[0-9@=:]", text):
            return text, []
        spans, out, at, copied = [], [], 0, 0
        while match := self.PATTERN.search(text, at):
            kind, whole, start = match.lastgroup, match.group(), match.start()
            ends = _ends(kind, whole)
            at = match.end()
            for end in ends:
                other = self.replace(kind, whole[:end])
                if other is not None:
                    spans.append((kind.replace("unicode_", ""), start, end))
                    out += [text[copied:start], other]
                    at = copied = start + end
                    break
            else:
                if kind == "iban" and len(ends) == 1:  # what follows the account isn't part of it
                    at = start + ends[0]
        return "".join([*out, text[copied:]]), spans


def pseudonymise(docs: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, n_values, spans) of every row: the rewritten whole text and what was replaced.

    Null stays null, texts without values stay as they are, repeated rows are
    rewritten alike. Of a card or account followed by more digits or capitals the
    shortest valid part that ends before a separator is the value. A value that
    fails its format's check is left alone.
    """

    def run(batches):
        names = Pseudonyms(secret)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = [names.rewrite(one.as_py()) for one in part.column(1)]
                spans = pa.array([[{"kind": k, "start": s, "length": n} for k, s, n in found] for _, found in out], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([len(s) for _, s in out], pa.int64()), spans], ["id", "text", "n_values", "spans"]
                )

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string, n_values long, spans array<struct<kind:string,start:long,length:long>>")
