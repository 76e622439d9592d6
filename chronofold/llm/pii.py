"""PII pseudonyms by format-preserving Feistel permutations.

Values are found by pattern and validated (Luhn digit, real octets, real calendar days, phone number
blocks); a validated value is mapped to its rank in the set of values of its format, the rank is permuted
by a keyed Feistel network with cycle walking, and the result is written in the same format. Equal
values so stay equal across documents, different ones stay different, and the key holder can undo it.

Formats: card numbers (13 to 19 digits, Luhn-valid, first digit and grouping kept), phone numbers
(North American blocks among themselves, other ten-digit numbers likewise, punctuation kept), IPv4 addresses, e-mail addresses (letters stay letters, digits
digits, top-level domain kept), social security numbers, ISO and day-first dates, hexadecimal secrets of
32 digits or more with both letters and digits.

The key is the caller's: whoever has it can undo the pseudonyms, so there is no default.

Scale: one map over the rows without a shuffle; texts without a digit or an at sign pass untouched.

Defined cases: null text stays null with no findings; nothing else in a text changes; repeated rows are
treated alike; texts of any length are scrubbed whole; an empty table gives no rows; other columns are kept by
`scrub`, those named like its counts are replaced.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm import textvec as tv

ROUNDS = 10
KINDS = ("email", "secret", "card", "phone", "ssn", "ip", "date")
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9À-ÖØ-öø-ÿ_%+\-]+(?:\.[A-Za-z0-9À-ÖØ-öø-ÿ_%+\-]+)*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})"
    r"|(?<![0-9A-Za-z])(?P<secret>[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"
    r"|(?P<phone>(?:(?<![0-9A-Za-z])|(?=\+))(?:\+?1[ .\-]?)?(?:\([0-9]{3}\) ?|[2-9][0-9]{2}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9]))"
    r"|(?<![0-9])(?P<card>[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])"
    r"|(?<![0-9\-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9\-])"
    r"|(?<![0-9.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?!\.?[0-9])"
    r"|(?<![0-9/\-.])(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/\-])"
)
FIRST_DAY, LAST_DAY = datetime.date(1, 1, 1).toordinal(), datetime.date(9999, 12, 31).toordinal()


def permute(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size): a balanced Feistel network on the next even number of bits,
    repeated until the result lies in the range."""
    if not 0 <= x < size:
        raise ValueError("out of range")
    if size == 1:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def f(r: int, v: int) -> int:
        data = f"{tweak}|{size}|{r}|{v}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=key[:64], digest_size=64).digest(), "big") & mask

    if half > 512:
        raise ValueError("range too large")
    while True:
        left, right = x >> half, x & mask
        if back:
            for r in reversed(range(ROUNDS)):
                left, right = right ^ f(r, left), left
        else:
            for r in range(ROUNDS):
                left, right = right, left ^ f(r, right)
        x = left << half | right
        if x < size:
            return x


def luhn(digits: str) -> int:
    """The check sum of a digit string that ends in its check digit; 0 if valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10


def _refill(template: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in template)


def _radix(text: str, alphabets: list[str], key: bytes, tweak: str, back: bool) -> str:
    """Permute a string over its per-place alphabets, as one mixed-radix number; pieces of up to 64
    places, each tweaked by what surrounds its kind of place only."""
    out = []
    for at in range(0, len(text), 64):
        part, places = text[at : at + 64], alphabets[at : at + 64]
        rank, size = 0, 1
        for c, a in zip(part, places, strict=True):
            rank, size = rank * len(a) + a.index(c), size * len(a)
        rank = permute(rank, size, key, f"{tweak}/{at}", back)
        got = []
        for a in reversed(places):
            rank, i = divmod(rank, len(a))
            got.append(a[i])
        out.append("".join(reversed(got)))
    return "".join(out)


_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def _alphabet(c: str) -> str:
    return next((a for a in _ALPHABETS if c in a), "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ" if c in "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ" else c)


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value; None if the value is not valid for its kind."""
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "email":
        head, _, top = value.rpartition(".")
        return _radix(head, [_alphabet(c) for c in head], key, f"email/{len(head)}/{''.join(c if len(_alphabet(c)) == 1 else '.' for c in head)}", back) + "." + top
    if kind == "secret":
        letters = "0123456789abcdef" if value == value.lower() else "0123456789ABCDEF"
        if value.isdigit() or value.isalpha():
            return None
        return _radix(value, [letters] * len(value), key, f"secret/{len(value)}", back)
    if kind == "card":
        if luhn(digits) or len(set(digits)) == 1:
            return None
        n = len(digits) - 2
        body = digits[0] + str(permute(int(digits[1:-1]), 10**n, key, f"card/{digits[0]}", back)).zfill(n)
        return _refill(value, body + str(-luhn(body + "0") % 10))
    if kind == "phone":
        n = digits[-10:]
        if "2" <= n[0] and "2" <= n[3]:
            area, block, line = int(n[:3]) - 200, int(n[3:6]) - 200, int(n[6:])
            rank = permute((area * 800 + block) * 10_000 + line, 800 * 800 * 10_000, key, "phone", back)
            rest, line = divmod(rank, 10_000)
            return _refill(value, digits[:-10] + f"{rest // 800 + 200}{rest % 800 + 200}{line:04d}")
        while True:  # the numbers outside the blocks, among themselves
            n = str(permute(int(n), 10**10, key, "phone/other", back)).zfill(10)
            if not ("2" <= n[0] and "2" <= n[3]):
                return _refill(value, digits[:-10] + n)
    if kind == "ssn":
        if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000":
            return None
        areas = [a for a in range(1, 900) if a != 666]
        rank = (areas.index(int(digits[:3])) * 99 + int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1
        rest, serial = divmod(permute(rank, len(areas) * 99 * 9999, key, "ssn", back), 9999)
        return f"{areas[rest // 99]:03d}-{rest % 99 + 1:02d}-{serial + 1:04d}"
    if kind == "ip":
        parts = value.split(".")
        if any(int(p) > 255 or (p != str(int(p))) for p in parts):
            return None
        rank = functools.reduce(lambda a, b: a * 256 + int(b), parts, 0)
        rank = permute(rank, 1 << 32, key, "ip", back)
        return ".".join(str(rank >> s & 255) for s in (24, 16, 8, 0))
    year, month, day = (digits[:4], digits[4:6], digits[6:]) if value[4] == "-" else (digits[4:], digits[2:4], digits[:2])
    try:
        at = datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    low, high = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()) if 1900 <= int(year) < 2100 else (FIRST_DAY, LAST_DAY)
    if low == FIRST_DAY:  # the years around 1900 to 2099
        gap = datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
        rank = at - low if at < datetime.date(1900, 1, 1).toordinal() else at - low - gap
        rank = permute(rank, high - low + 1 - gap, key, "date/far", back)
        d = datetime.date.fromordinal(rank + low if rank + low < datetime.date(1900, 1, 1).toordinal() else rank + low + gap)
    else:
        d = datetime.date.fromordinal(low + permute(at - low, high - low + 1, key, "date", back))
    return f"{d.year:04d}-{d.month:02d}-{d.day:02d}" if value[4] == "-" else f"{d.day:02d}{value[2]}{d.month:02d}{value[2]}{d.year:04d}"


def scrub_text(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    found: dict[str, int] = {}

    def put(m: re.Match) -> str:
        new = pseudonym(m.lastgroup, m[0], key, back)
        if new is None:
            return m[0]
        found[m.lastgroup] = found.get(m.lastgroup, 0) + 1
        return new

    return PATTERN.sub(put, text), found


def _scrub_rows(key: bytes):
    digit = np.zeros(256, bool)
    digit[48:58] = True

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            data, offsets = tv.text_buffers(batch.column(at))
            marks = np.r_[0, np.cumsum(digit[data])][offsets]
            signs = np.r_[0, np.cumsum(data == ord("@"))][offsets]
            # An address needs 4 digits, other numbers more; a secret 32 places, of which one digit.
            odd = np.flatnonzero((np.diff(signs) > 0) | (np.diff(marks) >= 4) | ((np.diff(marks) > 0) & (np.diff(offsets) >= 32)))
            counts = np.zeros((len(KINDS), batch.num_rows), np.int64)
            texts = batch.column(at)
            if len(odd):
                new = {}
                for i in odd.tolist():
                    text, found = scrub_text(data[offsets[i] : offsets[i + 1]].tobytes().decode(), key)
                    if found:
                        new[i] = text
                        for k, n in found.items():
                            counts[KINDS.index(k), i] = n
                if new:
                    rows = np.array(list(new))
                    mask = np.zeros(batch.num_rows, bool)
                    mask[rows] = True
                    texts = pa.compute.replace_with_mask(texts, pa.array(mask), pa.array(list(new.values()), texts.type))
            arrays = [texts if i == at else c for i, c in enumerate(batch.columns)] + [pa.array(c) for c in counts]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *(f"found_{k}" for k in KINDS)])

    return run


def scrub(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The rows with their text pseudonymised and found_<kind> counts added (replacing like-named
    columns of the input)."""
    keep = [c for c in docs.columns if c not in {f"found_{k}" for k in KINDS}]
    names = [f"c{i}" if c != text_col else "text" for i, c in enumerate(keep)]
    df = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes) + "".join(f", found_{k} long" for k in KINDS)
    out = df.mapInArrow(_scrub_rows(key), schema)
    return out.toDF(*keep, *(f"found_{k}" for k in KINDS))
