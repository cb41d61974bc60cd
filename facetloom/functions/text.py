"""Column functions on strings, indexes, globs and digests."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from facetloom.shipping import ship


def glob_regex(pattern: str) -> str:
    """An anchored regular expression with the meaning of a glob: * ? [a-z] [^a] and a backslash before any character."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "(?s:.*)"
        elif c == "?":
            out += "(?s:.)"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i + 1 : end]
            negate = body.startswith(("^", "!"))
            out += "[" + "^" * negate + re.sub(r"([\\\[\]&^])", r"\\\1", body[negate:]) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def glob(col: Column, pattern: str) -> Column:
    """Does a string match a glob? A plain prefix becomes startswith, which reaches the Parquet scan."""
    if re.fullmatch(r"[^*?\[\\]*\*", pattern):
        return col.startswith(pattern[:-1])
    if not re.search(r"[*?\[\\]", pattern):
        return col == pattern
    return col.rlike(glob_regex(pattern))


def at(i: int, n: Column) -> Column:
    """A place from 0 for an index that counts from the end where negative."""
    return F.lit(i) if i >= 0 else n + i


def getrange(value: Column, start: int, end: int) -> Column:
    """Bytes start to end, both included, negative from the end, clamped."""
    raw = value.cast("binary")
    n = F.octet_length(raw)
    a = F.greatest(at(start, n), F.lit(0))
    b = F.least(at(end, n), n - 1)
    return F.when(a > b, F.lit("")).otherwise(F.substring(raw, a + 1, b - a + 1).cast("string"))


def setrange(value: Column, offset: int, new: str) -> Column:
    """Bytes from offset on replaced by new; a gap is filled with zero bytes."""
    raw, size = value.cast("binary"), len(new.encode())
    padded = F.when(F.octet_length(raw) < offset, F.rpad(raw, offset, F.lit(b"\x00"))).otherwise(raw)
    tail = F.substring(padded, F.lit(offset + size + 1), F.greatest(F.octet_length(padded) - (offset + size), F.lit(0)))
    return F.concat(F.substring(padded, 1, offset), F.lit(new.encode()), tail).cast("string")


def float_text(x: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.17f", x), "0+$", ""), r"\.$", "")


def _lcs(a: str, b: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """A longest common subsequence and the ranges in which it runs, last first: of equal lengths the shorter prefix of a goes first."""
    n, m = len(a), len(b)
    bs = np.array([ord(c) for c in b], np.int64)
    step = max(1, math.isqrt(n))

    def below(row: np.ndarray, i: int) -> np.ndarray:
        hit = np.where(bs == ord(a[i - 1]), row[:-1] + 1, 0)
        return np.r_[np.int32(0), np.maximum.accumulate(np.maximum(hit, row[1:]))].astype(np.int32)

    # Every step-th row is kept; on the way back the rows between two of them are made again.
    row, kept = np.zeros(m + 1, np.int32), []
    for i in range(n + 1):
        row = below(row, i) if i else row
        if i % step == 0:
            kept.append(row)
    table: dict[int, np.ndarray] = {}

    def at_row(i: int) -> np.ndarray:
        if i not in table or i - 1 not in table:
            table.clear()
            first = max(0, i - 1) // step * step
            table[first] = kept[first // step]
            for k in range(first + 1, i + 1):
                table[k] = below(table[k - 1], k)
        return table[i]

    out, ranges, i, j = [], [], n, m
    while i and j:
        here = at_row(i)
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            if ranges and ranges[-1][0] == i and ranges[-1][2] == j:
                s = ranges[-1]
                ranges[-1] = (i - 1, s[1], j - 1, s[3])
            else:
                ranges.append((i - 1, i - 1, j - 1, j - 1))
            i, j = i - 1, j - 1
        elif table[i - 1][j] > here[j - 1]:
            i -= 1
        else:
            j -= 1
    return "".join(reversed(out)), ranges


def lcs(a: Column, b: Column, min_match: int = 0) -> Column:
    """struct<lcs, len, matches<a_start, a_end, b_start, b_end>>; time is quadratic in the lengths, in numpy rows, memory a row for each root of the length."""
    ship(SparkSession.active())

    @F.pandas_udf("lcs string, len int, matches array<struct<a_start:int,a_end:int,b_start:int,b_end:int>>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        got = [_lcs(p or "", q or "") for p, q in zip(x, y, strict=True)]
        names = ("a_start", "a_end", "b_start", "b_end")
        return pd.DataFrame({"lcs": [g[0] for g in got], "len": [len(g[0]) for g in got], "matches": [[dict(zip(names, r, strict=True)) for r in g[1] if r[1] - r[0] + 1 >= min_match] for g in got]})

    return run(a, b)


def xxh3(value: Column) -> Column:
    """XXH3-64 of a value as hex."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        import xxhash

        return pd.Series([None if v is None else xxhash.xxh3_64_hexdigest(v.encode() if isinstance(v, str) else v) for v in x], dtype=object)

    return run(value)


def _crc16_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (0x1021 if crc & 0x8000 else 0)) & 0xFFFF
        out.append(crc)
    return out


def key_slot(key: Column) -> Column:
    """CRC-16 (XMODEM) of a key, or of what stands in its first braces, modulo 16384."""
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    digits = F.hex(F.when(tag != "", tag).otherwise(key))
    table = F.array(*map(F.lit, _crc16_table()))
    places = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))

    def step(crc: Column, at: Column) -> Column:
        byte = F.conv(F.substr(digits, at, F.lit(2)), 16, 10).cast("int")
        return F.shiftleft(crc, 8).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.get(table, F.shiftright(crc, 8).bitwiseXOR(byte)))

    return F.when(key == "", F.lit(0)).otherwise(F.aggregate(places, F.lit(0), step) % 16384)
