"""Bitmaps: facet bm (key, offset of a set bit). Byte strings number bits from the most significant one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.operators.keyed import ranked


def setbit(bm: DataFrame, delta: DataFrame) -> DataFrame:
    """delta: key, offset, bit (0 or 1)."""
    kept = bm.join(delta.select("key", "offset"), ["key", "offset"], "left_anti")
    return kept.unionByName(delta.where(F.col("bit") == 1).select("key", "offset")).distinct()


def getbit(bm: DataFrame, offset: int) -> DataFrame:
    return bm.groupBy("key").agg(F.max((F.col("offset") == offset).cast("int")).alias("bit"))


def bitcount(bm: DataFrame, start: int = 0, end: int | None = None, unit: str = "byte") -> DataFrame:
    """Set bits of each key between two bytes or bits, both included."""
    scale = 8 if unit == "byte" else 1
    inside = F.col("offset") >= start * scale
    if end is not None:
        inside = inside & (F.col("offset") < (end + 1) * scale)
    return bm.where(inside).groupBy("key").agg(F.count("*").alias("n"))


def bitpos(bm: DataFrame, bit: int, start: int = 0, end: int | None = None) -> DataFrame:
    """First offset of a bit from start on, to end at most; -1 where none is. A clear bit is looked for among the bits up to end, or just behind the last set one."""
    inside = bm.where((F.col("offset") >= start) & (F.lit(True) if end is None else F.col("offset") <= end))
    if bit:
        low = inside.groupBy("key").agg(F.min("offset").alias("low"))
        return bm.select("key").distinct().join(low, "key", "left").select("key", F.coalesce("low", F.lit(-1)).cast("long").alias("pos"))
    # Offsets in order equal start, start + 1, ... as long as no bit is clear.
    gaps = ranked(inside, ["key"], F.asc("offset")).withColumn("want", F.col("rank") + start)
    found = gaps.groupBy("key").agg(F.min(F.when(F.col("offset") != F.col("want"), F.col("want"))).alias("gap"), (F.max("offset") + 1).alias("behind"))
    pos = F.coalesce("gap", "behind", F.lit(start))
    limited = pos if end is None else F.when(pos > end, F.lit(-1)).otherwise(pos)
    return bm.select("key").distinct().join(found, "key", "left").select("key", limited.cast("long").alias("pos"))


def bitop(bm: DataFrame, op: str, keys: list[str], width: int | None = None) -> DataFrame:
    """offset of the result's set bits, for and, or, xor, not, diff (first without the others), diff1 (the others without the first), andor (first and any other), one (exactly one). One aggregate by offset."""
    mine = bm.where(F.col("key").isin(*keys))
    if op == "not":
        size = mine.agg(F.coalesce(F.lit(width), ((F.max("offset") / 8).cast("long") + 1) * 8).alias("size"))
        every = size.where("size > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("offset"))
        return every.join(mine, "offset", "left_anti")
    by = mine.groupBy("offset").agg(F.count_distinct("key").alias("n"), F.max((F.col("key") == keys[0]).cast("int")).alias("first"))
    first = F.col("first") == 1
    rule = {"and": F.col("n") == len(set(keys)), "or": F.lit(True), "xor": F.col("n") % 2 == 1, "diff": first & (F.col("n") == 1), "diff1": ~first, "andor": first & (F.col("n") > 1), "one": F.col("n") == 1}[op]
    return by.where(rule).select("offset")


def bits_of(value: Column) -> Column:
    """The offsets of set bits of a byte string."""
    size = F.octet_length(value)
    every = F.sequence(F.lit(0), size * 8 - 1)
    return F.when(size == 0, F.array().cast("array<int>")).otherwise(F.filter(every, lambda i: F.get(F.split(bit_text(value), ""), i) == "1"))


def bit_text(value: Column) -> Column:
    """A byte string as zeros and ones."""
    nibbles = F.split(F.hex(value), "(?!^)")
    return F.array_join(F.transform(nibbles, lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), "")


def bitfield_get(value: Column, kind: str, offset: int) -> Column:
    """A field such as u8 or i16 at a bit offset; bits behind the end are 0."""
    size = int(kind[1:])
    if not 0 < size <= (64 if kind[0] == "i" else 63):
        raise ValueError(f"no field type {kind}")
    bits = F.rpad(F.substring(F.rpad(bit_text(value), offset + size, "0"), offset + 1, size), size, "0")
    whole = F.conv(bits, 2, 10).cast("decimal(20,0)")
    if kind[0] == "u":
        return whole.cast("long")
    return F.when(F.substring(bits, 1, 1) == "1", whole - F.lit(1 << size).cast("decimal(20,0)")).otherwise(whole).cast("long")


def bitfield_incrby(old: Column, kind: str, by: int, overflow: str = "wrap") -> Column:
    """The field's value after an increment: wrap around, sat at the ends, or fail (null). Fields of up to 62 bits."""
    size = int(kind[1:])
    low, high = (-(1 << (size - 1)), (1 << (size - 1)) - 1) if kind[0] == "i" else (0, (1 << size) - 1)
    new = old + F.lit(by).cast("long")
    if overflow == "sat":
        return F.least(F.greatest(new, F.lit(low)), F.lit(high))
    if overflow == "fail":
        return F.when((new >= low) & (new <= high), new)
    return F.pmod(new - low, F.lit(1 << size)) + low


def bitfield_set(value: Column, kind: str, offset: int, new: Column) -> Column:
    """The byte string with a field replaced, longer where it has to be."""
    size = int(kind[1:])
    bits = F.lpad(F.conv(F.pmod(new, F.lit(1 << size)).cast("string"), 10, 2), size, "0") if size < 63 else F.lpad(F.bin(new), size, "0")
    old = F.rpad(bit_text(value), F.greatest(F.octet_length(value) * 8, F.lit((offset + size + 7) // 8 * 8)), F.lit("0"))
    whole = F.concat(F.substring(old, 1, offset), bits, F.substr(old, F.lit(offset + size + 1)))
    parts = F.transform(F.sequence(F.lit(0), (F.length(whole) / 4 - 1).cast("int")), lambda i: F.conv(F.substr(whole, i * 4 + 1, F.lit(4)), 2, 16))
    return F.unhex(F.array_join(parts, ""))
