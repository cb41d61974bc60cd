"""Keys of all types: existence, expiry, renaming, scanning and sorting. Facet ks: key, type, expire_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.functions.text import glob
from facetloom.operators import keyed


def keyspace(facets: dict[str, DataFrame]) -> DataFrame:
    """key, type, expire_at over the facets by type name; a collection without rows has no key."""
    out = None
    for kind, df in facets.items():
        expire = F.col("expire_at") if "expire_at" in df.columns else F.lit(None).cast("long")
        one = df.select("key", F.lit(kind).alias("type"), expire.cast("long").alias("expire_at"))
        one = one if kind == "string" else one.distinct()
        out = one if out is None else out.unionByName(one)
    return out


def exists(ks: DataFrame, keys: list[str]) -> DataFrame:
    """n: how many of the keys are there, repeated ones counted each time."""
    args = keyed.arguments(ks.sparkSession, keys, "key")
    return args.join(ks.where(F.col("key").isin(*keys)).select("key").distinct(), "key", "left_semi").agg(F.count("*").alias("n"))


def keys(ks: DataFrame, pattern: str) -> DataFrame:
    return ks.where(glob(F.col("key"), pattern))


def scan(ks: DataFrame, cursor: int, pattern: str = "*", count: int = 10, kind: str | None = None) -> DataFrame:
    """A page of at least ten keys in key order."""
    df = keys(ks, pattern) if kind is None else keys(ks, pattern).where(F.col("type") == kind)
    return df.orderBy("key").offset(cursor).limit(max(count, 10))


def dbsize(ks: DataFrame) -> DataFrame:
    return ks.agg(F.count("*").alias("n"))


def random_key(ks: DataFrame, seed: int) -> DataFrame:
    return ks.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(1)


def ttl(expire_at: Column, now_ms: int, unit_ms: int = 1000) -> Column:
    """Remaining time; -1 without expiry. Missing keys, -2, come from an outer join with the keys asked for."""
    return F.when(expire_at.isNull(), F.lit(-1).cast("long")).otherwise(F.floor((expire_at - now_ms) / unit_ms))


def expiretime(expire_at: Column, unit_ms: int = 1000) -> Column:
    return F.when(expire_at.isNull(), F.lit(-1).cast("long")).otherwise(F.floor(expire_at / unit_ms))


def expire(df: DataFrame, at_ms: Column, rule: str = "always") -> DataFrame:
    """Sets expiry under a rule: always, nx (none yet), xx (some), gt (later), lt (earlier). No expiry counts as the latest time."""
    old = F.col("expire_at")
    ok = {"always": F.lit(True), "nx": old.isNull(), "xx": old.isNotNull(), "gt": old.isNotNull() & (at_ms > old), "lt": old.isNull() | (at_ms < old)}[rule]
    return df.withColumn("expire_at", F.when(ok, at_ms).otherwise(old))


def persist(df: DataFrame) -> DataFrame:
    return df.withColumn("expire_at", F.lit(None).cast("long"))


def rename(df: DataFrame, old: str, new: str, only_new: bool = False) -> DataFrame:
    """All rows of one key under another, which they replace; only_new: nothing happens where the other is there."""
    taken = df.where(F.col("key") == new)
    if only_new:
        free = F.broadcast(taken.agg((F.count("*") == 0).alias("free__")))  # one row
        return df.crossJoin(free).withColumn("key", F.when(F.col("free__") & (F.col("key") == old), new).otherwise(F.col("key"))).drop("free__")
    there = F.broadcast(df.where(F.col("key") == old).agg((F.count("*") > 0).alias("there__")))
    kept = df.crossJoin(there).where(~(F.col("there__") & (F.col("key") == new) & F.lit(old != new))).drop("there__")
    return kept.withColumn("key", F.when(F.col("key") == old, new).otherwise(F.col("key")))


def copy(df: DataFrame, old: str, new: str, replace: bool = False) -> DataFrame:
    taken = F.broadcast(df.where(F.col("key") == new).agg((F.count("*") > 0).alias("taken__")))
    source = df.where(F.col("key") == old).crossJoin(taken).where(F.lit(replace) | ~F.col("taken__")).drop("taken__").withColumn("key", F.lit(new))
    rest = df
    if replace:
        there = F.broadcast(df.where(F.col("key") == old).agg((F.count("*") > 0).alias("there__")))
        rest = df.crossJoin(there).where(~(F.col("there__") & (F.col("key") == new))).drop("there__")
    return rest.unionByName(source)


def move(df: DataFrame, key: str, db: int) -> DataFrame:
    """df has a column db."""
    return df.withColumn("db", F.when(F.col("key") == key, F.lit(db)).otherwise(F.col("db")))


def sort(elements: DataFrame, by: Column | None = None, desc: bool = False, alpha: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    """key, elem in sorted order with `rank` in each key; not alpha: by number, and what is no number counts as 0. `by` may be a column that a lookup join brought."""
    text = (by if by is not None else F.col("elem")).cast("string")
    value = text if alpha else F.coalesce(text.try_cast("double"), F.lit(0.0))
    order = [F.desc("by__"), F.desc("elem")] if desc else [F.asc("by__"), F.asc("elem")]
    return keyed.index_range(elements.withColumn("by__", value), ["key"], offset, -1 if count is None else offset + count - 1, *order).drop("by__")


def digest(kv: DataFrame) -> DataFrame:
    """One number for all keys and values, whatever their order."""
    return kv.agg(F.bit_xor(F.xxhash64("key", "value")).alias("digest"))
