"""String values by key: facet kv (key, value, expire_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.functions import text
from facetloom.operators import keyed


def get(kv: DataFrame, key: str) -> DataFrame:
    return kv.where(F.col("key") == key).select("key", "value")


def mget(kv: DataFrame, keys: list[str]) -> DataFrame:
    """place, key, value in the order asked for; null where a key is missing."""
    args = keyed.arguments(kv.sparkSession, keys, "key")
    return args.join(kv.select("key", "value").where(F.col("key").isin(*keys)), "key", "left").select("place", "key", "value")


def set_(kv: DataFrame, delta: DataFrame, when: str = "always", operand: Column | None = None, keep_ttl: bool = False) -> DataFrame:
    """Upserts delta (key, value, expire_at) under a condition on the old value: always, nx, xx, ifeq, ifne, ifdeq, ifdne.

    ifeq and ifne compare the old value with operand, a column of delta; ifdeq and ifdne its XXH3 digest. Missing keys fail ifeq and ifdeq, and pass ifne and ifdne.
    """
    old = kv.select(F.col("key").alias("k__"), F.col("value").alias("old__"), F.col("expire_at").alias("old_expire__"))
    new = delta.join(old, F.col("key") == F.col("k__"), "left")
    there = F.col("k__").isNotNull()
    state = text.xxh3(F.col("old__")) if when in ("ifdeq", "ifdne") else F.col("old__")
    equal = F.coalesce(state == operand, F.lit(False)) if operand is not None else F.lit(True)
    ok = {"always": F.lit(True), "nx": ~there, "xx": there, "ifeq": equal, "ifne": ~equal, "ifdeq": equal, "ifdne": ~equal}[when]
    expire = F.when(there, F.col("old_expire__")).otherwise(F.col("expire_at")) if keep_ttl else F.col("expire_at")
    return keyed.upsert(kv.select("key", "value", "expire_at"), new.where(ok).select("key", "value", expire.alias("expire_at")), ["key"])


def mset(kv: DataFrame, delta: DataFrame, place: str = "place") -> DataFrame:
    """Of a key given twice the last value counts."""
    return keyed.upsert(kv, delta, ["key"], place)


def msetnx(kv: DataFrame, delta: DataFrame, place: str = "place") -> DataFrame:
    """All of delta, if none of its keys is there; else nothing."""
    clash = delta.join(kv.select("key"), "key", "left_semi").agg((F.count("*") == 0).alias("free__"))
    return keyed.upsert(kv, delta.crossJoin(F.broadcast(clash)).where("free__").drop("free__"), ["key"], place)  # one row decides


def getset(kv: DataFrame, delta: DataFrame) -> DataFrame:
    """key, old: what set_() replaces."""
    return delta.select("key").join(kv.select("key", F.col("value").alias("old")), "key", "left")


def getdel(kv: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was there, and what is left."""
    return kv.join(keys, "key", "left_semi"), keyed.delete(kv, keys, ["key"])


def delex(kv: DataFrame, condition: Column) -> DataFrame:
    """Without the rows for which a condition on key and value holds."""
    return kv.where(~F.coalesce(condition, F.lit(False)))


def incrby(value: Column, by: Column | int) -> Column:
    """Whole-number addition on text; overflow raises an error, as ANSI arithmetic does."""
    return (value.cast("long") + (by if isinstance(by, Column) else F.lit(by).cast("long"))).cast("string")


def incr_log(kv: DataFrame, log: DataFrame) -> DataFrame:
    """key, n: old number (0 where missing) plus all increments of a log (key, by)."""
    both = kv.select("key", F.col("n").cast("long").alias("by")).unionByName(log.select("key", F.col("by").cast("long")))
    return both.groupBy("key").agg(F.sum("by").alias("n"))


def incrbyfloat(value: Column, by: float) -> Column:
    return text.float_text(value.cast("double") + F.lit(by))


def append(value: Column, suffix: Column) -> Column:
    return F.concat(F.coalesce(value, F.lit("")), suffix)


def strlen(value: Column) -> Column:
    """Bytes, not characters."""
    return F.octet_length(value)


def msetex(kv: DataFrame, delta: DataFrame, when: str = "always", place: str = "place") -> DataFrame:
    """All of delta or nothing: nx needs all keys missing, xx all there. Expiry is delta's."""
    if when == "nx":
        return msetnx(kv, delta, place)
    if when == "xx":
        missing = F.broadcast(delta.select("key").distinct().join(kv.select("key"), "key", "left_anti").agg((F.count("*") == 0).alias("all__")))  # one row decides
        delta = delta.crossJoin(missing).where("all__").drop("all__")
    return keyed.upsert(kv, delta, ["key"], place)


def getex(kv: DataFrame, keys: list[str], expire_at: Column) -> DataFrame:
    """kv with another expiry (null: none) for some keys; their values are read from it."""
    return kv.withColumn("expire_at", F.when(F.col("key").isin(*keys), expire_at.cast("long")).otherwise(F.col("expire_at")))
