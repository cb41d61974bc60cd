"""Hashes: facet hsh (key, field, value, and expire_at where fields expire)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.functions.text import float_text, glob
from facetloom.operators import keyed
from facetloom.operators.keyspace import expire, ttl

KEYS = ["key", "field"]


def hset(hsh: DataFrame, delta: DataFrame, place: str | None = None) -> DataFrame:
    return keyed.upsert(hsh, delta, KEYS, place)


def added(hsh: DataFrame, delta: DataFrame) -> DataFrame:
    """key, n: how many fields an hset() would add."""
    return delta.select(*KEYS).distinct().join(hsh.select(*KEYS), KEYS, "left_anti").groupBy("key").agg(F.count("*").alias("n"))


def hsetnx(hsh: DataFrame, delta: DataFrame, place: str | None = None) -> DataFrame:
    """Of a field given more than once the first counts."""
    return keyed.insert_new(hsh, delta, KEYS, place)


def hsetex(hsh: DataFrame, delta: DataFrame, rule: str = "always") -> DataFrame:
    """rule: fnx, only where a hash has none of the fields given; fxx, only where it has all."""
    if rule == "always":
        return hset(hsh, delta)
    found = delta.select(*KEYS).join(hsh.select(*KEYS, F.lit(1).alias("old__")), KEYS, "left").groupBy("key").agg(F.count("old__").alias("old__"), F.count("*").alias("all__"))
    ok = found.where(F.col("old__") == 0) if rule == "fnx" else found.where(F.col("old__") == F.col("all__"))
    return hset(hsh, delta.join(ok.select("key"), "key", "left_semi"))


def hget(hsh: DataFrame, field: str) -> DataFrame:
    return hsh.where(F.col("field") == field).select("key", "value")


def hexists(hsh: DataFrame, field: str) -> DataFrame:
    """key, found: for all hashes, in one aggregate."""
    return hsh.groupBy("key").agg(F.max(F.col("field") == field).alias("found"))


def hmget(hsh: DataFrame, fields: list[str]) -> DataFrame:
    """key and values, an array in the order asked for with nulls for missing fields."""
    picked = hsh.where(F.col("field").isin(*fields)).groupBy("key").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"v{i}") for i, f in enumerate(fields)))
    return picked.select("key", F.array(*(f"v{i}" for i in range(len(fields)))).alias("values"))


def hdel(hsh: DataFrame, fields: list[str]) -> DataFrame:
    return hsh.where(~F.col("field").isin(*fields))


def hgetdel(hsh: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    return hsh.where(F.col("field").isin(*fields)), hdel(hsh, fields)


def hlen(hsh: DataFrame) -> DataFrame:
    return hsh.groupBy("key").agg(F.count("*").alias("n"))


def hgetall(hsh: DataFrame) -> DataFrame:
    """key, fields: a map."""
    return hsh.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hincrby(hsh: DataFrame, log: DataFrame) -> DataFrame:
    """Fields (key, field, value) after all whole increments of a log (key, field, by); missing fields start at 0, overflow raises."""
    both = hsh.select(*KEYS, "value", F.lit(None).cast("long").alias("by")).unionByName(log.select(*KEYS, F.lit(None).cast("string").alias("value"), F.col("by").cast("long")))
    # One shuffle, and what is not incremented is never read as a number.
    summed = both.groupBy(*KEYS).agg(F.max("value").alias("old"), F.sum("by").alias("by"))
    new = (F.coalesce(F.when(F.col("by").isNotNull(), F.col("old")).cast("long"), F.lit(0)) + F.col("by")).cast("string")
    return summed.select(*KEYS, F.when(F.col("by").isNull(), F.col("old")).otherwise(new).alias("value"))


def hincrbyfloat(hsh: DataFrame, field: str, by: float) -> DataFrame:
    return hsh.withColumn("value", F.when(F.col("field") == field, float_text(F.col("value").cast("double") + F.lit(by))).otherwise(F.col("value")))


def hstrlen(hsh: DataFrame, field: str) -> DataFrame:
    return hget(hsh, field).select("key", F.octet_length("value").alias("n"))


def hscan(hsh: DataFrame, cursor: int, pattern: str = "*", count: int = 10) -> DataFrame:
    return keyed.page(hsh.where(glob(F.col("field"), pattern)), ["key"], cursor, count, "field")


def hrandfield(hsh: DataFrame, n: int, seed: int) -> DataFrame:
    return keyed.random_n(hsh, ["key"], n, seed, "field")


def hexpire(hsh: DataFrame, fields: list[str], at_ms, rule: str = "always") -> DataFrame:
    """Expiry of single fields, under the rules that whole keys have."""
    mine = F.col("field").isin(*fields)
    return expire(hsh.where(mine), at_ms, rule).unionByName(hsh.where(~mine))


def httl(hsh: DataFrame, now_ms: int, unit_ms: int = 1000) -> DataFrame:
    """key, field, ttl: -1 without expiry."""
    return hsh.select(*KEYS, ttl(F.col("expire_at"), now_ms, unit_ms).alias("ttl"))


def hpersist(hsh: DataFrame, fields: list[str]) -> DataFrame:
    return hsh.withColumn("expire_at", F.when(F.col("field").isin(*fields), F.lit(None)).otherwise(F.col("expire_at")))


def hgetex(hsh: DataFrame, fields: list[str], at_ms) -> tuple[DataFrame, DataFrame]:
    """The fields, and the hashes with their expiry set."""
    return hsh.where(F.col("field").isin(*fields)), hexpire(hsh, fields, at_ms)
