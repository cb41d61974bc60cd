"""Sets: facet st (key, member), distinct. Algebra goes through one aggregate by member, whatever the number of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.functions.text import glob
from facetloom.operators import keyed

KEYS = ["key", "member"]


def sadd(st: DataFrame, delta: DataFrame) -> DataFrame:
    return st.select(*KEYS).unionByName(delta.select(*KEYS)).distinct()


def srem(st: DataFrame, gone: DataFrame) -> DataFrame:
    return keyed.delete(st, gone, KEYS)


def scard(st: DataFrame) -> DataFrame:
    return st.groupBy("key").agg(F.count("*").alias("n"))


def smismember(st: DataFrame, key: str, members: list[str]) -> DataFrame:
    """place, member, found in argument order."""
    args = keyed.arguments(st.sparkSession, members, "member")
    mine = st.where((F.col("key") == key) & F.col("member").isin(*members)).select("member", F.lit(True).alias("found"))
    return args.join(mine, "member", "left").select("place", "member", F.coalesce("found", F.lit(False)).alias("found"))


def _by_member(st: DataFrame, keys: list[str]) -> DataFrame:
    """member, n (sets that have it), first (has the first set it?)."""
    mine = st.where(F.col("key").isin(*keys))
    return mine.groupBy("member").agg(F.count_distinct("key").alias("n"), F.max((F.col("key") == keys[0]).cast("int")).alias("first"))


def sinter(st: DataFrame, keys: list[str]) -> DataFrame:
    return _by_member(st, keys).where(F.col("n") == len(set(keys))).select("member")


def sunion(st: DataFrame, keys: list[str]) -> DataFrame:
    return st.where(F.col("key").isin(*keys)).select("member").distinct()


def sdiff(st: DataFrame, keys: list[str]) -> DataFrame:
    """Of the first set what no other has."""
    if keys[0] in keys[1:]:
        return st.select("member").limit(0)
    return _by_member(st, keys).where((F.col("first") == 1) & (F.col("n") == 1)).select("member")


def sintercard(st: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    n = F.count("*")
    return sinter(st, keys).agg((F.least(n, F.lit(limit)) if limit else n).cast("long").alias("n"))


def store(st: DataFrame, target: str, members: DataFrame) -> DataFrame:
    """The set under target is what members holds; an empty result leaves no key."""
    return st.where(F.col("key") != target).unionByName(members.select(F.lit(target).alias("key"), "member"))


def smove(st: DataFrame, source: str, target: str, member: str) -> DataFrame:
    here = (F.col("key") == source) & (F.col("member") == member)
    return st.withColumn("key", F.when(here, target).otherwise(F.col("key"))).distinct()


def spop(st: DataFrame, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    taken = keyed.random_n(st, ["key"], n, seed, "member")
    return taken, srem(st, taken)


def srandmember(st: DataFrame, n: int, seed: int) -> DataFrame:
    return keyed.random_n(st, ["key"], n, seed, "member")


def sscan(st: DataFrame, cursor: int, pattern: str = "*", count: int = 10) -> DataFrame:
    return keyed.page(st.where(glob(F.col("member"), pattern)), ["key"], cursor, count, "member")
