"""Sorted sets: facet zs (key, member, score). Order is score, then member by bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.functions.text import glob
from facetloom.operators import keyed

KEYS = ["key", "member"]


def order(rev: bool = False) -> tuple[Column, Column]:
    return (F.desc("score"), F.desc("member")) if rev else (F.asc("score"), F.asc("member"))


def zadd(zs: DataFrame, delta: DataFrame, exist: str = "", compare: str = "", place: str | None = None) -> DataFrame:
    """Upserts scores. exist: nx adds only, xx updates only; compare: gt or lt updates only to a larger or smaller score.

    Of a member given more than once the largest counts under gt and the smallest under lt; else the last by `place` (the first under nx), or, without one, the largest (the smallest under nx).
    """
    first = exist == "nx"
    if compare:
        one = F.max("score") if compare == "gt" else F.min("score")
    elif place:
        one = F.min_by("score", place) if first else F.max_by("score", place)
    else:
        one = F.min("score") if first else F.max("score")
    new = delta.groupBy(*KEYS).agg(one.alias("new__"))
    both = zs.select(*KEYS, "score").join(new, KEYS, "full")
    old, fresh = F.col("score"), F.col("new__")
    take = {"": F.lit(True), "gt": fresh > old, "lt": fresh < old}[compare] & F.lit(exist != "nx")
    value = F.when(fresh.isNull(), old).when(old.isNull(), F.lit(None) if exist == "xx" else fresh).otherwise(F.when(take, fresh).otherwise(old))
    return both.select(*KEYS, value.cast("double").alias("score")).where("score is not null")


def zincrby(zs: DataFrame, log: DataFrame) -> DataFrame:
    """Scores after all increments of a log (key, member, by); missing members start at 0."""
    both = zs.select(*KEYS, F.col("score").alias("by")).unionByName(log.select(*KEYS, F.col("by").cast("double")))
    return both.groupBy(*KEYS).agg(F.sum("by").alias("score"))


def zrem(zs: DataFrame, gone: DataFrame) -> DataFrame:
    return keyed.delete(zs, gone, KEYS)


def zmscore(zs: DataFrame, key: str, members: list[str]) -> DataFrame:
    args = keyed.arguments(zs.sparkSession, members, "member")
    return args.join(zs.where((F.col("key") == key) & F.col("member").isin(*members)).select("member", "score"), "member", "left").select("place", "member", "score")


def zrank(zs: DataFrame) -> DataFrame:
    """rank and revrank from 0 of all members, in one sort."""
    n = F.count("*").over(Window.partitionBy("key"))
    return keyed.ranked(zs, ["key"], *order()).withColumn("revrank", n - 1 - F.col("rank"))


def zcard(zs: DataFrame) -> DataFrame:
    return zs.groupBy("key").agg(F.count("*").alias("n"))


def zrange(zs: DataFrame, start: int, stop: int, rev: bool = False) -> DataFrame:
    return keyed.index_range(zs, ["key"], start, stop, *order(rev))


def _bound(col: Column, bound: str | float, low: bool) -> Column:
    """Score bounds: a number, '(number' without it, '-inf' and '+inf'."""
    text = str(bound)
    value = F.lit(float(text.lstrip("(")))
    if text.startswith("("):
        return col > value if low else col < value
    return col >= value if low else col <= value


def _lex(col: Column, bound: str, low: bool) -> Column:
    """Member bounds: '[a' with it, '(a' without, '-' and '+' for none."""
    if bound in ("-", "+"):
        return F.lit((bound == "-") == low)
    if bound[:1] not in ("[", "("):
        raise ValueError("a member bound begins with [ or (, or is - or +")
    value = F.lit(bound[1:])
    if bound[0] == "(":
        return col > value if low else col < value
    return col >= value if low else col <= value


def by_score(zs: DataFrame, low: str | float, high: str | float) -> DataFrame:
    """Filter on the score; it reaches the Parquet scan."""
    return zs.where(_bound(F.col("score"), low, True) & _bound(F.col("score"), high, False))


def by_lex(zs: DataFrame, low: str, high: str) -> DataFrame:
    return zs.where(_lex(F.col("member"), low, True) & _lex(F.col("member"), high, False))


def zrangebyscore(zs: DataFrame, low: str | float, high: str | float, offset: int = 0, count: int = -1, rev: bool = False) -> DataFrame:
    return keyed.index_range(by_score(zs, low, high), ["key"], offset, -1 if count < 0 else offset + count - 1, *order(rev))


def zrangebylex(zs: DataFrame, low: str, high: str, offset: int = 0, count: int = -1, rev: bool = False) -> DataFrame:
    order = F.desc("member") if rev else F.asc("member")
    return keyed.index_range(by_lex(zs, low, high), ["key"], offset, -1 if count < 0 else offset + count - 1, order)


def zcount(zs: DataFrame, low: str | float, high: str | float) -> DataFrame:
    return zcard(by_score(zs, low, high))


def zlexcount(zs: DataFrame, low: str, high: str) -> DataFrame:
    return zcard(by_lex(zs, low, high))


def zremrangebyscore(zs: DataFrame, low: str | float, high: str | float) -> DataFrame:
    return zs.where(~(_bound(F.col("score"), low, True) & _bound(F.col("score"), high, False)))


def zremrangebylex(zs: DataFrame, low: str, high: str) -> DataFrame:
    return zs.where(~(_lex(F.col("member"), low, True) & _lex(F.col("member"), high, False)))


def zremrangebyrank(zs: DataFrame, start: int, stop: int) -> DataFrame:
    ranked = zrank(zs).withColumn("n__", F.col("rank") + F.col("revrank") + 1)
    low = F.greatest(F.lit(0), F.lit(start) if start >= 0 else F.col("n__") + start)
    high = F.lit(stop) if stop >= 0 else F.col("n__") + stop
    return ranked.where((F.col("rank") < low) | (F.col("rank") > high)).select(*zs.columns)


def zpop(zs: DataFrame, n: int = 1, smallest: bool = True) -> tuple[DataFrame, DataFrame]:
    all_ = keyed.ranked(zs, ["key"], *order(not smallest))
    return all_.where(F.col("rank") < n), all_.where(F.col("rank") >= n).drop("rank")


def zmpop(zs: DataFrame, keys: list[str], n: int = 1, smallest: bool = True) -> DataFrame:
    """Of the first set in argument order that is there, its n lowest or highest."""
    there = zs.where(F.col("key").isin(*keys)).join(F.broadcast(keyed.arguments(zs.sparkSession, keys, "key")), "key")
    first = F.broadcast(there.agg(F.min("place").alias("first__")))  # one row
    return there.join(first, F.col("place") == F.col("first__")).orderBy(*order(not smallest)).limit(n).select("key", "member", "score")


def _weighted(zs: DataFrame, keys: list[str], weights: list[float] | None, how: str) -> DataFrame:
    """member, score (combined), n (sets that have it); one aggregate by member."""
    weights = weights or [1.0] * len(keys)
    weight = F.lit(None).cast("double")
    for k, w in zip(keys, weights, strict=True):
        weight = F.when(F.col("key") == k, F.lit(float(w))).otherwise(weight)
    value = F.col("score") * F.col("w__")
    total = {"sum": F.sum(value), "min": F.min(value), "max": F.max(value)}[how]
    return zs.where(F.col("key").isin(*keys)).withColumn("w__", weight).groupBy("member").agg(total.alias("score"), F.count_distinct("key").alias("n"))


def zunion(zs: DataFrame, keys: list[str], weights: list[float] | None = None, how: str = "sum") -> DataFrame:
    return _weighted(zs, keys, weights, how).drop("n")


def zinter(zs: DataFrame, keys: list[str], weights: list[float] | None = None, how: str = "sum") -> DataFrame:
    return _weighted(zs, keys, weights, how).where(F.col("n") == len(keys)).drop("n")


def zdiff(zs: DataFrame, keys: list[str]) -> DataFrame:
    first = F.max(F.when(F.col("key") == keys[0], F.col("score")))
    by = zs.where(F.col("key").isin(*keys)).groupBy("member").agg(first.alias("score"), F.count_distinct("key").alias("n"))
    return by.where((F.col("n") == 1) & F.col("score").isNotNull()).drop("n")


def zintercard(zs: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    n = F.count("*")
    return zinter(zs, keys).agg((F.least(n, F.lit(limit)) if limit else n).cast("long").alias("n"))


def store(zs: DataFrame, target: str, members: DataFrame) -> DataFrame:
    return zs.where(F.col("key") != target).unionByName(members.select(F.lit(target).alias("key"), "member", "score"))


def zrandmember(zs: DataFrame, n: int, seed: int) -> DataFrame:
    return keyed.random_n(zs, ["key"], n, seed, "member")


def zscan(zs: DataFrame, cursor: int, pattern: str = "*", count: int = 10) -> DataFrame:
    return keyed.page(zs.where(glob(F.col("member"), pattern)), ["key"], cursor, count, "member")
