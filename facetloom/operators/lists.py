"""Lists: facet lst (key, pos from 0, elem). Operators give new positions from 0, for all keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetloom.operators import keyed


def _numbered(df: DataFrame) -> DataFrame:
    return keyed.ranked(df.withColumnRenamed("pos", "p__"), ["key"], F.col("p__"), name="pos").select("key", "pos", "elem")


def push(lst: DataFrame, new: DataFrame, left: bool = False, only_existing: bool = False) -> DataFrame:
    """new: key, place, elem. Left: each in turn goes before all others, so they stand reversed."""
    if only_existing:
        new = new.join(lst.select("key").distinct(), "key", "left_semi")
    place = -1 - F.col("place") if left else F.col("place")
    both = lst.select("key", F.lit(0).alias("side__"), F.col("pos").cast("long").alias("p__"), "elem").unionByName(new.select("key", F.lit(-1 if left else 1).alias("side__"), place.cast("long").alias("p__"), "elem"))
    return keyed.ranked(both, ["key"], F.col("side__"), F.col("p__"), name="pos").select("key", "pos", "elem")


def pop(lst: DataFrame, n: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """What is taken from each list, in the order taken (rank), and what is left."""
    order = F.asc("pos") if left else F.desc("pos")
    all_ = keyed.ranked(lst, ["key"], order)
    return all_.where(F.col("rank") < n), _numbered(all_.where(F.col("rank") >= n).drop("rank"))


def length(lst: DataFrame) -> DataFrame:
    return lst.groupBy("key").agg(F.count("*").alias("n"))


def lrange(lst: DataFrame, start: int, stop: int) -> DataFrame:
    return keyed.index_range(lst, ["key"], start, stop, F.col("pos")).drop("rank")


def lindex(lst: DataFrame, index: int) -> DataFrame:
    """key, elem for lists that reach so far; nothing for others."""
    if index >= 0:
        return lst.where(F.col("pos") == index).select("key", "elem")
    return keyed.index_range(lst, ["key"], index, index, F.col("pos")).select("key", "elem")


def lset(lst: DataFrame, index: int, elem: str) -> DataFrame:
    """Lists that do not reach so far stay as they are."""
    n = F.count("*").over(Window.partitionBy("key"))
    hit = F.col("pos") == (F.lit(index) if index >= 0 else n + index)
    return lst.withColumn("hit__", hit).withColumn("elem", F.when(F.col("hit__"), elem).otherwise(F.col("elem"))).drop("hit__")


def ltrim(lst: DataFrame, start: int, stop: int) -> DataFrame:
    return _numbered(lrange(lst, start, stop))


def lrem(lst: DataFrame, count: int, elem: str) -> DataFrame:
    """Without the first count of an element, the last -count, or all for 0."""
    if count == 0:
        return _numbered(lst.where(F.col("elem") != elem))
    order = F.asc("pos") if count > 0 else F.desc("pos")
    nth = F.row_number().over(Window.partitionBy("key", "elem").orderBy(order))
    return _numbered(lst.withColumn("n__", nth).where((F.col("elem") != elem) | (F.col("n__") > abs(count))).drop("n__"))


def linsert(lst: DataFrame, pivot: str, elem: str, before: bool = True) -> DataFrame:
    """Beside the first pivot of each list that has one."""
    first = lst.where(F.col("elem") == pivot).groupBy("key").agg(F.min("pos").alias("pos"))
    new = first.select("key", (F.col("pos") + (-0.5 if before else 0.5)).alias("pos"), F.lit(elem).alias("elem"))
    return _numbered(lst.select("key", F.col("pos").cast("double").alias("pos"), "elem").unionByName(new))


def lpos(lst: DataFrame, elem: str, rank: int = 1, count: int = 1, maxlen: int = 0) -> DataFrame:
    """Positions of an element: from the rank-th on (negative: from the end), up to count (0: all), among the first maxlen compared (0: all)."""
    if not rank:
        raise ValueError("rank counts from 1 or -1")
    order = F.asc("pos") if rank > 0 else F.desc("pos")
    if maxlen:
        lst = keyed.first_n(lst, ["key"], maxlen, order)
    hits = keyed.ranked(lst.where(F.col("elem") == elem), ["key"], order)
    low = abs(rank) - 1
    hits = hits.where(F.col("rank") >= low)
    return (hits.where(F.col("rank") < low + count) if count else hits).select("key", (F.col("rank") - low).alias("match"), "pos")


def lmpop(lst: DataFrame, keys: list[str], n: int = 1, left: bool = True) -> DataFrame:
    """Of the first list in argument order that is there, its first or last n."""
    args = keyed.arguments(lst.sparkSession, keys, "key")
    there = lst.where(F.col("key").isin(*keys)).join(F.broadcast(args), "key")
    order = F.asc("pos") if left else F.desc("pos")
    return _first_list(there, order, n)


def _first_list(there: DataFrame, order, n: int) -> DataFrame:
    first = F.broadcast(there.agg(F.min("place").alias("first__")))  # one row
    return there.join(first, F.col("place") == F.col("first__")).orderBy(order).limit(n).select("key", "pos", "elem")


def lmove(lst: DataFrame, source: str, target: str, from_left: bool, to_left: bool) -> DataFrame:
    """One element from an end of one list to an end of another (or the same)."""
    taken, rest = pop(lst.where(F.col("key") == source), 1, from_left)
    moved = taken.select(F.lit(target).alias("key"), F.lit(0).alias("place"), "elem")
    return push(lst.where(F.col("key") != source).unionByName(rest.select(*lst.columns)), moved, to_left)
