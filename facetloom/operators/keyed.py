"""Upserts, deletes, ranks and pages that all collections share. State is never changed in place: old rows and a delta give new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(state: DataFrame, delta: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of delta replace those of equal keys; of several the one with the largest `order` counts. One shuffle by the keys, no join."""
    cols = state.columns
    new = delta.select(*cols, F.lit(1).alias("from__"), (F.col(order) if order else F.lit(0)).cast("long").alias("order__"))
    both = state.select(*cols, F.lit(0).alias("from__"), F.lit(0).cast("long").alias("order__")).unionByName(new)
    rest = [c for c in cols if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("from__", "order__")).alias("v__"))
    return last.select(*keys, "v__.*").select(*cols)


def insert_new(state: DataFrame, delta: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of delta whose keys state has not; of several with one key the first by `order`, or the smallest, counts."""
    rest = [c for c in state.columns if c not in keys]
    if rest:
        first = delta.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order) if order else F.struct(*rest)).alias("v__")).select(*keys, "v__.*")
    else:
        first = delta.select(*keys).distinct()
    return state.unionByName(first.select(*state.columns).join(state.select(*keys), keys, "left_anti"))


def delete(state: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return state.join(gone.select(*keys).distinct(), keys, "left_anti")


def live(df: DataFrame, now_ms: int) -> DataFrame:
    """Rows that have not expired: the predicate on read that stands for active expiry."""
    return df.where(F.col("expire_at").isNull() | (F.col("expire_at") > now_ms))


def arguments(spark, values: list, name: str = "arg") -> DataFrame:
    """Arguments with their places, in order."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"place int, {name} {'string' if not values or isinstance(values[0], str) else 'double'}")


def ranked(df: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """df with the place from 0 within its group."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def first_n(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The first n of each group; the limit is pushed below the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("n__", F.row_number().over(w)).where(F.col("n__") <= n).drop("n__")


def index_range(df: DataFrame, by: list[str], start: int, stop: int, *order: Column) -> DataFrame:
    """Places start to stop of each group, both included, negative ones from the end, with `rank`. With no negative index the limit is pushed below the shuffle."""
    if start >= 0 and stop >= 0:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= stop + 1).withColumn("rank", (F.col("rank") - 1).cast("long")).where(F.col("rank") >= start)
    sized = ranked(df, by, *order).withColumn("size__", F.count("*").over(Window.partitionBy(*by)))
    low = F.greatest(F.lit(0), F.lit(start) if start >= 0 else F.col("size__") + start)
    high = F.lit(stop) if stop >= 0 else F.col("size__") + stop
    return sized.where((F.col("rank") >= low) & (F.col("rank") <= high)).drop("size__")


def page(df: DataFrame, by: list[str], cursor: int, count: int, order: str) -> DataFrame:
    """A page of each group in a stable order: scans without repetition or loss, as data does not change between pages."""
    return index_range(df, by, cursor, cursor + count - 1, F.col(order)).drop("rank")


def random_n(df: DataFrame, by: list[str], n: int, seed: int, element: str) -> DataFrame:
    """n different elements of each group, by a seeded hash; for a negative n, -n draws with repetition."""
    h = F.xxhash64(F.lit(seed), *by, element)
    if n >= 0:
        return first_n(df, by, n, h, F.col(element))
    sized = ranked(df, by, F.col(element)).withColumn("size__", F.count("*").over(Window.partitionBy(*by)))
    draws = sized.groupBy(*by).agg(F.first("size__").alias("n__")).select(*by, "n__", F.explode(F.sequence(F.lit(1), F.lit(-n))).alias("draw"))
    draws = draws.withColumn("rank", F.pmod(F.xxhash64(F.lit(seed), *by, "draw"), F.col("n__")))
    return draws.drop("n__").join(sized.drop("size__"), [*by, "rank"]).drop("rank")
