"""Time series: facet ts (series, ts_ms, value), labels (series, labels MAP). Buckets count from a given start, not from the epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _v() -> Column:
    return F.col("value")


def _t() -> Column:
    return F.col("ts_ms")


def _spread(f: Column) -> Column:
    return F.when(F.count(_v()) < 2, F.lit(0.0)).otherwise(f)


AGGREGATORS = {
    "avg": lambda: F.avg(_v()), "sum": lambda: F.sum(_v()), "min": lambda: F.min(_v()), "max": lambda: F.max(_v()), "range": lambda: F.max(_v()) - F.min(_v()), "count": lambda: F.count(_v()).cast("double"),
    "first": lambda: F.min_by(_v(), _t()), "last": lambda: F.max_by(_v(), _t()),
    "stdp": lambda: _spread(F.stddev_pop(_v())), "stds": lambda: _spread(F.stddev_samp(_v())), "varp": lambda: _spread(F.var_pop(_v())), "vars": lambda: _spread(F.var_samp(_v())),
}

POLICIES = {"first": lambda o: F.min_by(_v(), o), "last": lambda o: F.max_by(_v(), o), "min": lambda o: F.min(_v()), "max": lambda o: F.max(_v()), "sum": lambda o: F.sum(_v())}


def add(ts: DataFrame, policy: str = "last", order: str = "event_id") -> DataFrame:
    """One sample a time: duplicates merge by policy first, last (in arrival order), min, max, sum, or raise for block."""
    if policy == "block":
        one = ts.groupBy("series", "ts_ms").agg(F.count("*").alias("n"), F.first("value").alias("value"))
        return one.select("series", "ts_ms", F.when(F.col("n") > 1, F.raise_error(F.lit("a sample of that time exists"))).otherwise(_v()).cast("double").alias("value"))
    return ts.groupBy("series", "ts_ms").agg(POLICIES[policy](F.col(order)).alias("value"))


def retain(ts: DataFrame, retention_ms: int) -> DataFrame:
    """Samples not older than the newest of their series less the retention; 0 keeps all."""
    if not retention_ms:
        return ts
    newest = F.max("ts_ms").over(Window.partitionBy("series"))
    return ts.withColumn("new__", newest).where(_t() >= F.col("new__") - retention_ms).drop("new__")


def between(ts: DataFrame, start: int, end: int) -> DataFrame:
    return ts.where((_t() >= start) & (_t() <= end))


def range_(ts: DataFrame, start: int, end: int, count: int | None = None, rev: bool = False, low: float | None = None, high: float | None = None) -> DataFrame:
    """Samples in a span of time (and value), the first count of each series in order."""
    df = between(ts, start, end)
    if low is not None:
        df = df.where((_v() >= low) & (_v() <= high))
    if count is None:
        return df
    w = Window.partitionBy("series").orderBy(F.desc("ts_ms") if rev else F.asc("ts_ms"))
    return df.withColumn("n__", F.row_number().over(w)).where(F.col("n__") <= count).drop("n__")


def aggregate(ts: DataFrame, how: str, bucket_ms: int, start: int, end: int, by: list[str] | None = None) -> DataFrame:
    """series, bucket (its first time), value. Only buckets with samples."""
    by = by or ["series"]
    df = between(ts, start, end).withColumn("bucket", F.lit(start) + F.floor((_t() - start) / bucket_ms) * bucket_ms)
    if how == "twa":
        return _time_weighted(df, by)
    return df.groupBy(*by, "bucket").agg(AGGREGATORS[how]().alias("value"))


def _time_weighted(df: DataFrame, by: list[str]) -> DataFrame:
    """Area under straight lines between the samples of a bucket over its time; a single sample's value."""
    w = Window.partitionBy(*by, "bucket").orderBy("ts_ms", *[c for c in ("event_id",) if c in df.columns])
    pairs = df.withColumn("dt", F.lead("ts_ms").over(w) - _t()).withColumn("area", (_v() + F.lead("value").over(w)) / 2 * F.col("dt"))
    time, area = F.sum("dt"), F.sum("area")
    return pairs.groupBy(*by, "bucket").agg(F.when(F.coalesce(time, F.lit(0)) > 0, area / time).otherwise(F.min_by("value", "ts_ms")).alias("value"))


def latest(ts: DataFrame) -> DataFrame:
    """The newest sample of each series: one aggregate, no sort."""
    return ts.groupBy("series").agg(F.max("ts_ms").alias("ts_ms"), F.max_by("value", F.struct("ts_ms", *[c for c in ("event_id",) if c in ts.columns])).alias("value"))


def incrby(ts: DataFrame, by: float, at_ms: int) -> DataFrame:
    """A new sample for each series: the newest value plus by."""
    return latest(ts).select("series", F.lit(at_ms).cast("long").alias("ts_ms"), (_v() + by).alias("value"))


def delete(ts: DataFrame, start: int, end: int) -> DataFrame:
    return ts.where((_t() < start) | (_t() > end))


def info(ts: DataFrame) -> DataFrame:
    return ts.groupBy("series").agg(F.count("*").alias("total"), F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))


def query_index(labels: DataFrame, filters: list[str]) -> DataFrame:
    """Series whose labels satisfy all of name=value, name!=value, name=(a,b), name= (absent) and name!= (there)."""
    df = labels
    for f in filters:
        negate = "!=" in f
        name, _, value = f.partition("!=" if negate else "=")
        got = F.col("labels")[name]
        if not value:
            df = df.where(got.isNotNull() if negate else got.isNull())
        else:
            wanted = value[1:-1].split(",") if value.startswith("(") else [value]
            df = df.where(got.isNull() | ~got.isin(*wanted) if negate else got.isin(*wanted))
    return df.select("series")


def select(ts: DataFrame, labels: DataFrame, filters: list[str]) -> DataFrame:
    """Samples of the series that filters choose, with their labels."""
    return ts.join(labels.join(query_index(labels, filters), "series", "left_semi"), "series")


def downsample(ts: DataFrame, rules: list[tuple[str, str, str, int]], align_ms: int = 0) -> DataFrame:
    """Compaction rules (source, target, aggregator, bucket): rows series = target, ts_ms = bucket, value."""
    out = None
    for source, target, how, bucket in rules:
        mine = ts.where(F.col("series") == source).withColumn("bucket", F.lit(align_ms) + F.floor((_t() - align_ms) / bucket) * bucket)
        one = (_time_weighted(mine, ["series"]) if how == "twa" else mine.groupBy("series", "bucket").agg(AGGREGATORS[how]().alias("value"))).select(F.lit(target).alias("series"), F.col("bucket").alias("ts_ms"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def alter(meta: DataFrame, delta: DataFrame) -> DataFrame:
    """Rules of series (series, retention_ms, policy, labels): delta's replace those of the same series, nulls of it leave the old value."""
    new = delta.select(*(F.col(c).alias(c if c == "series" else f"{c}__") for c in meta.columns))
    both = meta.join(new, "series", "full")
    return both.select("series", *(F.coalesce(f"{c}__", c).alias(c) for c in meta.columns if c != "series"))
