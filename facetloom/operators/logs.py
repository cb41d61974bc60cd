"""Append logs with consumer groups: facet xs (key, ms, seq, fields...), groups (key, grp, ms, seq) and pending entries
(key, grp, ms, seq, consumer, delivered_ms, deliveries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.operators import keyed

ID = ["key", "ms", "seq"]


def order(rev: bool = False) -> tuple[Column, Column]:
    return (F.desc("ms"), F.desc("seq")) if rev else (F.asc("ms"), F.asc("seq"))


def parse_id(text: str, end: bool = False) -> tuple[int, int]:
    """'-', '+', 'ms' or 'ms-seq'; a time alone begins with entry 0 and ends with the last."""
    top = (1 << 63) - 1
    if text in ("-", "+"):
        return (0, 0) if text == "-" else (top, top)
    ms, _, seq = text.partition("-")
    return int(ms), int(seq) if seq else (top if end else 0)


def _from(ms: int, seq: int, strict: bool = False) -> Column:
    """The first comparison is a plain one on ms, which reaches the Parquet scan."""
    s = F.col("seq") > seq if strict else F.col("seq") >= seq
    return (F.col("ms") >= ms) & ((F.col("ms") > ms) | s)


def _to(ms: int, seq: int) -> Column:
    return (F.col("ms") <= ms) & ((F.col("ms") < ms) | (F.col("seq") <= seq))


def xadd(xs: DataFrame, new: DataFrame) -> DataFrame:
    """new: key, ms and fields; entries of a time get the next numbers of the log, and times before the log's last raise an error."""
    last = xs.groupBy("key").agg(F.max(F.struct("ms", "seq")).alias("last__"))
    w = Window.partitionBy("key", "ms").orderBy(*[c for c in new.columns if c not in ("key", "ms")])
    numbered = new.join(last, "key", "left").withColumn("n__", F.row_number().over(w) - 1)
    base = F.when(F.col("last__.ms") == F.col("ms"), F.col("last__.seq") + 1).otherwise(0)
    late = F.col("ms") < F.col("last__.ms")
    seq = F.when(late, F.raise_error(F.lit("an id must be larger than the log's last")).cast("long")).otherwise(base + F.col("n__"))
    return xs.unionByName(numbered.withColumn("seq", seq.cast("long")).select(*xs.columns))


def xlen(xs: DataFrame) -> DataFrame:
    return xs.groupBy("key").agg(F.count("*").alias("n"))


def xrange(xs: DataFrame, start: str = "-", end: str = "+", count: int | None = None, rev: bool = False) -> DataFrame:
    df = xs.where(_from(*parse_id(start)) & _to(*parse_id(end, True)))
    return df if count is None else keyed.first_n(df, ["key"], count, *order(rev))


def xread(xs: DataFrame, after: str, count: int | None = None) -> DataFrame:
    """Entries behind an id of every log; '$' is the last one, behind which stands nothing in a batch."""
    if after == "$":
        return xs.limit(0)
    df = xs.where(_from(*parse_id(after), strict=True))
    return df if count is None else keyed.first_n(df, ["key"], count, *order())


def xtrim_maxlen(xs: DataFrame, n: int) -> DataFrame:
    return keyed.first_n(xs, ["key"], n, F.desc("ms"), F.desc("seq"))


def xtrim_minid(xs: DataFrame, low: str) -> DataFrame:
    return xs.where(_from(*parse_id(low)))


def xdel(xs: DataFrame, ids: DataFrame) -> DataFrame:
    return keyed.delete(xs, ids, ID)


def xinfo(xs: DataFrame) -> DataFrame:
    first, last = F.min(F.struct("ms", "seq")), F.max(F.struct("ms", "seq"))
    return xs.groupBy("key").agg(F.count("*").alias("n"), first.alias("f"), last.alias("l")).select("key", "n", F.col("f.ms").alias("first_ms"), F.col("f.seq").alias("first_seq"), F.col("l.ms").alias("last_ms"), F.col("l.seq").alias("last_seq"))


def xreadgroup(xs: DataFrame, groups: DataFrame, consumer: Column, now_ms: int, count: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New entries for each group (with the consumer that gets them), the groups moved on, and the pending entries added."""
    at = groups.select("key", "grp", F.col("ms").alias("last_ms"), F.col("seq").alias("last_seq"))
    new = xs.join(at, "key").where((F.col("ms") > F.col("last_ms")) | ((F.col("ms") == F.col("last_ms")) & (F.col("seq") > F.col("last_seq"))))
    new = new if count is None else keyed.first_n(new, ["key", "grp"], count, *order())
    new = new.withColumn("consumer", consumer)
    moved = new.groupBy("key", "grp").agg(F.max(F.struct("ms", "seq")).alias("m__"))
    after = groups.join(moved, ["key", "grp"], "left").select("key", "grp", F.coalesce("m__.ms", "ms").alias("ms"), F.coalesce("m__.seq", "seq").alias("seq"))
    pending = new.select("key", "grp", "ms", "seq", "consumer", F.lit(now_ms).cast("long").alias("delivered_ms"), F.lit(1).alias("deliveries"))
    return new.drop("last_ms", "last_seq"), after, pending


def history(xs: DataFrame, pending: DataFrame, consumer: str) -> DataFrame:
    """Entries that a consumer has not acknowledged."""
    return xs.join(pending.where(F.col("consumer") == consumer).select("key", "grp", "ms", "seq"), ID)


def xack(pending: DataFrame, ids: DataFrame) -> DataFrame:
    return keyed.delete(pending, ids, ["key", "grp", "ms", "seq"])


def xackdel(xs: DataFrame, pending: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Acknowledged entries go from the log as well."""
    return xdel(xs, ids.join(pending, ["key", "grp", "ms", "seq"], "left_semi")), xack(pending, ids)


def xpending(pending: DataFrame) -> DataFrame:
    """By group: number, smallest and largest id; by consumer its number."""
    by = pending.groupBy("key", "grp", "consumer").agg(F.count("*").alias("n"), F.min(F.struct("ms", "seq")).alias("lo"), F.max(F.struct("ms", "seq")).alias("hi"))
    total = by.groupBy("key", "grp").agg(F.sum("n").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("consumer", "n"))).alias("consumers"))
    return total.select("key", "grp", "total", F.col("lo.ms").alias("min_ms"), F.col("hi.ms").alias("max_ms"), "consumers")


def xpending_range(pending: DataFrame, now_ms: int, min_idle: int = 0, start: str = "-", end: str = "+", count: int | None = None, consumer: str | None = None) -> DataFrame:
    df = pending.where(_from(*parse_id(start)) & _to(*parse_id(end, True)) & (now_ms - F.col("delivered_ms") >= min_idle))
    df = df if consumer is None else df.where(F.col("consumer") == consumer)
    return df if count is None else keyed.first_n(df, ["key", "grp"], count, *order())


def xclaim(pending: DataFrame, ids: DataFrame, consumer: str, now_ms: int, min_idle: int) -> DataFrame:
    """Pending entries; those of ids that were idle long enough go to the consumer, delivered once more."""
    mark = pending.join(ids.select("key", "grp", "ms", "seq").distinct().withColumn("asked__", F.lit(True)), ["key", "grp", "ms", "seq"], "left")
    return _claimed(mark.withColumn("take__", F.coalesce("asked__", F.lit(False)) & (now_ms - F.col("delivered_ms") >= min_idle)), pending.columns, consumer, now_ms)


def xautoclaim(pending: DataFrame, consumer: str, now_ms: int, min_idle: int, start: str = "-", count: int = 100) -> DataFrame:
    """As xclaim, for the first count idle entries from an id on."""
    idle = _from(*parse_id(start)) & (now_ms - F.col("delivered_ms") >= min_idle)
    nth = F.row_number().over(Window.partitionBy("key", "grp", idle).orderBy(*order()))
    return _claimed(pending.withColumn("take__", idle & (nth <= count)), pending.columns, consumer, now_ms)


def _claimed(df: DataFrame, columns: list[str], consumer: str, now_ms: int) -> DataFrame:
    take = F.col("take__")
    new = df.withColumn("consumer", F.when(take, consumer).otherwise(F.col("consumer"))).withColumn("delivered_ms", F.when(take, F.lit(now_ms).cast("long")).otherwise(F.col("delivered_ms")))
    return new.withColumn("deliveries", F.col("deliveries") + take.cast("int")).select(*columns)


def group_create(groups: DataFrame, xs: DataFrame, grp: str, at: str = "$") -> DataFrame:
    """A group for each log, from an id on: '$' is the log's last, '0' its beginning."""
    if at == "$":
        new = xs.groupBy("key").agg(F.max(F.struct("ms", "seq")).alias("l__")).select("key", F.lit(grp).alias("grp"), "l__.ms", "l__.seq")
    else:
        ms, seq = parse_id(at)
        new = xs.select("key").distinct().select("key", F.lit(grp).alias("grp"), F.lit(ms).cast("long").alias("ms"), F.lit(seq).cast("long").alias("seq"))
    return keyed.insert_new(groups, new, ["key", "grp"])


def group_setid(groups: DataFrame, grp: str, at: str) -> DataFrame:
    ms, seq = parse_id(at)
    mine = F.col("grp") == grp
    return groups.withColumn("ms", F.when(mine, F.lit(ms).cast("long")).otherwise(F.col("ms"))).withColumn("seq", F.when(mine, F.lit(seq).cast("long")).otherwise(F.col("seq")))


def group_destroy(groups: DataFrame, pending: DataFrame, grp: str) -> tuple[DataFrame, DataFrame]:
    return groups.where(F.col("grp") != grp), pending.where(F.col("grp") != grp)


def consumer_delete(pending: DataFrame, grp: str, consumer: str) -> DataFrame:
    return pending.where(~((F.col("grp") == grp) & (F.col("consumer") == consumer)))


def consumers(pending: DataFrame, now_ms: int) -> DataFrame:
    """key, grp, consumer, n, idle (since its last delivery)."""
    return pending.groupBy("key", "grp", "consumer").agg(F.count("*").alias("n"), (now_ms - F.max("delivered_ms")).alias("idle"))
