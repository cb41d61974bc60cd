"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash of its id and text. A source whose target is r times its size takes each of its documents
floor(r) times, and once more those whose hash lies below a threshold. The thresholds come from histograms: sizes are
summed by source and hash bucket, a running sum over the buckets of a source finds the one in which its budget ends,
and only the rows of that boundary bucket are summed again with finer buckets, until all 60 bits are used. Budgets of a
source are nested: a larger one has a higher threshold on the same hashes. No row is sorted, and nothing but one row
for each source and bucket meets in a task. The last bucket, which holds one document, is taken when that comes nearer to
the target.

Defined results: null text has size 0; a null source is a source of its own, last in order; rows of one doc_id and text
share one hash and are taken or left together, those of one id (or of null ids) with other texts are not; null id and null text hash as empty ones; a source of
size 0 has target 0; an empty table gives no rows. Extra columns, whatever their names, are kept by mix() and do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetloom.llm.common import columns, cut, free_name, table

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVEL_BITS = 60, 12
#: No document is taken more often.
MOST = 3


def words(text: str | Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: str, text: str = "text") -> Column:
    """The first 60 bits of the MD5 of id and text."""
    both = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weight: Column, rounds: int = 64) -> DataFrame:
    """sizes (source, source_size) with a target: shares of the whole by weight, none above MOST times its size.

    The level L for which sum(min(MOST * size, L * weight)) is the whole rises until no further source is
    full: each round is one aggregate over the sources, and as every round but the last fills a source, few are needed.
    """
    df = cut(sizes.withColumn("weight", weight), "sources")
    full = F.lit(False)
    level, known = 0.0, -1
    for _ in range(rounds):
        whole, taken, weights, n = df.agg(F.sum("source_size"), F.sum(F.when(full, MOST * F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if n == known or not weights:
            break
        known, level = n, ((whole or 0) - (taken or 0)) / weights
        full = F.col("weight") * F.lit(level) >= MOST * F.col("source_size")
    return df.select("source", "source_size", F.least(F.col("weight") * F.lit(float(level)), MOST * F.col("source_size").cast("double")).alias("target"))


def ordinal_weight(sizes: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """sizes with a weight: the cycle repeated over the sources by code point, null last. Positions come from a distributed sort."""
    spark = sizes.sparkSession
    ordered = sizes.orderBy(F.col("source").asc_nulls_last())
    rows = ordered.rdd.zipWithIndex().map(lambda x: (x[0]["source"], x[0]["source_size"], cycle[x[1] % len(cycle)]))
    return spark.createDataFrame(rows, "source string, source_size long, weight double")


def thresholds(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, whole (times that every document is taken) and limit: documents with h < limit are taken once more.

    docs: source, size, h. goals: source, source_size, target.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(ratio + F.lit(1e-12)), F.lit(MOST)).cast("long")
    state = goals.withColumn("whole", whole).withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).withColumn("low", F.lit(0).cast("long"))
    for used in range(0, BITS, LEVEL_BITS):
        shift = BITS - used - LEVEL_BITS
        if used:
            # Rows inside the boundary bucket of their source; source and bucket are the join's keys, so no source is one task's.
            edge = state.select(F.col("source").alias("s"), F.shiftright("low", shift + LEVEL_BITS).alias("b"))
            inside = docs.join(edge, docs["source"].eqNullSafe(edge["s"]) & (F.shiftright(docs["h"], shift + LEVEL_BITS) == edge["b"]))
        else:
            inside = docs.withColumn("s", F.col("source"))
        sums = inside.groupBy("s", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        over = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = sums.withColumn("upto", F.sum("size").over(over))
        # The first bucket in which the running sum passes the budget, and what stands before it.
        found = run.join(state.select(F.col("source").alias("s2"), "left"), F.col("s").eqNullSafe(F.col("s2")))
        found = found.groupBy("s").agg(
            F.min(F.when(F.col("upto") > F.col("left"), F.col("bucket"))).alias("bucket"),
            F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))).alias("before"),
            F.max("bucket").alias("last"),
            F.lit(True).alias("hit"),
            F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "size"))).alias("at"),
        )
        passed = F.coalesce(F.col("bucket"), F.col("last") + 1)
        state = cut(
            state.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "whole",
                F.coalesce(F.col("left") - F.coalesce("before", F.lit(0)), F.col("left")).alias("left"),
                F.when(F.col("hit").isNull(), F.col("low")).otherwise(F.shiftleft(passed, shift)).alias("low"),
                F.col("at.size").alias("at_size"),
            ),
            "mix",
        )
    # All bits are used: the boundary is one hash. Take it where that misses the budget by less.
    last = (F.col("at_size").isNotNull() & (F.col("at_size") - F.col("left") < F.col("left"))).cast("long")
    return state.select("source", "source_size", "target", "whole", (F.col("low") + last).alias("limit"))


def plan(df: DataFrame, size: Column, source: str = "source", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """A slim table of the documents (doc_id, source, size, h) and the thresholds of the 5, 2, 1 mix."""
    slim = cut(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), hash60(doc_id).alias("h")), "sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(ordinal_weight(sizes), F.col("weight"))
    return slim, thresholds(slim, goals)


def _with_limits(slim: DataFrame, limits: DataFrame) -> DataFrame:
    joined = slim.alias("d").join(limits.withColumnRenamed("source", "s__"), F.col("d.source").eqNullSafe(F.col("s__")))
    return joined.withColumn("times__", F.col("whole") + (F.col("h") < F.col("limit")).cast("long"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim, limits = plan(table(spark, sf_dir, "documents"), words("text"))
    return _with_limits(slim, limits).select("doc_id", "size", "source_size", "target", (F.col("times__") * F.col("size")).alias("taken"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5(coalesce(cast(doc_id AS varchar), '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS z, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM d GROUP BY source),
-- the level: in the order in which sources fill, the first at which the next one does not
f AS (SELECT *, coalesce(sum(3 * z) OVER (ORDER BY 3 * z / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
        sum(w) OVER (ORDER BY 3 * z / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, sum(z) OVER () AS total FROM s),
l AS (SELECT arg_min((total - taken) / weights, 3 * z / w) FILTER (WHERE (total - taken) / weights < 3 * z / w) AS level FROM f),
t AS (SELECT source, z, least(3 * z, coalesce(w * level, 3 * z)) AS target FROM s, l),
b AS (SELECT source, z, target, CASE WHEN z > 0 THEN least(floor(target / z + 1e-12), 3) ELSE 0 END AS whole FROM t),
r AS (SELECT source, h, sum(size) AS own, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
k AS (SELECT r.source, r.h FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source
      WHERE upto <= greatest(0, target - whole * z) OR (upto - own <= greatest(0, target - whole * z) AND own - (greatest(0, target - whole * z) - (upto - own)) < greatest(0, target - whole * z) - (upto - own)))
SELECT d.doc_id, d.size::BIGINT AS size, b.z::BIGINT AS source_size, b.target AS target, ((b.whole + (k.h IS NOT NULL)::INT) * d.size)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.h = d.h
"""


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents, with their columns: each row as often as the mix takes it."""
    _, limits = plan(docs.select("doc_id", "source", "text"), words("text"))
    names = {c: free_name(docs, f"mix_{c}") for c in ("source", "whole", "limit", "copy")}
    limits = limits.select(*(F.col(c).alias(names[c]) for c in ("source", "whole", "limit")))
    times = F.col(names["whole"]) + (hash60("doc_id") < F.col(names["limit"])).cast("long")
    joined = docs.join(limits, docs["source"].eqNullSafe(F.col(names["source"]))).where(times > 0)
    return joined.withColumn(names["copy"], F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*columns(docs))
