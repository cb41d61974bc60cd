"""Approximate summaries: distinct counts, membership, frequencies, heavy hitters, quantiles.

Where Spark has a sketch it is used; the Bloom, cuckoo and count-min tables are rows (one for each counter), so that they merge by
an aggregate, stay in the JVM, and spill like any table. Exact forms stand beside them.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Distinct counts.


def pfadd(df: DataFrame, by: list[str], item: str, lg: int = 14) -> DataFrame:
    return df.groupBy(*by).agg(F.hll_sketch_agg(item, lg).alias("sketch"))


def pfmerge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def pfcount(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("n", F.hll_sketch_estimate("sketch"))


# Bloom filters: rows (key, bit). A filter of more items than its capacity has 2, 4, 8, ... parts of the size for that capacity, and a hash deals each item
# to one of them; the bits of n parts start at (n - 1) * size. So filters of one capacity merge by distinct(), also where their parts differ in number.


def bloom_size(capacity: int, error: float) -> tuple[int, int]:
    """Bits and hash functions of a part."""
    bits = max(8, math.ceil(-capacity * math.log(error) / math.log(2) ** 2))
    return bits, max(1, round(bits / capacity * math.log(2)))


def _power(n: Column) -> Column:
    """The largest power of two that is not above n."""
    return F.pow(F.lit(2.0), F.length(F.bin(n)) - 1).cast("long")


def _part(bits: int) -> Column:
    """The part of a bit, through all numbers of parts: 0; 1, 2; 3 to 6; ..."""
    return F.floor(F.col("bit") / bits)


def _probes(item: Column, bits: int, hashes: int, parts: Column) -> Column:
    """Places by double hashing, in the item's part."""
    a, b = F.xxhash64(item), F.xxhash64(F.lit(1), item)
    start = (parts - 1 + F.pmod(F.xxhash64(F.lit(2), item), parts)) * bits
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: start + F.pmod(F.pmod(a, F.lit(bits)) + F.pmod(b, F.lit(bits)) * i, F.lit(bits)))


def _with_parts(items: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """items with `parts` of their key, 1 where there is none."""
    same = reduce(and_, (F.col(f"i.{c}").eqNullSafe(F.col(f"p.{c}")) for c in by), F.lit(True))
    return items.alias("i").join(parts.alias("p"), same, "left").select("i.*", F.coalesce("p.parts", F.lit(1).cast("long")).alias("parts"))


def bloom(df: DataFrame, by: list[str], item: str, capacity: int, error: float = 0.01) -> DataFrame:
    bits, hashes = bloom_size(capacity, error)
    items = df.select(*by, F.col(item).alias("item__")).distinct()
    full = items.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > capacity).select(*by, (_power(F.floor((F.col("n") - 1) / capacity)) * 2).alias("parts"))
    return _with_parts(items, full, by).select(*by, F.explode(_probes(F.col("item__"), bits, hashes, F.col("parts"))).alias("bit")).distinct()


def bloom_exists(filters: DataFrame, by: list[str], asked: DataFrame, item: str, capacity: int, error: float = 0.01) -> DataFrame:
    """asked with `found`: true for all that were added, and for a share `error` of others."""
    bits, hashes = bloom_size(capacity, error)
    parts = filters.select(*by, _power(_part(bits) + 1).alias("parts")).distinct()
    probes = _with_parts(asked.select(*by, item).distinct(), parts, by).select(*by, item, "parts", F.explode(F.array_distinct(_probes(F.col(item), bits, hashes, F.col("parts")))).alias("bit"))
    # Numbers of parts are single bits of a number: found where one of them misses no probe.
    missed = F.coalesce(F.bit_or(F.when(F.col("hit").isNull(), F.col("parts"))), F.lit(0).cast("long"))
    hits = probes.join(filters.withColumn("hit", F.lit(1)), [*by, "bit"], "left").groupBy(*by, item).agg((missed != F.bit_or("parts")).alias("found"))
    return asked.join(hits, [*by, item], "left")


def _filled(filters: DataFrame, by: list[str], bits: int) -> DataFrame:
    """by, part, x: bits set in each part."""
    return filters.groupBy(*by, _part(bits).alias("part")).agg(F.count("*").alias("x"))


def bloom_info(filters: DataFrame, by: list[str], capacity: int, error: float = 0.01) -> DataFrame:
    """capacity, size and hashes of a part, as reserved; parts, bits_set in all, and most_set in one of them."""
    bits, hashes = bloom_size(capacity, error)
    info = _filled(filters, by, bits).groupBy(*by).agg(F.bit_or(_power(F.col("part") + 1)).alias("parts"), F.sum("x").alias("bits_set"), F.max("x").alias("most_set"))
    return info.select(*by, F.lit(capacity).alias("capacity"), F.lit(bits).alias("size"), F.lit(hashes).alias("hashes"), "parts", "bits_set", "most_set")


def bloom_card(filters: DataFrame, by: list[str], capacity: int, error: float = 0.01) -> DataFrame:
    """n: how many different items were added, estimated from the bits that are set in each part."""
    bits, hashes = bloom_size(capacity, error)
    return _filled(filters, by, bits).groupBy(*by).agg(F.sum(F.log(1 - F.least(F.col("x"), F.lit(bits - 1)) / bits) * (-bits / hashes)).alias("n"))


# Cuckoo filters: rows (key, fingerprint, bucket, n); the bucket is the smaller of the two that a fingerprint may take.


def _cuckoo(item: Column, buckets: int) -> tuple[Column, Column]:
    finger = F.pmod(F.xxhash64(F.lit("f"), item), F.lit(65535)) + 1
    one = F.pmod(F.xxhash64(item), F.lit(buckets))
    # Symmetric: from either bucket the other one follows by the fingerprint.
    two = F.pmod(F.xxhash64(F.lit("b"), finger) - one, F.lit(buckets))
    return finger.cast("int"), F.least(one, two)


def cuckoo(df: DataFrame, by: list[str], item: str, buckets: int = 1 << 16, unique: bool = False) -> DataFrame:
    finger, bucket = _cuckoo(F.col(item), buckets)
    source = df.select(*by, item).distinct() if unique else df
    return source.select(*by, finger.alias("finger"), bucket.alias("bucket")).groupBy(*by, "finger", "bucket").agg(F.count("*").alias("n"))


def cuckoo_delete(filters: DataFrame, by: list[str], gone: DataFrame, item: str, buckets: int = 1 << 16) -> DataFrame:
    """One occurrence less for each row of gone."""
    less = cuckoo(gone, by, item, buckets).withColumn("n", -F.col("n"))
    return filters.unionByName(less).groupBy(*by, "finger", "bucket").agg(F.sum("n").alias("n")).where("n > 0")


def cuckoo_count(filters: DataFrame, by: list[str], asked: DataFrame, item: str, buckets: int = 1 << 16) -> DataFrame:
    """asked with `n`, 0 for what was certainly not added."""
    finger, bucket = _cuckoo(F.col(item), buckets)
    marked = asked.withColumn("finger", finger).withColumn("bucket", bucket)
    return marked.join(filters, [*by, "finger", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0))).drop("finger", "bucket")


def cuckoo_info(filters: DataFrame, by: list[str], buckets: int = 1 << 16) -> DataFrame:
    """Items held, different fingerprints and buckets in use, and buckets there are."""
    return filters.groupBy(*by).agg(F.sum("n").alias("items"), F.count("*").alias("fingers"), F.count_distinct("bucket").alias("used")).withColumn("buckets", F.lit(buckets))


# Count-min sketches: rows (key, row, cell, n).


def cms_size(error: float, probability: float) -> tuple[int, int]:
    """Width and depth for an error (share of the total) that is kept with a probability."""
    return math.ceil(math.e / error), max(1, math.ceil(math.log(1 / (1 - probability))))


def _cells(item: Column, width: int, depth: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.struct(i.alias("row"), F.pmod(F.xxhash64(i, item), F.lit(width)).alias("cell")))


def cms(df: DataFrame, by: list[str], item: str, n: Column | None = None, width: int = 2000, depth: int = 7) -> DataFrame:
    count = F.lit(1).cast("long") if n is None else n
    # Equal items are summed first, so that a frequent one is exploded once for each task.
    items = df.select(*by, F.col(item), count.alias("n")).groupBy(*by, item).agg(F.sum("n").alias("n"))
    cells = items.select(*by, "n", F.inline(_cells(F.col(item), width, depth)))
    return cells.groupBy(*by, "row", "cell").agg(F.sum("n").alias("n"))


def cms_query(sketches: DataFrame, by: list[str], asked: DataFrame, item: str, width: int = 2000, depth: int = 7) -> DataFrame:
    """asked (distinct) with the estimate `n`, never below the truth."""
    cells = asked.select(*by, item).distinct().select(*by, item, F.inline(_cells(F.col(item), width, depth)))
    return cells.join(sketches, [*by, "row", "cell"], "left").groupBy(*by, item).agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))


def cms_merge(parts: list[tuple[DataFrame, float]], by: list[str]) -> DataFrame:
    """Weighted sum of sketches of one size."""
    out = None
    for df, weight in parts:
        one = df.withColumn("n", F.col("n") * F.lit(weight))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*by, "row", "cell").agg(F.sum("n").alias("n"))


def cms_info(sketches: DataFrame, by: list[str], width: int = 2000, depth: int = 7) -> DataFrame:
    """Size and the sum of all counts, which every row of cells has."""
    return sketches.where("row = 0").groupBy(*by).agg(F.sum("n").alias("total")).select(*by, F.lit(width).alias("width"), F.lit(depth).alias("depth"), "total")


# Heavy hitters.


def topk(df: DataFrame, by: list[str], item: str, k: int, n: Column | None = None) -> DataFrame:
    """The k most frequent items of each group, exactly; ties to the smaller item."""
    counts = df.groupBy(*by, item).agg((F.count("*") if n is None else F.sum(n)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc(item))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_approx(df: DataFrame, by: list[str], item: str, k: int) -> DataFrame:
    return df.groupBy(*by).agg(F.expr(f"approx_top_k({item}, {k})").alias("items")).select(*by, F.inline("items"))


def topk_query(top: DataFrame, asked: DataFrame, by: list[str], item: str) -> DataFrame:
    """Is an item in the list?"""
    return asked.join(top.select(*by, item, F.lit(True).alias("found")), [*by, item], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def topk_count(counts: DataFrame, asked: DataFrame, by: list[str], item: str) -> DataFrame:
    """asked with n, the count of items that the list holds, else 0."""
    return asked.join(counts.select(*by, item, "n"), [*by, item], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def topk_info(top: DataFrame, by: list[str], k: int) -> DataFrame:
    return top.groupBy(*by).agg(F.count("*").alias("held"), F.min("n").alias("least")).withColumn("k", F.lit(k))


# Mergeable digests of quantiles: rows (key, sketch).


def digest(df: DataFrame, by: list[str], value: str, k: int = 400) -> DataFrame:
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def digest_merge(digests: list[DataFrame], by: list[str], k: int = 400) -> DataFrame:
    out = digests[0].select(*by, "sketch")
    for d in digests[1:]:
        out = out.unionByName(d.select(*by, "sketch"))
    return out.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def digest_quantiles(digests: DataFrame, by: list[str], qs: list[float]) -> DataFrame:
    """by, n and the values at shares of the order, within the sketch's error of rank (some 0.7 % for k = 400)."""
    return digests.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), *(F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"q{i}") for i, q in enumerate(qs)))


def digest_ranks(digests: DataFrame, by: list[str], at: list[float]) -> DataFrame:
    return digests.select(*by, *(F.kll_sketch_get_rank_double("sketch", F.lit(x)).alias(f"r{i}") for i, x in enumerate(at)))


# Quantiles. Spark's percentile_approx is the mergeable sketch; exact ones interpolate between neighbours.


def quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    q = F.array(*map(F.lit, qs))
    return df.groupBy(*by).agg((F.percentile(value, q) if exact else F.percentile_approx(value, q, accuracy)).alias("quantiles"))


def cdf(df: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """Share of values below each point, equal ones counting half; rank is that share of all, revrank the rest."""
    v, n = F.col(value), F.count("*")
    below = [(F.sum((v < x).cast("long")) + F.sum((v == x).cast("long")) / 2) / n for x in at]
    return df.groupBy(*by).agg(n.alias("n"), *(b.alias(f"cdf{i}") for i, b in enumerate(below))).select(*by, "n", *(f"cdf{i}" for i in range(len(at))))


def rank(df: DataFrame, by: list[str], value: str, at: float) -> DataFrame:
    return cdf(df, by, value, [at]).select(*by, F.round(F.col("cdf0") * F.col("n")).cast("long").alias("rank"), F.round((1 - F.col("cdf0")) * F.col("n")).cast("long").alias("revrank"))


def byrank(df: DataFrame, by: list[str], value: str, ranks: list[int], rev: bool = False) -> DataFrame:
    """Values at places from 0 in order, in one sort."""
    order = F.desc(value) if rev else F.asc(value)
    w = Window.partitionBy(*by).orderBy(order)
    # The limit is pushed below the shuffle.
    first = df.withColumn("n__", F.row_number().over(w)).where(F.col("n__") <= max(ranks, default=-1) + 1)
    return first.withColumn("rank", (F.col("n__") - 1).cast("long")).where(F.col("rank").isin(*ranks)).select(*by, "rank", F.col(value).alias("value"))


def trimmed_mean(df: DataFrame, by: list[str], value: str, low: float, high: float) -> DataFrame:
    """Mean of the values between two quantiles, both included."""
    cuts = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("q__"))
    inside = df.join(cuts, by).where((F.col(value) >= F.col("q__")[0]) & (F.col(value) <= F.col("q__")[1]))
    return inside.groupBy(*by).agg(F.avg(value).alias("mean"))
