"""Approximate nearest neighbours by shifted space-filling curves.

Equal vectors become one class, kept with its smallest ids. Classes are split into bands of norms that differ by less than a factor of
RATIO, so that within a band near in direction means a large inner product. Directions are projected by several random rotations to a few
dimensions, the cells of each grid follow quantiles of its coordinates and are shifted at random, and the Hilbert key of the cell orders the classes of a
band along one curve for each rotation; equal keys are ordered by a hash of their own on each curve. The orderings are range-partitioned sorts in Spark, of keys
and ids only; a class's rank is its place in its partition plus the sizes of the partitions before. A query is placed in every band and looks at the classes whose
rank on a curve is within a window of its own place, block by block of ranks, scores them with the inner product of the original
vectors in double precision, and the best of all bands, curves and blocks merge.

The window is measured, not set: for SAMPLED queries the nearest classes are found by comparing them with all, and the window is the one within
which the share `recall` of these stands on some curve. Where vectors have structure it is a few ranks; without structure it is a share of all.
Queries of a block are dealt into tiles of TILE, so that no task holds more than a block and a tile, however many queries there are.

Defined results: vectors that are null, zero, of a length other than the commonest, or hold a null or a non-finite
component take no part; equal ids with equal vectors count once; a null id takes no part; fewer candidates than asked for give fewer rows; no
vectors give no rows. Ties go to the smaller id, however many there are: all classes of a block that score like its last one kept are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetloom.llm.common import cut, dropped, hashed_share, small_batches, table

CURVES, DIMS, BITS, RECALL = 24, 8, 3, 0.95
#: Ranks in a block and queries in a tile: they bound what one group of the search holds.
BLOCK, TILE = 1024, 4096
#: Queries whose nearest classes are found by comparing all, so that the window can be measured.
SAMPLED = 200
#: Norms of a band differ by less than this, or by more where there would be more than BANDS of them; norms are counted in steps of STEP of their logarithm.
RATIO, BANDS, STEP = 2.0, 64, 0.01
#: Classes whose coordinates give the quantiles, and the standard deviations of a normal coordinate at which these are taken.
SAMPLE, POINTS = 4096, np.linspace(-3, 3, 25)


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id and v (array of double) of the vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    ok = F.col(vec_id).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"), ok.alias("ok")).where("ok").select("id", "v")
    # -0.0 is 0.0, so that equal vectors are equal keys.
    kept = kept.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    length = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return kept.where(F.size("v") == (length[0]["n"] if length else 0))


def classes(vectors: DataFrame, keep: int) -> DataFrame:
    """cid (the smallest id of equal vectors), v, ids (the keep smallest)."""
    w = Window.partitionBy("v").orderBy("id")
    few = vectors.distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep)
    return few.groupBy("v").agg(F.min("id").alias("cid"), F.array_sort(F.collect_list("id")).alias("ids")).select("cid", "v", "ids")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys of integer cells (rows) on the Hilbert curve of their dimension, after Skilling's transposition."""
    x = [c.astype(np.int64) for c in cells.T]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ t) >> b) & 1)
    return key


def _coordinates(v: np.ndarray, curves: int, dims: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each curve the projected directions of vectors (rows), and the shift of its grid."""
    v = v / np.abs(v).max(1)[:, None]
    v = v / np.sqrt((v * v).sum(1))[:, None]
    rng = np.random.default_rng(seed)
    dims = min(dims, v.shape[1])
    for _ in range(curves):
        turn = np.linalg.qr(rng.standard_normal((v.shape[1], dims)))[0]
        yield v @ turn, rng.random(dims)


def _grids(sample: np.ndarray, curves: int, dims: int, seed: int) -> np.ndarray:
    """Quantiles of the coordinates: curve, point, dimension."""
    share = [NormalDist().cdf(z) for z in POINTS]
    return np.stack([np.quantile(x, share, axis=0) for x, _ in _coordinates(sample, curves, dims, seed)])


def _keys(v: np.ndarray, grids: np.ndarray, dims: int, bits: int, seed: int) -> np.ndarray:
    """One key for each vector (rows) and curve."""
    out = np.empty((len(v), len(grids)), np.int64)
    side = 1 << (bits - 1)
    for c, (x, shift) in enumerate(_coordinates(v, len(grids), dims, seed)):
        # Three standard deviations either side span the grid, had a coordinate a normal distribution; the shift moves it by up to two cells.
        unit = np.stack([np.interp(x[:, j], grids[c, :, j], POINTS) for j in range(x.shape[1])], 1) / 6 + 0.5
        cells = np.floor(np.clip(unit, 0, 1 - 1e-9) * (side - 1 if side > 1 else 1) * 2 + 2 * shift)
        out[:, c] = hilbert(np.clip(cells, 0, 2 * side - 1).astype(np.int64), bits)
    return out


def _log_norm(v: str) -> Column:
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.log(top) + F.log(F.aggregate(F.transform(v, lambda x: x / top), F.lit(0.0), lambda a, x: a + x * x)) / 2


def bands(cls: DataFrame, least: int) -> tuple[list[tuple[int, int]], float]:
    """The first step of norms (from the longest down) and the number of classes of each band, and the longest norm's logarithm. A band that has no more than `least` classes goes on."""
    top, low = cls.agg(F.max(_log_norm("v")), F.min(_log_norm("v"))).first()
    if top is None:
        return [], 0.0
    width = max(np.log(RATIO), (top - low) / BANDS) / STEP
    out: list[tuple[int, int]] = []
    for r in cls.groupBy(_step(top).alias("step")).agg(F.count("*").alias("n")).orderBy("step").collect():
        if out and (r["step"] - out[-1][0] < width or out[-1][1] <= least):
            out[-1] = (out[-1][0], out[-1][1] + r["n"])
        else:
            out.append((r["step"], r["n"]))
    return out, top


def _step(top: float) -> Column:
    return F.floor((F.lit(top) - _log_norm("v")) / STEP).cast("long")


def ranked(cls: DataFrame, asking: DataFrame, found: list[tuple[int, int]], top: float, curves: int, dims: int, bits: int, seed: int) -> DataFrame:
    """(band, curve, rank, cid, asks, asked): the classes, and each one of asking (cid, v) in every band, where its rank is that of the first class not before it; asked: how many that ask stand before."""
    spark = cls.sparkSession
    small_batches(spark, 4096)
    total = sum(n for _, n in found)
    picked = cls.where(hashed_share("cid", SAMPLE, total)).orderBy(F.xxhash64(F.lit("grid"), "cid"), "cid").limit(SAMPLE).select("v").collect()
    grids = _grids(np.array([r["v"] for r in picked or cls.limit(1).select("v").collect()]), curves, dims, seed)

    @F.pandas_udf("array<long>")
    def keys(v: pd.Series) -> pd.Series:
        return pd.Series(list(_keys(np.vstack(v.to_numpy()), grids, dims, bits, seed))) if len(v) else pd.Series([], dtype=object)

    starts = F.array(*[F.lit(first) for first, _ in found]).cast("array<long>")
    own = F.size(F.filter(starts, lambda x: x <= F.col("step"))) - 1
    members = cls.withColumn("step", _step(top)).select("cid", "v", F.array(own).alias("at"), F.lit(False).alias("asks"))
    both = members.unionByName(asking.select("cid", "v", F.sequence(F.lit(0), F.lit(len(found) - 1)).alias("at"), F.lit(True).alias("asks")))
    # Written, as a range-partitioned sort reads its input twice. Vectors stay behind.
    keyed = cut(both.select("cid", "at", "asks", keys("v").alias("keys")), "keys")
    placed = keyed.select("cid", "at", "asks", F.posexplode("keys").alias("curve", "key"))
    placed = placed.select(F.explode("at").alias("band"), "curve", "key", F.xxhash64("curve", "cid").alias("tie"), "cid", (~F.col("asks")).alias("member"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, asked, own = 0, 0, TaskContext.get().partitionId()
        for b in batches:
            b = b.drop(columns=["key", "tie"])
            member = b["member"].to_numpy().astype(np.int64)
            upto, so_far = at + member.cumsum(), asked + (1 - member).cumsum()
            b["part"], b["place"], b["asked"] = own, upto - member, so_far - (1 - member)
            at, asked = (int(upto[-1]), int(so_far[-1])) if len(b) else (at, asked)
            yield b

    # Written, so that places and counts come from one and the same sort. A class that asks stands right before itself.
    order = ["band", "curve", "key", "tie", "cid", "member"]
    ordered = cut(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(number, "band int, curve int, cid long, member boolean, part int, place long, asked long"), "curves")
    dropped(keyed)
    sums = ordered.groupBy("part").agg(F.sum(F.col("member").cast("long")).alias("n"), F.sum((~F.col("member")).cast("long")).alias("q"))
    rows, upto, asked = [], 0, 0
    for r in sorted(sums.collect()):
        rows.append((r["part"], upto, asked))
        upto, asked = upto + r["n"], asked + r["q"]
    offsets = spark.createDataFrame(rows, "part int, before long, before_asked long")  # a row for each partition
    # Every curve of a band has all its classes and all that ask, so the global place less the bands and curves before is the rank.
    firsts = F.array(*[F.lit(curves * sum(n for _, n in found[:i])) for i in range(len(found))]).cast("array<long>")
    sizes = F.array(*[F.lit(n) for _, n in found]).cast("array<long>")
    rank = F.col("before") + F.col("place") - F.get(firsts, "band") - F.col("curve") * F.get(sizes, "band")
    number_asked = F.col("before_asked") + F.col("asked") - (F.col("band") * curves + F.col("curve")) * F.lit(asked // (curves * len(found)))
    return ordered.join(F.broadcast(offsets), "part").select("band", "curve", rank.alias("rank"), "cid", (~F.col("member")).alias("asks"), number_asked.alias("asked"))


def _inner(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, component after component in one order, so that a pair has one score wherever it is made."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += y[:, j] * x[:, j]
    return out


def _best(y: np.ndarray, x: np.ndarray, cid: np.ndarray, k: int, allowed=None, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of y its k best of x: places in y, cids and scores; ties go to the smaller cid. allowed(first, last): which pairs count."""
    long = np.sqrt((x * x).sum(1)).max() if len(x) else 0.0
    for first in range(0, len(y), rows):
        part = y[first : first + rows]
        s = part @ x.T
        if allowed is not None:
            s[~allowed(first, first + len(part))] = -np.inf
        low = np.full(len(part), -np.inf)
        if s.shape[1] > k:
            low = -np.partition(-s, k - 1, axis=1)[:, k - 1]
            # Sums in another order may differ in their last digits: whatever could be as good is compared exactly.
            low = low - 1e-13 * x.shape[1] * long * np.sqrt((part * part).sum(1))
        row, col = np.nonzero((s >= low[:, None]) & ~np.isneginf(s))
        exact = np.concatenate([_inner(part[row[i : i + 65536]], x[col[i : i + 65536]]) for i in range(0, len(row), 65536)]) if len(row) else np.zeros(0)
        order = np.lexsort((cid[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        begin = np.searchsorted(row, np.arange(len(part)))
        few = np.arange(len(row)) - begin[row] < k
        yield row[few] + first, cid[col[few]], exact[few]


def measured_window(cls: DataFrame, asking: DataFrame, ranks: DataFrame, found: list[tuple[int, int]], k: int, curves: int, recall: float, sampled: int = SAMPLED) -> float:
    """The share of a band's ranks within which `recall` of the k nearest classes of sampled queries stand on some curve."""
    n = asking.count()
    rows = asking.where(hashed_share("cid", sampled, n)).orderBy(F.xxhash64(F.lit("window"), "cid"), "cid").limit(sampled).select("cid", "v").collect()
    q, y = np.array([r["cid"] for r in rows]), np.array([r["v"] for r in rows], float)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                for at, cid, score in _best(y, np.vstack(b["v"].to_numpy()).astype(float), b["cid"].to_numpy(), k + 1):
                    yield pd.DataFrame({"q": q[at], "cid": cid, "score": score})

    by_query = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    near = cls.select("cid", "v").mapInPandas(compare, "q long, cid long, score double").withColumn("n", F.row_number().over(by_query)).where((F.col("n") <= k + 1) & (F.col("q") != F.col("cid")))
    pairs = [(r["q"], r["cid"]) for r in near.select("q", "cid", "n").orderBy("q", "n").collect()]  # at most sampled * (k + 1)
    if not pairs:
        return 0.0
    named = cls.sparkSession.createDataFrame([(c,) for c in sorted({c for _, c in pairs} | set(q.tolist()))], "c__ long")
    at: dict[tuple[bool, int], list[tuple[int, int, int]]] = {}
    for r in ranks.join(F.broadcast(named), F.col("cid") == F.col("c__")).select("asks", "cid", "band", "curve", "rank").collect():
        at.setdefault((r["asks"], r["cid"]), []).append((r["band"], r["curve"], r["rank"]))
    need = []
    for a, c in pairs:
        mine = {(b, i): x for b, i, x in at[True, a]}
        need.append(min(abs(mine[b, i] - x) / found[b][1] for b, i, x in at[False, c]))
    return float(np.quantile(need, recall, method="higher"))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, window: float | None = None, recall: float = RECALL, block: int = BLOCK, tile: int = TILE, seed: int = 5
) -> DataFrame:
    """vectors: id, v. queries: id (of those). query_id, rank, vec_id, score of the k largest inner products found. window: a share of the classes; None measures it."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    cls = cut(classes(vectors, k + 1), "classes")
    asking = cut(vectors.join(queries.select("id").distinct(), "id", "left_semi").distinct().join(cls.select("v", "cid"), "v").select("id", "cid", "v"), "queries")
    found_bands, top = bands(cls, 2 * k)
    if not found_bands:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    askers = asking.select("cid", "v").distinct()
    ranks = ranked(cls, askers, found_bands, top, curves, dims, bits, seed)
    if window is None:
        window = measured_window(cls, askers, ranks, found_bands, k, curves, recall)
    reaches = F.array(*[F.lit(max(2 * k, int(np.ceil(window * n)))) for _, n in found_bands]).cast("array<long>")
    lasts = F.array(*[F.lit((n - 1) // block) for _, n in found_bands]).cast("array<long>")
    own = ranks.where("asks").withColumn("reach", F.get(reaches, "band")).withColumn("last", F.get(lasts, "band"))
    spread = F.sequence(F.greatest(F.lit(0), F.expr(f"(rank - reach) div {block}")), F.least(F.col("last"), F.expr(f"(rank + reach) div {block}")))
    own = own.select(F.col("band").alias("q_band"), F.col("curve").alias("q_curve"), F.explode(spread).alias("q_block"), F.expr(f"asked div {tile}").alias("q_tile"), F.col("rank").alias("q_rank"), "reach", F.col("cid").alias("q"))
    sent = own.join(askers.select(F.col("cid").alias("q__"), F.col("v").alias("q_v")), F.col("q") == F.col("q__")).drop("q__")
    # Ranks of a block are met by queries of neighbouring places, so by a run of tiles.
    tiles = own.groupBy(F.col("q_band").alias("b__"), F.col("q_curve").alias("c__"), F.col("q_block").alias("k__")).agg(F.min("q_tile").alias("lo"), F.max("q_tile").alias("hi"))
    here = ranks.where("not asks").withColumn("block", F.expr(f"rank div {block}")).join(tiles, (F.col("band") == F.col("b__")) & (F.col("curve") == F.col("c__")) & (F.col("block") == F.col("k__")))
    here = here.select("band", "curve", "block", F.explode(F.sequence("lo", "hi")).alias("tile"), "rank", F.col("cid").alias("c__"))
    exact = cls.where(F.exists("v", lambda x: x != x.cast("float").cast("double"))).limit(1).count() == 0
    members = cls.select("cid", F.col("v").cast("array<float>" if exact else "array<double>").alias("v"))
    here = here.join(members, F.col("c__") == F.col("cid")).drop("c__")

    def search(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": [], "cid": [], "score": []}).astype({"q": "int64", "cid": "int64"})
        if not len(q) or not len(c):
            return none
        x, rank, cid = np.vstack(c["v"].to_numpy()).astype(float), c["rank"].to_numpy(), c["cid"].to_numpy()
        y, at, reach = np.vstack(q["q_v"].to_numpy()).astype(float), q["q_rank"].to_numpy(), q["reach"].to_numpy()
        inside = lambda i, j: np.abs(at[i:j, None] - rank[None, :]) <= reach[i:j, None]
        ids = q["q"].to_numpy()
        return pd.concat([none, *(pd.DataFrame({"q": ids[row], "cid": got, "score": score}) for row, got, score in _best(y, x, cid, k + 1, inside) if len(row))])

    found = sent.groupBy("q_band", "q_curve", "q_block", "q_tile").cogroup(here.groupBy("band", "curve", "block", "tile")).applyInPandas(search, "q long, cid long, score double")
    by_query = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    best = found.distinct().withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= k + 1).select("q", "cid", "score")
    # Classes become ids again; the query itself is none of its neighbours.
    named = best.join(cls.select("cid", "ids"), "cid").select("q", F.explode("ids").alias("vec_id"), "score")
    few = named.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    asked = asking.drop("v").join(few, F.col("cid") == few["q"]).where(F.col("id") != F.col("vec_id"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    return asked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut(usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return nearest(vectors, vectors.where(F.col("id") % 20 == 0))
