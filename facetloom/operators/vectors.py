"""Vector sets: facet vs (key, id, name, v array<double>). Exact nearest neighbours by column functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.operators import keyed
from facetloom.operators.zsets import by_lex
from facetloom.shipping import ship


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Larger is nearer: cosine, ip (inner product), or l2 as 1 / (1 + distance)."""
    if metric == "ip":
        return dot(a, b)
    if metric == "l2":
        return 1.0 / (1.0 + F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)))
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def normalised(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def vadd(vs: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by key and name; vectors of another length than their key's raise an error."""
    both = keyed.upsert(vs, new, ["key", "name"])
    size = vs.groupBy("key").agg(F.min(F.size("v")).alias("size__"))
    checked = F.when(F.col("size__").isNotNull() & (F.size("v") != F.col("size__")), F.raise_error(F.lit("another dimension than the set has")).cast("array<double>")).otherwise(F.col("v"))
    return both.join(size, "key", "left").withColumn("v", checked).select(*vs.columns)


def search(vs: DataFrame, query: list[float], k: int, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k nearest to a vector, filtered before, not after; a top-k, no full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    df = vs if where is None else vs.where(where)
    return df.withColumn("score", similarity(F.col("v"), q, metric)).orderBy(F.desc("score"), F.asc("id")).limit(k)


def _scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return 1 / (1 + np.sqrt(np.maximum((q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (q @ c.T), 0)))
    if metric == "ip":
        return q @ c.T
    lengths = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((c * c).sum(1))[None, :]
    return np.divide(q @ c.T, lengths, out=np.zeros(lengths.shape), where=lengths > 0)


def by_element(vs: DataFrame, asks: DataFrame, k: int, metric: str = "cosine", same_key: bool = True, rows: int = 4096) -> DataFrame:
    """For each of asks (id) its k nearest others, of its key or of all: query, id, score. A stated query set against all rows.

    Vectors and queries of a key (or all) are dealt by hash into parts of about `rows`, their number from their count; each pair of parts is scored at once by numpy and gives the
    k best of each query, which one more aggregate merges. No task holds more than two parts, whatever the size of a key.
    """
    ship(vs.sparkSession)
    scope = F.col("key") if same_key else F.lit("")
    base = vs.select(scope.alias("g"), "id", "v")
    q = vs.join(asks.select(F.col("id").alias("a__")).distinct(), F.col("id") == F.col("a__"), "left_semi").select(scope.alias("q_g"), F.col("id").alias("query"), F.col("v").alias("q_v"))
    parts = base.groupBy(F.col("g").alias("p_g")).agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    tiles = q.groupBy(F.col("q_g").alias("t_g")).agg(F.ceil(F.count("*") / rows).cast("int").alias("tiles"))
    many = parts.join(tiles, F.col("p_g").eqNullSafe(F.col("t_g")))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    there = base.join(many, F.col("g").eqNullSafe(F.col("p_g"))).select("g", dealt("id", "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "id", "v")
    asked = q.join(many, F.col("q_g").eqNullSafe(F.col("p_g"))).select("q_g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q_part"), dealt("query", "tiles").alias("q_tile"), "query", "q_v")

    def nearest(key, a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": a["query"][:0], "id": c["id"][:0], "score": np.zeros(0)})]
        if len(a) and len(c):
            ids, x = c["id"].to_numpy(), np.vstack(c["v"].to_numpy()).astype(float)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            for first in range(0, len(a), 512):
                some = a.iloc[first : first + 512]
                s = _scores(np.vstack(some["q_v"].to_numpy()).astype(float), x, metric)
                s[some["query"].to_numpy()[:, None] == ids[None, :]] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]  # of equal scores the smaller id, as ids are in order
                own = np.repeat(some["query"].to_numpy(), best.shape[1])
                score = np.take_along_axis(s, best, 1).ravel()
                out.append(pd.DataFrame({"query": own, "id": ids[best.ravel()], "score": score})[~np.isneginf(score)])
        return pd.concat(out)

    kind = dict(vs.dtypes)["id"]
    found = asked.groupBy("q_g", "q_part", "q_tile").cogroup(there.groupBy("g", "part", "tile")).applyInPandas(nearest, f"query {kind}, id {kind}, score double")
    return keyed.first_n(found, ["query"], k, F.desc("score"), F.asc("id"))


def vrange(vs: DataFrame, low: str, high: str, count: int | None = None) -> DataFrame:
    """Names between two bounds in order."""
    df = by_lex(vs.withColumn("member", F.col("name")), low, high).drop("member")
    return df if count is None else keyed.first_n(df, ["key"], count, F.asc("name"))


def vemb(vs: DataFrame, names: list[str]) -> DataFrame:
    """key, name, v of some elements."""
    return vs.where(F.col("name").isin(*names)).select("key", "name", "v")


def vismember(vs: DataFrame, key: str, names: list[str]) -> DataFrame:
    """place, name, found in argument order."""
    args = keyed.arguments(vs.sparkSession, names, "name")
    mine = vs.where((F.col("key") == key) & F.col("name").isin(*names)).select("name", F.lit(True).alias("found")).distinct()
    return args.join(mine, "name", "left").select("place", "name", F.coalesce("found", F.lit(False)).alias("found"))


def vinfo(vs: DataFrame) -> DataFrame:
    return vs.groupBy("key").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"))


def vrem(vs: DataFrame, names: DataFrame) -> DataFrame:
    return keyed.delete(vs, names, ["key", "name"])


def vrandmember(vs: DataFrame, n: int, seed: int) -> DataFrame:
    return keyed.random_n(vs, ["key"], n, seed, "name")


def setattr_(vs: DataFrame, attr: str, value: Column) -> DataFrame:
    """vs has a map column attrs."""
    return vs.withColumn("attrs", F.map_concat(F.map_filter("attrs", lambda k, _: k != attr), F.create_map(F.lit(attr), value)))


def getattr_(attr: str) -> Column:
    return F.col("attrs")[attr]


def links(vs: DataFrame, asks: DataFrame, k: int = 16, metric: str = "cosine") -> DataFrame:
    """A graph's edges from each of asks to its k nearest of the same key."""
    return by_element(vs, asks, k, metric)
