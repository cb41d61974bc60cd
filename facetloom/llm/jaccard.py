"""Exact n-gram Jaccard join as a metric-space join: documents whose shingle sets link, and the groups that links make.

Jaccard's distance d = 1 - J is a metric, and two sets link if d <= e, with e = 1 - threshold. A document far from everything has distance 1 to any
document chosen as a pivot, so that balls around documents alone would keep all of a corpus in one region. The first pivots are therefore
one-shingle sets, which tell such documents apart:

1. Equal sets become one node (distance 0).
2. Of a fixed part of all shingles, those that only one node has are counted for each node. A node with more than e of its
   size lies further than e from every other one and leaves, as |X - Y| <= e|X| whenever d(X, Y) <= e. The nodes left are counted again over all their shingles.
3. Voronoi regions of the one-shingle pivots: a node is at distance 1 - 1/|X| from the pivots that it contains and at 1 from all others; ties go
   to the rarest. A node that is within e of another one shares with it one of its floor(e|X|) + 1 rarest shingles (at most e|X| of its shingles
   are not the other's), so it is replicated to those regions and no further. That window is exact. Overlapping regions join to larger ones.
4. Regions are joined recursively, with documents as pivots, in one of two ways. A region that fits a task: the ball of a pivot is linked to it; a node y
   outside can link to a node x inside only if d(y, p) <= 2e and |d(x, p) - d(y, p)| <= e, and those windows are all that is compared; what lies outside
   the ball goes on with a pivot of its own.
   A larger region is divided by PIVOTS pivots over the cluster: a node's home is the Voronoi region of its nearest pivot, at distance m. If d(x, y) <= e and m(x) <= NEAR, then
   y is at most m(x) + e from x's home p, so that d(y, p) <= min(m(y) + 2e, NEAR + e): a node is replicated to all regions within that window. Links of nodes
   with m(x) > NEAR are looked for among all nodes with m > NEAR - e, a region of its own. Each of these regions is joined recursively in its turn.
5. A region that pivots do not divide (its parts together have over GROWTH times its nodes, or one has over SHRINK of them: its nodes are all about as far from each other)
   is cut by the ball of its most central node, and what remains is compared block by block, blocks
   being ordered by set size, another window: sizes of linked sets differ by no more than the threshold. Each pair of blocks is a task.

Links inside one group that is known to be connected are not looked for, as only the groups are asked. All comparisons are of whole numbers.

Defined results: null texts and texts without words have no shingles and are groups of their own; fewer words than a shingle are one shingle; repeated
rows and equal texts are in one group; a group's id is its smallest non-null doc_id (null if it has none); an empty table gives no rows.
Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetloom.llm.common import columns, cut, dropped, free_name, small_batches, table
from facetloom.llm.wordhash import rolled, word_hashes

#: Nodes times shingles that one task may compare.
TASK = 200_000_000
#: Up to so many ids are sent to all executors; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
BROADCAST_LABELS = 500_000
SALT = 64
#: Pivots of one division, the distance up to which a node has a home, and when a region counts as not divided.
PIVOTS, NEAR, GROWTH, SHRINK = 16, 0.5, 2.0, 0.8
#: Shingles that one task compares with the pivots.
PART = 4_000_000


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of all k words in a row."""
    return np.unique(rolled(word_hashes(text, lower=True), k))


def _sid(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sets(docs: DataFrame, k: int, part: float) -> DataFrame:
    """doc_id, th (a hash of the text), n (size of the set), sid, some: the set's shingles within the first `part` of all hashes."""
    small_batches(docs.sparkSession)
    below = np.uint64(min(int(part * 2.0**64), (1 << 64) - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [shingles(t, k) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "th": b["th"], "n": [len(s) for s in own], "sid": [_sid(s) for s in own], "some": pd.Series([s[: np.searchsorted(s, below)].view(np.int64) for s in own], dtype=object)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")).mapInPandas(run, "doc_id long, th long, n long, sid long, some array<long>")


def _alone(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (sid, h): by h the number of nodes that have it; by node how many shingles no other has."""
    cells = rows.groupBy("h").agg(F.count("*").alias("df"), F.min("sid").alias("sid"))
    return cells.select("h", "df"), cells.where("df = 1").groupBy("sid").agg(F.count("*").alias("alone"))


def _near(nodes: DataFrame, alone: DataFrame, percent: int) -> DataFrame:
    """The nodes of which at most 100 - percent in a hundred shingles are theirs alone."""
    a = alone.withColumnRenamed("sid", "sid__")
    return nodes.join(a, nodes["sid"] == a["sid__"], "left").where(100 * F.coalesce("alone", F.lit(0)) <= (100 - percent) * F.col("n")).drop("sid__", "alone")


def candidates(hashed: DataFrame, slim: DataFrame, percent: int) -> DataFrame:
    """Step 2 over part of the shingles: sid, n, rep (a document that has the set). hashed: sid, some; slim: doc_id, n, sid.

    Documents with equal sets need not be brought together for it: a shingle is one node's alone if the smallest and the largest sid that have it are the same.
    """
    cells = hashed.select("sid", F.explode("some").alias("h")).groupBy("h").agg(F.min("sid").alias("sid"), F.max("sid").alias("high"))
    alone = cells.where("sid = high").groupBy("sid").agg(F.count("*").alias("alone"))
    nodes = slim.where("n > 0").groupBy("sid").agg(F.min("n").alias("n"), F.min("doc_id").alias("rep"))
    return cut(_near(nodes, alone, percent), "candidates")


def whole_sets(docs: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """sid, n, s (all shingles) of the chosen nodes, from the texts of their documents."""
    small_batches(docs.sparkSession)
    ids = chosen.select(F.col("rep").alias("rep__")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(F.col("rep__")), "left_semi").select("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [s for t in b["text"] if len(s := shingles(t, k))]
            yield pd.DataFrame({"sid": [_sid(s) for s in own], "n": [len(s) for s in own], "s": pd.Series([s.view(np.int64) for s in own], dtype=object)})

    got = texts.mapInPandas(run, "sid long, n long, s array<long>")
    # A document repeated under one id, or another text of that id: each node once, and only chosen ones.
    return cut(got.groupBy("sid").agg(F.first("n").alias("n"), F.first("s").alias("s")).join(chosen.select("sid"), "sid", "left_semi"), "whole")


def cells(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Steps 2 and 3: (h, sid) of the nodes in the windows of the one-shingle pivots; and how central each node is."""
    rows = nodes.select("sid", F.explode("s").alias("h"))
    df, alone = _alone(rows)
    kept = cut(nodes.select("sid", "n").join(alone, "sid", "left").where(100 * F.coalesce("alone", F.lit(0)) <= (100 - percent) * F.col("n")).select("sid", "n", F.coalesce("alone", F.lit(0)).alias("alone")), "kept")
    many = df.where("df > 1")
    shared = rows.join(many, "h").join(kept.withColumnRenamed("sid", "sid__"), F.col("sid") == F.col("sid__"))
    # A node's shingles in order of rarity; one array a node, never longer than its set. Those it has alone come first and need no region.
    ordered = shared.groupBy("sid").agg(F.first("n").alias("n"), F.first("alone").alias("alone"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("o"), F.avg("df").alias("central"))
    window = F.greatest(F.floor((100 - percent) * F.col("n") / 100) + 1 - F.col("alone"), F.lit(0)).cast("int")
    ordered = cut(ordered.select("sid", "central", F.slice("o", F.lit(1), window).alias("o")), "windows")
    return ordered.select("sid", F.explode("o.h").alias("h")), ordered.select("sid", "central")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """v, root: the smallest node that edges (a, b) lead to, by minimum labels and pointer jumping; each round is written, none reads the lineage before.

    Labels of up to BROADCAST_LABELS nodes are sent to all executors in each round; beyond, they are joined by a shuffle.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    few = labels.count() <= BROADCAST_LABELS
    for _ in range(most):
        known = labels.select(F.col("v").alias("b__"), F.col("root").alias("low"))
        up = labels.select(F.col("v").alias("v2"), F.col("root").alias("root2"))
        if few:
            known, up = F.broadcast(known), F.broadcast(up)
        # A node's own label counts among its neighbours', so that one aggregate finds the new one.
        near = both.join(known, F.col("b") == F.col("b__")).select(F.col("a").alias("v"), "low", F.lit(None).cast("long").alias("old"))
        seen = near.unionByName(labels.select("v", F.col("root").alias("low"), F.col("root").alias("old"))).groupBy("v").agg(F.min("low").alias("new"), F.max("old").alias("old"))
        next_ = cut(seen.join(up, F.col("new") == F.col("v2")).select("v", "old", F.least("new", "root2").alias("root")), "labels")
        changed = next_.where("old <> root").limit(1).count()
        dropped(labels)
        labels = next_.select("v", "root")
        if not changed:
            return labels
    raise RuntimeError(f"links did not settle in {most} rounds")  # pointer jumping halves paths: 60 rounds are enough for any number of nodes that has 60 bits


class _Groups:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def join_region(own: list[np.ndarray], percent: int, known: list[int] | None = None, leaf: int = 24) -> list[int]:
    """Step 4: the group of each set, as the place of its first member. Sets with equal known numbers (not negative) are connected already."""
    m = len(own)
    groups = _Groups(m)
    first: dict[int, int] = {}
    for i, g in enumerate(known or []):
        if g >= 0:
            groups.join(first.setdefault(g, i), i)
    size = np.array([len(s) for s in own], np.int64)
    flat = np.unique(np.concatenate(own), return_inverse=True)[1] if m else np.zeros(0, np.int64)
    begin = np.r_[0, np.cumsum(size)]
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)

    def overlap(p: int, some: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set p with some others."""
        mine = flat[begin[p] : begin[p + 1]]
        mark[mine] = True
        take = np.repeat(begin[some] - np.r_[0, np.cumsum(size[some])[:-1]], size[some]) + np.arange(size[some].sum())
        out = np.add.reduceat(mark[flat[take]].astype(np.int64), np.r_[0, np.cumsum(size[some])[:-1]]) if len(some) else np.zeros(0, np.int64)
        mark[mine] = False
        return out

    def linked(p: int, some: np.ndarray, common: np.ndarray) -> np.ndarray:
        return 100 * common >= percent * (size[p] + size[some] - common)

    e = (100 - percent) / 100 + 1e-9
    rest = np.arange(m)
    while len(rest) > 1:
        roots = np.array([groups.find(i) for i in rest])
        if (roots == roots[0]).all():
            break
        p, others = int(rest[0]), rest[1:]
        common = overlap(p, others)
        ball = linked(p, others, common)
        for i in others[ball]:
            groups.join(p, int(i))
        d = 1 - common / (size[p] + size[others] - common)
        if len(rest) > leaf:
            inside, dx = others[ball], d[ball]
            for y, dy in zip(others[~ball & (d <= 2 * e)], d[~ball & (d <= 2 * e)], strict=True):
                if groups.find(int(y)) == groups.find(p):
                    continue
                x = inside[(dx >= dy - e) & (100 * np.minimum(size[inside], size[y]) >= percent * np.maximum(size[inside], size[y]))]
                if len(x) and linked(int(y), x, overlap(int(y), x)).any():
                    groups.join(p, int(y))
            rest = others[~ball]
        else:
            rest = others
    return [groups.find(i) for i in range(m)]


def _joined(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["central", "sid"], ascending=[False, True], kind="stable")
        own = [np.asarray(s, np.int64) for s in pdf["s"]]
        sid = pdf["sid"].to_numpy()
        root = join_region(own, percent, list(pdf["known"]))
        return pd.DataFrame({"a": sid, "b": sid[root]})

    return run


EDGE = "a long, b long"


def connected(nodes: DataFrame, regions: DataFrame, central: DataFrame, percent: int, task: int = TASK) -> DataFrame:
    """Steps 4 and 5: v, root of the nodes with links; nodes: sid, n, s; regions: v, root. All links of a node lie in its region, so what one task finds of a whole region is final."""
    spark = nodes.sparkSession
    small_batches(spark)
    placed = nodes.join(regions, F.col("sid") == F.col("v")).join(central.withColumnRenamed("sid", "sid__"), F.col("sid") == F.col("sid__"), "left")
    placed = cut(placed.select(F.col("root").alias("region"), "sid", "n", "s", F.coalesce("central", F.lit(0.0)).alias("central"), F.lit(-1).alias("known")), "placed")
    size = placed.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.max(F.struct("central", "sid")).alias("p"))
    size = cut(size.select(F.col("region").alias("r__"), "m", "total", F.col("p.sid").alias("pivot")), "regions")  # pivot: the most central node
    large = size.where(_work() > task)
    n = large.limit(BROADCAST_LABELS + 1).count()
    if not n:
        return placed.groupBy("region").applyInPandas(_joined(percent), EDGE).select(F.col("a").alias("v"), F.col("b").alias("root"))
    # So that no large region's rows meet in one task to be told from small ones, its number is sent where that list is short.
    large = F.broadcast(large) if n <= BROADCAST_LABELS else large
    small = placed.join(large.select("r__"), F.col("region") == F.col("r__"), "left_anti")
    out = small.groupBy("region").applyInPandas(_joined(percent), EDGE).select(F.col("a").alias("v"), F.col("b").alias("root"))
    return out.unionByName(components(cut(_divided(placed, large, percent, task), "links")))


def _work() -> Column:
    return F.col("m").cast("double") * F.col("total")


def _nearest(percent: int):
    """Of the nodes of a part of a region and its pivots: a row for each region that a node belongs to. pivot: null where it is the one of nodes far from all."""
    e = (100 - percent) / 100 + 1e-9

    def run(key, nodes: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        size = nodes["n"].to_numpy()
        flat = np.concatenate([np.asarray(x, np.int64) for x in nodes["s"]]) if len(nodes) else np.zeros(0, np.int64)
        begin = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
        d, ball = np.ones((len(nodes), len(pivots))), np.zeros((len(nodes), len(pivots)), bool)
        for j, ps in enumerate(pivots["s"] if len(nodes) else []):
            own = np.sort(np.asarray(ps, np.int64))
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            common = np.add.reduceat((own[at] == flat).astype(np.int64), begin)
            union = size + len(own) - common
            d[:, j], ball[:, j] = 1 - common / union, 100 * common >= percent * union
        least = d.min(1) if len(pivots) else np.ones(len(nodes))
        inside = ball | (d <= np.minimum(least + 2 * e, NEAR + e)[:, None])
        far = least > NEAR - e
        row, col = np.nonzero(np.c_[inside, far])
        home = np.r_[pivots["sid"].to_numpy(np.int64), 0][col]
        out = nodes.iloc[row][["region", "sid", "n", "s", "central"]].reset_index(drop=True)
        last = col == len(pivots)
        out["pivot"] = pd.Series(home, dtype="Int64").mask(last)
        out["ball"] = np.where(last, False, np.c_[ball, np.zeros(len(nodes), bool)][row, col])
        return out

    return run


def _divided(placed: DataFrame, large: DataFrame, percent: int, task: int) -> DataFrame:
    """Steps 4 and 5 for regions (r__, m, total, pivot) that no task can join: links (a, b) that connect their groups. Each round is written."""
    found, rounds = [], 0
    columns = ["region", "sid", "n", "s", "central"]
    schema = "region long, sid long, n long, s array<long>, central double, pivot long, ball boolean"
    while True:
        rounds += 1
        at = placed.join(F.broadcast(large) if large.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS else large, F.col("region") == F.col("r__"))
        parts = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(PART))).cast("int")
        at = cut(at.select(*columns, parts.alias("parts"), F.pmod(F.xxhash64("sid"), parts).cast("int").alias("part")), "divided")
        # As pivots the first by a hash, another one each round; the limit stands below the shuffle.
        order = Window.partitionBy("region").orderBy(F.xxhash64(F.lit(rounds), "sid"), "sid")
        pivots = at.withColumn("n__", F.row_number().over(order)).where(F.col("n__") <= PIVOTS).select("region", "sid", "s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        children = cut(at.groupBy("region", "part").cogroup(pivots.groupBy("region", "part")).applyInPandas(_nearest(percent), schema), "children")
        found.append(children.where("ball").select(F.col("sid").alias("a"), F.col("pivot").alias("b")))
        size = children.groupBy("region", "pivot").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.max(F.struct("central", "sid")).alias("p"))
        own = Window.partitionBy("region")
        size = size.join(large.select(F.col("r__"), F.col("m").alias("before")), F.col("region") == F.col("r__")).withColumn("all", F.sum("m").over(own))
        # A region that its pivots leave whole, or spread over too many of their regions, is compared as it is; so is a part that stays too large.
        size = size.withColumn("whole", F.col("all") > GROWTH * F.col("before")).withColumn("child", F.xxhash64("region", "pivot"))
        size = cut(size.select("region", "pivot", "child", "m", "total", "before", "whole", F.col("p.sid").alias("central_sid")), "parts")
        whole = large.join(size.where("whole").select(F.col("region").alias("w__")).distinct(), F.col("r__") == F.col("w__"), "left_semi")
        if whole.limit(1).count():
            found.append(_large(at.select(*columns), whole, percent, task))
        kept = size.where("not whole and m > 1").select(F.col("region").alias("r__"), F.col("pivot").alias("p__"), "child", "m", "total", "before", "central_sid")
        named = children.join(kept, (F.col("region") == F.col("r__")) & F.col("pivot").eqNullSafe(F.col("p__")))
        fits = named.where(_work() <= task).select(F.col("child").alias("region"), "sid", "n", "s", "central", F.when(F.col("ball"), F.lit(0)).otherwise(F.lit(-1)).alias("known"))
        found.append(fits.groupBy("region").applyInPandas(_joined(percent), EDGE))
        # A part whose nodes all lie in its pivot's ball is joined already.
        open_ = kept.where(_work() > task).select(F.col("child").alias("r__"), "m", "total", F.col("central_sid").alias("pivot"), "before")
        loose = children.where("not ball").select(F.xxhash64("region", "pivot").alias("o__")).distinct()
        open_ = cut(open_.join(loose, F.col("r__") == F.col("o__"), "left_semi"), "open")
        over = named.where(_work() > task).select(F.col("child").alias("region"), "sid", "n", "s", "central")
        stuck = open_.where(F.col("m") > SHRINK * F.col("before")).drop("before")
        if stuck.limit(1).count():
            found.append(_large(over, stuck, percent, task))
        large = open_.where(F.col("m") <= SHRINK * F.col("before")).drop("before")
        if not large.limit(1).count():
            break
        placed = over
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _large(placed: DataFrame, size: DataFrame, percent: int, task: int) -> DataFrame:
    """Step 5: one ball for each large region, then pairs of blocks in order of set size."""
    at = placed.join(size, F.col("region") == F.col("r__"))
    # The pivot's set goes to each of SALT parts of its region.
    salt = F.pmod(F.xxhash64("sid"), F.lit(SALT)).cast("int")
    pivots = at.where("sid = pivot").select(F.col("region").alias("r2__"), F.col("s").alias("ps"), F.col("n").alias("pn"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt2__"))
    seen = at.withColumn("salt__", salt).join(pivots, (F.col("region") == F.col("r2__")) & (F.col("salt__") == F.col("salt2__"))).withColumn("common", F.size(F.array_intersect("s", "ps")))
    union = F.col("n") + F.col("pn") - F.col("common")
    seen = seen.withColumn("ball", 100 * F.col("common") >= percent * union).withColumn("far", 100 * (union - F.col("common")) > 2 * (100 - percent) * union)
    # Blocks of one side: as many nodes as give a quarter of what a task may compare in a pair.
    per = F.greatest(F.lit(1.0), F.sqrt(F.lit(task / 4.0) * F.col("m") / F.col("total")))
    # Places come from counts by size and from a hash within a size: no node order of a whole region is sorted in one task.
    seen = cut(seen.select("region", "sid", "n", "s", "central", "pivot", "ball", "far", "m", per.alias("per")), "seen")
    sizes = seen.groupBy("region", "ball", "n").agg(F.count("*").alias("c"), F.first("per").alias("per"))
    upto = F.sum("c").over(Window.partitionBy("region", "ball").orderBy("n"))
    sizes = sizes.select(F.col("region").alias("r__"), F.col("ball").alias("b__"), F.col("n").alias("n__"), (upto - F.col("c")).alias("from__"), F.col("c").alias("c__"))
    numbered = seen.join(sizes, (F.col("region") == F.col("r__")) & (F.col("ball") == F.col("b__")) & (F.col("n") == F.col("n__")))
    block = F.floor((F.col("from__") + F.pmod(F.xxhash64("sid"), F.col("c__"))) / F.col("per")).cast("int")
    numbered = cut(numbered.select("region", "sid", "n", "s", "central", "pivot", "ball", "far", block.alias("block")), "blocks")
    ends = numbered.groupBy("region", "ball", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("far").alias("all_far"))
    a, b = (ends.select(*(F.col(c).alias(f"{c}{i}") for c in ends.columns)) for i in (1, 2))
    fits = (F.col("region1") == F.col("region2")) & (100 * F.least("hi1", "hi2") >= percent * F.greatest("lo1", "lo2")) & ~F.col("ball1")
    # Outer blocks among themselves, and outer ones with those of the ball; the ball is connected.
    pairs = a.join(b, fits & ((F.col("ball2") & ~F.col("all_far1")) | (~F.col("ball2") & (F.col("block1") <= F.col("block2")))))
    pairs = pairs.select(F.col("region1").alias("r__"), F.struct("block1", "ball2", "block2").alias("pair"), "block1", "ball2", "block2")
    side = F.array(F.struct(F.lit(False).alias("ball"), F.col("block1").alias("block")), F.struct(F.col("ball2").alias("ball"), F.col("block2").alias("block")))
    sides = pairs.select("r__", "pair", F.explode(F.array_distinct(side)).alias("x")).select("r__", "pair", F.col("x.ball").alias("b__"), F.col("x.block").alias("k__"))
    sent = numbered.join(sides, (F.col("region") == F.col("r__")) & (F.col("ball") == F.col("b__")) & (F.col("block") == F.col("k__")))
    sent = sent.select("region", "pair", "sid", "s", "central", F.when(F.col("ball"), F.lit(0)).otherwise(F.lit(-1)).alias("known"))
    inner = numbered.where("ball").select(F.col("sid").alias("a"), F.col("pivot").alias("b"))
    return inner.unionByName(sent.groupBy("region", "pair").applyInPandas(_joined(percent), EDGE))


def groups(docs: DataFrame, k: int = 5, percent: int = 80, task: int = TASK) -> DataFrame:
    """One row for each of docs (doc_id, text): doc_id, n_shingles, component_id."""
    return _rows(docs, k, percent, task).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _rows(docs: DataFrame, k: int, percent: int, task: int = TASK) -> DataFrame:
    """One row for each of docs: doc_id, th, n, and of those with shingles root and component_id."""
    hashed = cut(sets(docs, k, min(1.0, 2 * (100 - percent) / 100)), "sets")
    sized = cut(hashed.select("doc_id", "th", "n", "sid"), "sized")
    chosen = candidates(hashed, sized, percent)
    dropped(hashed)
    nodes = whole_sets(docs, chosen, k)
    windows, central = cells(nodes, percent)
    roots = windows.groupBy("h").agg(F.min("sid").alias("a"), F.count("*").alias("c")).where("c > 1").select(F.col("h").alias("h__"), "a")
    stars = windows.join(roots, F.col("h") == F.col("h__")).select("a", F.col("sid").alias("b")).where("a <> b").distinct()
    regions = components(stars)
    found = cut(connected(nodes, regions, central, percent, task), "found")
    # A group's smallest id is found among the nodes that regions hold, and written: one row a group, sent to all where these are few, else joined to a table that AQE can split.
    # A node of no region is its own group.
    owners = sized.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("low")).join(found, F.col("sid") == F.col("v"), "left")
    lowest = cut(owners.where("v is not null").groupBy(F.col("root").alias("root__")).agg(F.min("low").alias("lowest")), "lowest")
    few = lowest.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    ids = owners.join(F.broadcast(lowest) if few else lowest, F.col("root") == F.col("root__"), "left")
    ids = ids.select(F.col("sid").alias("sid__"), F.coalesce("root", "sid").alias("root"), F.coalesce("lowest", "low").alias("component_id"))
    both = sized.join(ids, (F.col("sid") == F.col("sid__")) & (F.col("n") > 0), "left")
    return both.select("doc_id", "th", "n", "root", "component_id")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), 4, 85)


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, with its columns: the one with the smallest id, and of texts that share it the one with the smallest hash.

    It is decided by row, so that an id that is repeated with other texts loses only those that are copies. Null ids come last: a row of a null id stays only
    in a group that has no other. Of rows that repeat an id with one text, one stays. Documents without shingles stay.
    """
    found = cut(_rows(docs, 5, 80), "groups")
    first = found.where("n > 0").groupBy(F.col("root").alias("root__")).agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))).alias("own"), F.min(F.when(F.col("doc_id").isNull(), F.col("th"))).alias("nameless"), F.count("*").alias("c")
    )
    # Groups of one row lose nothing. The others, one row each, go to all where they are few, else into a join that AQE can split.
    first = cut(first.where("c > 1").drop("c"), "first")
    first = F.broadcast(first) if first.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS else first
    stays = F.when(F.col("doc_id").isNull(), F.col("own").isNull() & (F.col("th") == F.col("nameless"))).otherwise(F.struct("doc_id", "th") == F.col("own"))
    name, text_name = free_name(docs, "gone"), free_name(docs, "gone_text")
    gone = found.where("n > 0").join(first, F.col("root") == F.col("root__")).where(~stays).select(F.col("doc_id").alias(name), F.col("th").alias(text_name)).distinct()
    gone = cut(gone, "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    same = docs["doc_id"].eqNullSafe(F.col(name)) & (F.xxhash64(docs["text"]) == F.col(text_name))
    kept = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    again = found.groupBy(F.col("doc_id").alias(name), F.col("th").alias(text_name)).agg(F.count("*").alias("c"), F.max("n").alias("n")).where(f"c > 1 and (n > 0 or {name} is not null)")
    again = cut(again.select(name, text_name), "again")
    if not again.limit(1).count():
        return kept
    # Only rows that are repeated are compared, so that texts do not travel for the others.
    same = kept["doc_id"].eqNullSafe(F.col(name)) & (F.xxhash64(kept["text"]) == F.col(text_name))
    place = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text"), "text").orderBy("doc_id"))
    once = kept.join(again, same, "left_semi").withColumn(name, place).where(F.col(name) == 1).select(*columns(docs))
    return kept.join(again, same, "left_anti").unionByName(once)
