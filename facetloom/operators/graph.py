"""Property graph: nodes (id, label, properties...) and edges (src, dst, rel). Traversals are loops of joins over a frontier; each
round is written, so that lineage stays short and a lost executor costs one round."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.operators import keyed
from facetloom.sources.shared import cut


def by_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.col("label") == label)


def match(nodes: DataFrame, label: str | None = None, properties: dict[str, object] | None = None) -> DataFrame:
    df = nodes if label is None else by_label(nodes, label)
    for k, v in (properties or {}).items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def neighbours(edges: DataFrame, direction: str = "out", rel: str | None = None) -> DataFrame:
    """id, neighbour: parallel edges repeat a neighbour."""
    e = edges if rel is None else edges.where(F.col("rel") == rel)
    out, in_ = e.select(F.col("src").alias("id"), F.col("dst").alias("neighbour")), e.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"))
    return {"out": out, "in": in_}[direction] if direction != "both" else out.unionByName(in_)


def create_nodes(nodes: DataFrame, delta: DataFrame) -> DataFrame:
    """With new nodes; those of an id that is there are replaced."""
    return keyed.upsert(nodes, delta, ["id"])


def create_edges(nodes: DataFrame, edges: DataFrame, delta: DataFrame) -> DataFrame:
    """With the new edges whose ends are both there."""
    ids = nodes.select(F.col("id").alias("g__")).distinct()
    new = delta.join(ids, F.col("src") == F.col("g__"), "left_semi").join(ids, F.col("dst") == F.col("g__"), "left_semi")
    return edges.unionByName(new.select(*edges.columns))


def shortest_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """start, id, hops, path of every node that starts (id) reach along edges, or of targets (id) only; the path of smallest ids where several are shortest. most: hops; None goes on until nothing new is reached.

    Breadth first for all starts at once: a round joins the frontier with the edges, keeps one path a node and drops what was seen.
    """
    links = edges.select(F.col("src").alias("s__"), F.col("dst").alias("d__")).distinct()
    frontier = cut(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops"), F.array("id").alias("path")).distinct())
    seen, rounds = frontier, [frontier]
    for hop in itertools.count(1) if most is None else range(1, most + 1):
        step = frontier.join(links, F.col("id") == F.col("s__")).select("start", F.col("d__").alias("id"), F.array_append("path", F.col("d__")).alias("path"))
        new = step.groupBy("start", "id").agg(F.min("path").alias("path")).join(seen.select("start", "id"), ["start", "id"], "left_anti")
        frontier = cut(new.select("start", "id", F.lit(hop).alias("hops"), "path"))
        if not frontier.limit(1).count():
            break
        rounds.append(frontier)
        seen = seen.unionByName(frontier)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out if targets is None else out.join(targets.select("id").distinct(), "id", "left_semi")


def all_paths(edges: DataFrame, start: str, target: str, max_nodes: int) -> DataFrame:
    """path: all simple paths of at most max_nodes nodes."""
    links = edges.select(F.col("src").alias("s__"), F.col("dst").alias("d__"))
    paths = edges.sparkSession.createDataFrame([(start, [start])], "id string, path array<string>")
    done = None
    for _ in range(max_nodes - 1):
        paths = cut(paths.join(links, F.col("id") == F.col("s__")).where(~F.array_contains("path", F.col("d__"))).select(F.col("d__").alias("id"), F.array_append("path", F.col("d__")).alias("path")))
        hits = paths.where(F.col("id") == target).select("path")
        done = hits if done is None else done.unionByName(hits)
        paths = paths.where(F.col("id") != target)
    return done


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Without nodes that a condition holds for, and without their edges."""
    ids = nodes.where(gone).select(F.col("id").alias("g__"))
    left = edges.join(ids, F.col("src") == F.col("g__"), "left_anti").join(ids, F.col("dst") == F.col("g__"), "left_anti")
    return nodes.where(~F.coalesce(gone, F.lit(False))), left


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (label or relationship), name, n."""
    a = nodes.groupBy(F.lit("label").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.lit("relationship").alias("kind"), F.col("rel").alias("name")).agg(F.count("*").alias("n")))
