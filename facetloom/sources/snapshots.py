"""Snapshots of facets: Parquet by facet, JSON with one document for each key, and a log of commands."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetloom.functions.text import glob
from facetloom.operators.keyed import live
from facetloom.shipping import ship


def save(facets: dict[str, DataFrame], path: str) -> None:
    """One Parquet table a facet."""
    for name, df in facets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, names: list[str], now_ms: int | None = None, pattern: str = "*") -> dict[str, DataFrame]:
    """The facets, without what has expired and without keys that a glob leaves out."""
    now, out = int(time.time() * 1000) if now_ms is None else now_ms, {}
    for name in names:
        df = spark.read.parquet(f"{path}/{name}")
        df = live(df, now) if "expire_at" in df.columns else df
        out[name] = df.where(glob(F.col("key"), pattern)) if "key" in df.columns and pattern != "*" else df
    return out


def as_documents(facets: dict[str, DataFrame]) -> DataFrame:
    """key, type, value (JSON): strings as they are, lists and sets as arrays, hashes as objects, sorted sets as arrays of member and score."""
    out = None
    for name, df in facets.items():
        if name == "string":
            one = df.select("key", F.to_json(F.struct("value")).alias("value"))
        elif name == "list":
            one = df.groupBy("key").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "elem"))), lambda x: x["elem"])).alias("value"))
        elif name == "set":
            one = df.groupBy("key").agg(F.to_json(F.array_sort(F.collect_set("member"))).alias("value"))
        elif name == "zset":
            one = df.groupBy("key").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("score", "member"))), lambda x: F.struct(x["member"].alias("member"), x["score"].alias("score")))).alias("value"))
        elif name == "hash":
            one = df.groupBy("key").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value"))))).alias("value"))
        else:
            raise ValueError(f"no facet {name}")
        one = one.select("key", F.lit(name).alias("type"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def from_documents(docs: DataFrame) -> dict[str, DataFrame]:
    """The facets of as_documents()."""
    of = lambda kind: docs.where(F.col("type") == kind)
    return {
        "string": of("string").select("key", F.get_json_object("value", "$.value").alias("value")),
        "list": of("list").select("key", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "elem")),
        "set": of("set").select("key", F.explode(F.from_json("value", "array<string>")).alias("member")),
        "zset": of("zset").select("key", F.inline(F.from_json("value", "array<struct<member:string,score:double>>"))),
        "hash": of("hash").select("key", F.explode(F.from_json("value", "map<string,string>")).alias("field", "value")),
    }


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """file, place, args: commands of a log in which each is *n and n times $length and the bytes. One task reads a file, as it cannot be split."""
    ship(spark)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                at, out, place = 0, [], 0
                while at < len(raw) and raw[at : at + 1] == b"*":
                    end = raw.index(b"\r\n", at)
                    n, at, args = int(raw[at + 1 : end]), end + 2, []
                    for _ in range(n):
                        end = raw.index(b"\r\n", at)
                        size = int(raw[at + 1 : end])
                        args.append(raw[end + 2 : end + 2 + size].decode("utf-8", "replace"))
                        at = end + 2 + size + 2
                    out.append((name, place, args))
                    place += 1
                    if len(out) == 1024:
                        yield pd.DataFrame(out, columns=["file", "place", "args"])
                        out = []
                yield pd.DataFrame(out, columns=["file", "place", "args"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, place long, args array<string>")


def replay(commands: DataFrame) -> dict[str, DataFrame]:
    """The facets after SET, RPUSH, SADD, ZADD and HSET of a log; of a key or element set more than once the last counts."""
    name, key = F.upper(F.col("args")[0]), F.col("args")[1]
    of = lambda c: commands.where(name == c)
    rest = lambda start: F.slice("args", start, F.size("args"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("args") / 2 - 2).cast("int")), lambda i: F.struct(F.get("args", i * 2 + 2).alias("a"), F.get("args", i * 2 + 3).alias("b")))
    order = F.struct("file", "place")
    pushed = of("RPUSH").select(key.alias("key"), "file", "place", F.posexplode(rest(3)).alias("i", "elem"))
    w = Window.partitionBy("key").orderBy("file", "place", "i")
    last = lambda df, by, value: df.groupBy(*by).agg(F.max_by(value, order).alias(value))
    two = lambda c, a, b: of(c).select(key.alias("key"), "file", "place", F.inline(pairs)).select("key", "file", "place", F.col("a").alias(a), F.col("b").alias(b))
    return {
        "string": last(of("SET").select(key.alias("key"), F.col("args")[2].alias("value"), "file", "place"), ["key"], "value"),
        "list": pushed.select("key", (F.row_number().over(w) - 1).cast("long").alias("pos"), "elem"),
        "set": of("SADD").select(key.alias("key"), F.explode(rest(3)).alias("member")).distinct(),
        "hash": last(two("HSET", "field", "value"), ["key", "field"], "value"),
        "zset": last(two("ZADD", "score", "member").withColumn("score", F.col("score").cast("double")), ["key", "member"], "score"),
    }
