"""Structured Streaming forms: windowed aggregates with watermarks, duplicate policies, and consumer groups with pending entries."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from facetloom.shipping import ship


def read(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, by: list[str], size: str, late: str = "0 seconds", slide: str | None = None, time: str = "ts", value: str = "value") -> DataFrame:
    """start, by, n, total, low, high of each window; with slide, windows overlap."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    df = events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return df.select(F.col("w.start").alias("start"), *by, "n", "total", "low", "high")


def sessions(events: DataFrame, by: list[str], gap: str, late: str = "0 seconds", time: str = "ts") -> DataFrame:
    df = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return df.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def first_only(events: DataFrame, keys: list[str], late: str, time: str = "ts") -> DataFrame:
    """The first sample of each key within the watermark; the policy first."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


PENDING = "key string, consumer string, entry string, n long"


def deliver(events: DataFrame, consumers: int, key: str = "key", entry: str = "entry") -> DataFrame:
    """Entries dealt to the consumers of a group in turn, for each key, in the order of entries within a trigger; how many a key has had is kept in the state store. A trigger's entries of a key are ordered in one task: files_per_batch bounds them."""
    ship(events.sparkSession)

    def run(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = sorted(x for b in batches for x in b[entry].tolist())
        for first in range(0, len(rows), 4096):
            some = rows[first : first + 4096]
            yield pd.DataFrame({"key": own[0], "consumer": [f"c{(n + i) % consumers}" for i in range(len(some))], "entry": some, "n": range(n, n + len(some))})
            n += len(some)
        state.update((n,))

    return events.groupBy(key).applyInPandasWithState(run, PENDING, "n long", "append", GroupStateTimeout.NoTimeout)


def to_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there by now, then ends; the checkpoint makes a second call go on where the first ended, exactly once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def publish(df: DataFrame, channel: str, path: str, checkpoint: str) -> StreamingQuery:
    """Messages of a stream appended to a channel's folder."""
    return to_parquet(df.withColumn("channel", F.lit(channel)), path, checkpoint)


def progress(query: StreamingQuery) -> dict:
    return json.loads(query.lastProgress.json) if query.lastProgress else {}
