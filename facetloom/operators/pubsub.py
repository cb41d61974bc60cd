"""Publish and subscribe: messages (channel, message, ...) against subscriptions (subscriber, pattern, exact)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.functions.text import glob


def deliver(messages: DataFrame, subscriptions: list[tuple[str, str, bool]]) -> DataFrame:
    """A row for each message and subscription that it meets; patterns are globs. Subscriptions are few and stand in the plan: one pass, no join."""
    out = F.array(*(F.when(F.col("channel") == p if exact else glob(F.col("channel"), p), F.struct(F.lit(s).alias("subscriber"), F.lit(p).alias("pattern"))) for s, p, exact in subscriptions))
    return messages.withColumn("to__", F.explode(F.filter(out, lambda x: x.isNotNull()))).select("to__.subscriber", "to__.pattern", *messages.columns)


def receivers(messages: DataFrame, subscriptions: list[tuple[str, str, bool]]) -> DataFrame:
    """channel, n: deliveries by channel."""
    return deliver(messages, subscriptions).groupBy("channel").agg(F.count("*").alias("n"))


def channels(messages: DataFrame, pattern: str = "*") -> DataFrame:
    return messages.where(glob(F.col("channel"), pattern)).select("channel").distinct()


def numsub(subscriptions: list[tuple[str, str, bool]], names: list[str]) -> dict[str, int]:
    return {n: len({s for s, p, exact in subscriptions if exact and p == n}) for n in names}


def numpat(subscriptions: list[tuple[str, str, bool]]) -> int:
    return len({p for _, p, exact in subscriptions if not exact})
