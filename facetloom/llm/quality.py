"""Quality classifier by compression.

Two zstandard dictionaries are built from pieces of good and of bad labelled texts. A text is cut into
consecutive blocks (all of it), each block is compressed once with either dictionary, and the size difference,
normalised by the sum of both sizes, says which class the block resembles. The mean over the text, the mean over
its least good quarter of blocks and the normalised size of its most compressible quarter (repetition) go through a
logistic curve that is fitted on labelled texts from which no dictionary was made: the calibrated score.

Defined results: null and empty texts have one empty block and get the score that follows from it; repeated rows get
equal scores; with no labelled rows, or one class only, every score is that class's smoothed share; an empty table gives no rows. Extra columns, whatever
their names, do not matter: the score is one new column, and keep() returns the columns that came. A null label or id teaches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.llm.common import columns, free_name, hashed_share, held_out, small_batches, table

THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    #: Intercept and three slopes; features are standardised by mean and scale.
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    block: int = 512
    level: int = 3


def _pieces(texts: list[bytes], budget: int, piece: int) -> bytes:
    """Up to budget bytes: one piece of every text, then a second one of every text, and so on over the whole texts."""
    out, size, turn = [], 0, 0
    while size < budget:
        before = size
        for text in texts:
            # Odd steps through the pieces of a text visit all of them, far ones early.
            n = -(-len(text) // piece)
            if turn >= n or size >= budget:
                continue
            step = next(s for s in range(max(1, n * 5 // 8), n + 1) if np.gcd(s, n) == 1)
            at = turn * step % n * piece
            out.append(text[at : at + piece])
            size += len(out[-1]) + 1
        turn += 1
        if size == before:
            break
    return b"\n".join(out)[:budget]


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    more = {}
    if len(content) >= 8:
        more["dict_data"] = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        more["dict_data"].precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False, write_dict_id=False, **more)


class _Sizer:
    def __init__(self, good: bytes, bad: bytes, block: int, level: int):
        self.good, self.bad, self.block = _compressor(good, level), _compressor(bad, level), block

    def __call__(self, text: str | None) -> tuple[float, float, float]:
        raw = (text or "").encode("utf-8", "replace")
        starts = range(0, max(len(raw), 1), self.block)
        good, bad = self.good.compress, self.bad.compress
        g = np.fromiter((len(good(raw[i : i + self.block])) for i in starts), float, len(starts))
        b = np.fromiter((len(bad(raw[i : i + self.block])) for i in starts), float, len(starts))
        # 20: a few bytes that any frame has, so that short last blocks weigh little.
        diff = (b - g) / (b + g + 20)
        dense = (g + b) / (2 * (np.minimum(len(raw) - np.arange(0, max(len(raw), 1), self.block), self.block) + 20))
        low = max(1, len(diff) // 4)
        return (b.sum() - g.sum()) / (b.sum() + g.sum() + 20), np.sort(diff)[:low].mean(), np.sort(dense)[:low].mean()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; ridge holds the slopes finite where the classes separate."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _expand(f: np.ndarray) -> np.ndarray:
    """The three features and the squares that let repetition count on one side only."""
    return np.column_stack([f, np.minimum(f[:, 2:] - 0.45, 0)])


def fit(rows: list[tuple[str | None, int]], dictionary: int = 1 << 20, piece: int = 256, block: int = 512, level: int = 3) -> QualityModel:
    """rows: (text, 1 or 0). Seven tenths feed the dictionaries, the rest the calibration."""
    part = [i % 10 < 7 for i in range(len(rows))]
    side = {k: [(t or "").encode("utf-8", "replace") for (t, y), p in zip(rows, part, strict=True) if p and y == k] for k in (0, 1)}
    good, bad = (_pieces([t for t in side[k] if t], dictionary, piece) for k in (1, 0))
    kept = [r for r, p in zip(rows, part, strict=True) if not p]
    y = np.array([r[1] for r in kept], float)
    if not len(y) or y.min() == y.max() or not good or not bad:
        share = (sum(r[1] for r in rows) + 1) / (len(rows) + 2)
        return QualityModel(good, bad, (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0, 0.0), (0.0,) * 4, (1.0,) * 4, block, level)
    sizer = _Sizer(good, bad, block, level)
    f = _expand(np.array([sizer(t) for t, _ in kept]))
    mean, scale = f.mean(0), f.std(0) + 1e-9
    w = _logistic((f - mean) / scale, y, ridge=0.3)
    return QualityModel(good, bad, tuple(map(float, w)), tuple(map(float, mean)), tuple(map(float, scale)), block, level)


def labelled(documents: DataFrame, labels: DataFrame, rows_per_class: int = 4000, max_chars: int = 20_000) -> list[tuple[str | None, int]]:
    """A bounded sample of labelled rows: of either class rows_per_class labels, first by a hash of the id; rows of more than max_chars characters are not learned from (they are scored)."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sides = [labels.where(F.col("quality") == k) for k in (0, 1)]
    picked = [side.where(hashed_share("doc_id", rows_per_class, side.count())).orderBy(*order).limit(rows_per_class) for side in sides]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * rows_per_class ids and flags
    texts = documents.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars).join(chosen, "doc_id")
    got = texts.orderBy(*order, F.xxhash64("text"), "quality").limit(2 * rows_per_class).select("text", "quality").toPandas()
    return list(zip(got["text"], got["quality"].astype(int), strict=True))


def score(df: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """df with one more column: 0 to 1, higher where label 1 is likelier."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        sizer = _Sizer(m.good, m.bad, m.block, m.level)
        w, mean, scale = map(np.array, (m.weights, m.mean, m.scale))
        for texts in batches:
            f = (_expand(np.array([sizer(t) for t in texts]).reshape(-1, 3)) - mean) / scale
            yield pd.Series(1 / (1 + np.exp(-np.clip(w[0] + f @ w[1:], -30, 30))))

    return df.withColumn(out, scored(F.col(text)))


def train(documents: DataFrame, labels: DataFrame) -> QualityModel:
    """Learns from labels whose crc32(doc_id as text) mod 5 is not 0."""
    return fit(labelled(documents, labels.where(~held_out("doc_id", 5, 0))))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    model = train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "quality_score")
    return score(docs, model, out=name).where(F.col(name) >= THRESHOLD).select(*columns(docs))
