"""Document fingerprints by Order MinHash.

A text's runs of CHARS characters, one from each character on, are hashed, k consecutive ones at a time (CHARS + k - 1 characters, six as set), by one rule for all
scripts and lengths; white space counts as one space, and as none at the ends, and marks before the text give every character a k-mer that it ends. Every repetition of such a k-mer gets its occurrence number, so
that it is an element of its own. For each of `lanes` permutations the two elements with the smallest permuted hashes
are selected, put in the order in which they stand in the text, and their hashes are combined: a tuple per lane. The
share of equal lanes estimates how alike two texts are, in what they hold and in which order, as edit distance does.

Defined results: a null text counts as empty; a text without words has a fingerprint of its own that all such texts
share; a text with one element has tuples of one. Equal texts have equal fingerprints. Lanes are 16 bits wide, so
unlike texts agree in about one lane of 65,536 by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.llm.common import small_batches, table
from facetloom.llm.wordhash import mixed, rolled

LANES, KMER, CHARS = 64, 2, 5
_U = np.uint64
#: Elements that are permuted at once, which keeps lanes times elements in the processor's cache.
BLOCK = 1 << 10
#: Ranges of ids at most, into how many pieces one may be divided, and bounds that are looked up at once.
RANGES, PIECES, GROUP = 100_000, 1 << 20, 256


def _lanes(lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each permutation of 32 bits the offset and the odd factor; for each lane a seed of its tuples."""
    seed = mixed(np.arange(1, 2 * lanes + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return (seed[:lanes] >> _U(32)).astype(np.uint32)[:, None], (seed[lanes:] >> _U(32)).astype(np.uint32)[:, None] | np.uint32(1), seed[:lanes]


def _characters(text: str | None) -> np.ndarray:
    """Code points; a run of \\x20 and \\x09-\\x0D is one space, and none at the ends."""
    code = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    gap = (code == 0x20) | ((code >= 0x09) & (code <= 0x0D))
    if not gap.any():
        return code
    code = np.where(gap, np.uint32(0x20), code)[~gap | np.r_[False, ~gap[:-1]]]
    return code[:-1] if len(code) and code[-1] == 0x20 else code


def _runs(code: np.ndarray) -> np.ndarray:
    """Hashes of all CHARS consecutive characters."""
    n, code = len(code) - CHARS + 1, code.astype(_U)
    m = np.zeros(n, _U)
    for i in range(CHARS):
        m = m * _U(0x5851F42D4C957F2D) + code[i : i + n]
    return mixed(m)


def elements(text: str | None, k: int = KMER) -> np.ndarray:
    """The occurrence-numbered k-mers of a text in their order, one for each character."""
    code = _characters(text)
    if not len(code):
        return np.zeros(0, _U)
    m = rolled(_runs(np.r_[np.full(CHARS + k - 2, 0x110000, np.uint32), code]), k)
    # Occurrence numbers: the place within its group of equal k-mers, in the order of the text.
    order = np.argsort(m, kind="stable")
    ordered = m[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    if len(first) < len(m):
        number = np.empty(len(m), _U)
        number[order] = (np.arange(len(m)) - np.repeat(first, np.diff(np.r_[first, len(m)]))).astype(_U)
        m = m + number * _U(0xD6E8FEB86659FD93)
    return mixed(m)


def _least(e: np.ndarray, lanes: int, start: int = 0, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each lane the two smallest permuted hashes and their places, given those of the elements before start."""
    offset, factor, _ = _lanes(lanes)
    short = (e[start:] >> _U(32)).astype(np.uint32)
    rows, top = np.arange(lanes)[:, None], np.iinfo(np.uint32).max
    best, at = state or (np.empty((lanes, 0), np.int64), np.empty((lanes, 0), np.int64))
    for first in range(0, len(short), BLOCK):
        p = (short[None, first : first + BLOCK] ^ offset) * factor
        i = p.argmin(1)[:, None]
        v = p[rows, i]
        p[rows, i] = top
        j = p.argmin(1)[:, None] if p.shape[1] > 1 else i
        # Those of this block beside the best so far; of equal ones the earlier, as the sort is stable.
        best = np.concatenate([best, v, p[rows, j]][: 2 + (p.shape[1] > 1)], 1).astype(np.int64)
        at = np.concatenate([at, i + start + first, j + start + first][: 2 + (p.shape[1] > 1)], 1)
        pick = np.argsort(best, axis=1, kind="stable")[:, :2]
        best, at = best[rows, pick], at[rows, pick]
    return best, at


def _tuples(e: np.ndarray, lanes: int, at: np.ndarray) -> np.ndarray:
    if not len(e):
        return np.zeros(lanes, np.uint16)
    at, seed = np.sort(at, 1), _lanes(lanes)[2]
    first = e[at[:, 0]] if at.shape[1] > 1 else np.zeros(lanes, _U)
    return (mixed(mixed(first ^ seed) * _U(5) + e[at[:, -1]]) >> _U(48)).astype(np.uint16) | np.uint16(1)


def signature(text: str | None, lanes: int = LANES, k: int = KMER) -> np.ndarray:
    e = elements(text, k)
    return _tuples(e, lanes, _least(e, lanes)[1])


def _begun(text: str, lanes: int, k: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """signature(text), and the elements within the part that edited() leaves, with their minima."""
    e = elements(text, k)
    same = e[: len(_characters(text[: len(text) - len(text) // 4]))]
    state = _least(same, lanes)
    return _tuples(e, lanes, _least(e, lanes, len(same), state)[1]), same, state


def _gone_on(text: str, same: np.ndarray, state: tuple[np.ndarray, np.ndarray], lanes: int, k: int) -> np.ndarray:
    """signature(text), from the minima of elements with which it may start."""
    e = elements(text, k)
    shared = len(same) and len(same) <= len(e) and bool((e[: len(same)] == same).all())
    return _tuples(e, lanes, (_least(e, lanes, len(same), state) if shared else _least(e, lanes))[1])


def text_of(sig: np.ndarray) -> str:
    return sig.astype("<u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", lanes: int = LANES, k: int = KMER) -> DataFrame:
    """df with a string column: the lanes as lowercase hex."""
    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([text_of(signature(t, lanes, k)) for t in texts], dtype=object)

    return df.withColumn(out, made(F.col(text)))


def with_next(docs: DataFrame, rows_per_part: int = 2000) -> DataFrame:
    """docs (doc_id, text) in order of doc_id, null first, and rows of one id by a hash of their text, dealt into ranges as sorted partitions, each range followed by the first document of the next one.

    Adds `part__` and `halo__` (true: stands there only to follow). The ranges are from quantiles of the ids; null ids, and ids with more rows than two ranges should hold, are divided
    further by the hash of the text, so that only rows of one id and one text cannot be parted. Only bounds, sizes of ids that are divided, and first ids come to the driver, at most
    one row for each range. A range's first document travels through the same shuffle twice.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    parts = max(1, min(RANGES, n // rows_per_part))
    per = max(rows_per_part, n // RANGES)
    bounds = sorted({int(b) for b in docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    placed = _placed(docs, bounds).withColumn("null__", F.col("doc_id").isNotNull()).withColumn("tie__", F.xxhash64("text"))
    # Ids that are divided: how many ranges each gets. Few are: each has more rows than two ranges.
    large = placed.where("own__").groupBy("range__").count().where(F.col("count") > 2 * per).collect()
    pieces = docs.sparkSession.createDataFrame([(r["range__"], -(-r["count"] // per)) for r in large], "r__ long, pieces__ long")
    placed = placed.join(F.broadcast(pieces), F.col("range__") == F.col("r__"), "left")  # at most a row for each range
    # The hash's place among the pieces; ids that follow in the same range stand behind all pieces.
    piece = F.least(F.floor((F.col("tie__") / F.lit(2.0**64) + 0.5) * F.col("pieces__")), F.col("pieces__") - 1)
    inner = F.when(F.col("pieces__").isNull(), F.lit(0)).when(F.col("own__"), piece).otherwise(F.col("pieces__"))
    placed = placed.select("doc_id", "text", "null__", "tie__", (F.col("range__") * PIECES + inner).cast("long").alias("part__"))
    firsts = placed.groupBy("part__").agg(F.min(F.struct("null__", "doc_id", "tie__")).alias("f")).orderBy("part__").collect()
    if not firsts:
        return placed.withColumn("halo__", F.lit(False))
    # The range before each one, in a circle: after the last document comes the first.
    rows = [(r["part__"], r["f"]["doc_id"], r["f"]["tie__"], firsts[i - 1]["part__"]) for i, r in enumerate(firsts)]
    heads = F.broadcast(docs.sparkSession.createDataFrame(rows, "p__ long, d__ long, t__ long, b__ long"))  # a row for each range
    joined = placed.join(heads, (F.col("part__") == F.col("p__")) & F.col("doc_id").eqNullSafe(F.col("d__")) & (F.col("tie__") == F.col("t__")), "left")
    sides = F.when(F.col("b__").isNull(), F.array(F.struct(F.col("part__").alias("part__"), F.lit(False).alias("halo__")))).otherwise(
        F.array(F.struct(F.col("part__").alias("part__"), F.lit(False).alias("halo__")), F.struct(F.col("b__").alias("part__"), F.lit(True).alias("halo__")))
    )
    spread = joined.select("doc_id", "text", "null__", "tie__", F.explode(sides).alias("s__")).select("doc_id", "text", "null__", "tie__", "s__.part__", "s__.halo__")
    width = max(1, min(len(firsts), max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(firsts) // 8)))
    return spread.repartitionByRange(width, "part__").sortWithinPartitions("part__", "halo__", "null__", "doc_id", "tie__")


def _placed(docs: DataFrame, bounds: list[int]) -> DataFrame:
    """docs with range__, how many bounds are at most doc_id (-1 for a null id), and own__, whether doc_id is null or the range's lowest id. Bounds are looked up in two steps, by groups of GROUP."""
    key = F.col("doc_id")
    groups = [bounds[i : i + GROUP] for i in range(0, len(bounds), GROUP)]
    lows = F.array(*[F.lit(g[0]) for g in groups]).cast("array<bigint>")
    fine = docs.sparkSession.createDataFrame([(i + 1, g) for i, g in enumerate(groups)], "g__ int, fine__ array<long>")
    found = docs.withColumn("group__", F.size(F.filter(lows, lambda b: b <= key))).join(F.broadcast(fine), F.col("group__") == F.col("g__"), "left")  # all bounds, at most RANGES
    found = found.withColumn("at__", F.size(F.filter("fine__", lambda b: b <= key)))
    place = F.when(key.isNull(), F.lit(-1)).when(F.col("fine__").isNull(), F.lit(0)).otherwise((F.col("group__") - 1) * GROUP + F.col("at__"))
    own = key.isNull() | F.coalesce(F.get("fine__", F.col("at__") - 1) == key, F.lit(False))
    return found.select("doc_id", "text", place.cast("long").alias("range__"), own.alias("own__"))


def edited(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by the first as many characters, or all, of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, lanes: int = LANES, k: int = KMER) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row before: id, text, signature, part, whether it only follows, and what its edited text shares
        for batch in batches:
            out = []
            for doc_id, text, part, halo in zip(batch["doc_id"], batch["text"], batch["part__"], batch["halo__"], strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                sig, *shared = _begun(text, lanes, k)
                if held is not None and held[3] == part and not held[4]:
                    own = held[1]
                    new = edited(own, text)
                    e = _gone_on(new, *held[5], lanes, k)
                    out.append((held[0], len(own), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), text_of(held[2]), text_of(e), likeness(held[2], e), likeness(held[2], sig)))
                held = (doc_id, text, sig, part, halo, shared)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"doc_id": "Int64"})

    return with_next(docs).select("doc_id", "text", "part__", "halo__").mapInPandas(run, OUT)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
