"""Language identification by averaged hashed subword embeddings with a linear softmax.

Letters are lower-cased, runs of anything else become one gap, and all windows of 1 to 4 characters without an inner gap
are hashed into a table of embeddings. A text's vector is the mean over its windows, a linear layer and a softmax
follow; both are trained by stochastic gradient descent in numpy, a few samples at a time, on pieces of labelled texts, long and short; each
language gives a bounded number of texts, so that rare ones are learned too. A
temperature is then fitted on texts kept aside, and a text is rejected when its probability falls below nearly all
that were right there. Since the mean is linear, a window contributes one row of (embeddings x layer) to the
logits: scoring counts a text's windows by bucket and multiplies the counts by that small table. Whole texts count: a long one is
taken in chunks that overlap by what windows reach over, so that each window is met once.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected; with no labelled text every
text is `und` with score 0 and none but those is rejected; with one language learned its score is 1. Repeated rows get equal results; an empty
table gives no rows. Other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetloom.llm.common import columns, free_name, held_out, small_batches, table

UNKNOWN = "und"
SIZES = (1, 2, 3, 4)
#: Characters that are taken at once.
CHUNK = 1 << 20
#: Samples of one step of the descent.
STEP = 4


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    #: buckets x languages: embeddings times layer.
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    #: Texts below this probability are rejected.
    reject: float


@cache
def _letters() -> np.ndarray:
    """By code point: is it a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters by code point; each run of anything else, and either end, is one 0."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    code = np.where(_letters()[code], code, 0).astype(np.uint64)
    code = np.concatenate([np.zeros(1, np.uint64), code, np.zeros(1, np.uint64)])
    return code[np.r_[True, (code[1:] != 0) | (code[:-1] != 0)]]


def _windows(code: np.ndarray, buckets: int, least: int = 0) -> np.ndarray:
    """The buckets (their number is a power of 2) of all windows of codes that end at place `least` or behind it."""
    out = []
    for n in SIZES:
        first = max(0, least - n + 1)
        if len(code) - first < n:
            continue
        h = np.full(len(code) - first - n + 1, n, np.uint64)
        inner = np.ones(len(h), bool)
        for i in range(n):
            c = code[first + i : first + i + len(h)]
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < i < n - 1 or n == 1:
                inner &= c != 0
        out.append((h[inner] >> np.uint64(17)) & np.uint64(buckets - 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def _counts(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's windows and how often each occurs."""
    code = _codes(text)
    if len(code) <= CHUNK:
        return np.unique(_windows(code, buckets), return_counts=True)
    counts = np.zeros(buckets, np.int64)
    reach = max(SIZES) - 1
    for start in range(0, len(code), CHUNK):
        before = min(start, reach)
        counts += np.bincount(_windows(code[start - before : start + CHUNK], buckets, before), minlength=buckets)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _pieces(text: str, rng: np.random.Generator, several: int, most: int) -> list[str]:
    """A piece of up to `most` characters and several of 15 to 300, from anywhere in the text."""
    sizes = [most] + [int(np.exp(rng.uniform(np.log(15), np.log(300)))) for _ in range(several)]
    starts = [int(rng.integers(0, max(1, len(text) - n + 1))) for n in sizes]
    return [t for at, n in zip(starts, sizes, strict=True) if has_letter(t := text[at : at + n])]


def fit(
    rows: list[tuple[str, str]], buckets: int = 1 << 15, dim: int = 12, epochs: int = 3, rate: float = 0.5, boost: float = 20.0, reject_share: float = 0.001, most: int = 1000, seed: int = 11
) -> LanguageModel:
    """rows: (text, language). A fifth is kept aside for the temperature and the rejection. boost: times the rate that embeddings learn with, as each has a small share of a mean. most: characters of the longest piece of a text."""
    rows = [(t, k) for t, k in rows if k is not None and has_letter(t)]
    langs = tuple(sorted({k for _, k in rows}))
    if not langs:
        return LanguageModel((), np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    emb, layer, bias = rng.normal(0, 0.1, (buckets, dim)), np.zeros((dim, len(langs))), np.zeros(len(langs))
    layer += rng.normal(0, 0.1, layer.shape)
    at = {k: i for i, k in enumerate(langs)}
    learn = [r for i, r in enumerate(rows) if i % 5] or rows
    aside = [r for i, r in enumerate(rows) if i % 5 == 0]
    count = np.bincount([at[k] for _, k in learn], minlength=len(langs))
    weight = np.minimum(4.0, len(learn) / (len(langs) * np.maximum(count, 1)))  # rare languages count for more, within reason
    samples = [(*_counts(p, buckets), at[k]) for t, k in learn for p in _pieces(t, rng, 2, most)]
    samples = [(ids, n / n.sum(), y) for ids, n, y in samples]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(samples))
        for first in range(0, len(order), STEP):
            some = [samples[i] for i in order[first : first + STEP]]
            mean = np.stack([share @ emb[ids] for ids, share, _ in some])
            y = np.array([k for _, _, k in some])
            grad = _softmax(mean @ layer + bias)
            grad[np.arange(len(some)), y] -= 1
            grad *= weight[y][:, None]
            back = grad @ layer.T
            layer -= step * mean.T @ grad
            bias -= 0.1 * step * grad.sum(0)
            for (ids, share, _), b in zip(some, back, strict=True):
                emb[ids] -= step * boost * np.outer(share, b)
    table_ = (emb @ layer).astype(np.float32)
    scored = [(_logits(p, table_, bias), at[k]) for t, k in aside for p in _pieces(t, rng, 1, len(t))]
    temperature, reject = 1.0, 0.0
    if scored and len(langs) > 1:
        z, y = np.array([s for s, _ in scored]), np.array([k for _, k in scored])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 120))
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z / temperature)
        right = p.max(1)[p.argmax(1) == y]
        # No more than one in reject_share of what was right goes, and never what is likelier than not.
        reject = float(min(0.5, np.quantile(right, reject_share))) if len(right) else 0.0
    return LanguageModel(langs, table_, bias, temperature, reject)


def _logits(text: str, table_: np.ndarray, bias: np.ndarray) -> np.ndarray:
    ids, n = _counts(text, len(table_))
    return n @ table_[ids].astype(np.float64) / max(int(n.sum()), 1) + bias


def _scores(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    names, probs = [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not model.langs or not has_letter(text):
            names.append(UNKNOWN)
            continue
        p = _softmax(_logits(text, model.logits, model.bias) / model.temperature)
        names.append(model.langs[int(p.argmax())])
        probs[i] = p.max()
    return names, probs


def identify(df: DataFrame, model: LanguageModel, text: str = "text", out: str = "lang_id") -> DataFrame:
    """df with a struct column: lang_pred, score (0 to 1), rejected."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            names, probs = _scores(list(texts), m)
            unknown = np.array([not has_letter(t) for t in texts], bool)
            yield pd.DataFrame({"lang_pred": names, "score": probs, "rejected": unknown | (probs < m.reject)})

    return df.withColumn(out, named(F.col(text)))


def labelled(documents: DataFrame, rows_per_lang: int = 1000, max_chars: int = 20_000, most_langs: int = 1000) -> list[tuple[str, str]]:
    """A bounded sample of labelled texts: of each language rows_per_lang, the first by a hash of the id; of a longer text a piece of max_chars characters from anywhere in it.

    Counts are of the rows that may be learned from, so that no language is missed because others are commoner. Of more than most_langs names the commonest are learned.
    """
    own = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not counts:
        return []
    # About twice as many as are asked for, by a hash, before anything is ordered: what is shuffled is small.
    shares = documents.sparkSession.createDataFrame([(r["lang"], min(1.0, 2 * rows_per_lang / r["n"])) for r in counts], "l__ string, share double")
    h = F.xxhash64("doc_id")
    picked = own.join(F.broadcast(shares), F.col("lang") == F.col("l__")).where(F.pmod(F.xxhash64(F.lit("share"), "doc_id"), F.lit(1 << 30)) <= (F.col("share") * (1 << 30)).cast("long"))
    room = F.greatest(F.length("text") - max_chars, F.lit(0)) + 1
    picked = picked.select("lang", "doc_id", h.alias("h"), F.substring("text", F.pmod(F.xxhash64(F.lit("piece"), "doc_id"), room.cast("long")).cast("int") + 1, F.lit(max_chars)).alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text")))
    got = picked.withColumn("n", place).where(F.col("n") <= rows_per_lang).select("text", "lang", "h", "doc_id").toPandas()
    got = got.sort_values(["h", "doc_id", "lang", "text"], kind="stable")
    return list(zip(got["text"], got["lang"], strict=True))


def train(documents: DataFrame) -> LanguageModel:
    """Learns from the documents whose crc32(doc_id as text) mod 3 is not 1."""
    return fit(labelled(documents.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1))))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents)
    named = identify(documents.select("doc_id", "text"), model)
    return named.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_id.lang_pred", "lang_id.score", "lang_id.rejected")


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is known well enough, with their columns."""
    model = train(docs)
    name = free_name(docs, "lang_id")
    return identify(docs, model, out=name).where(~F.col(f"{name}.rejected")).select(*columns(docs))
