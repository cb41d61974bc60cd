"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts of a batch are laid out as one array of code points, which a table turns into character classes. Each class is a
transition function on a few states (after a space, inside letters, after an apostrophe that may open a contraction
and so on); functions compose associatively, so states at all characters come from a blocked prefix scan over the
finite monoid that the functions generate. Where a piece starts follows from the states and classes around a
character. No regular expression runs. The pieces are the slices between starts; each goes through a bounded cache of
merged pieces. Ids come as packed little-endian 32-bit integers, beside the byte offset at which each token ends;
decoding lays the tokens' bytes at these offsets. round_trip() does both in one pass of one Python worker a task.

Defined results: a null text counts as empty and has no token; lone surrogates cannot occur in Spark strings; a piece of
any length is merged in O(n log n). Repeated rows get equal results; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.llm.common import small_batches, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters whose states are found at once; a longer text is taken alone.
CHUNK = 1 << 19
CACHED = 200_000
CACHED_LENGTH = 48
#: Pieces of up to so many bytes are merged by looking through all pairs, longer ones with a heap.
SHORT = 64
NEVER = 1 << 40
#: Tokens whose bytes are laid out at once.
LAID = 1 << 16

# Character classes.
END, LETTER, SINGLE, R, V, L, E, NUMBER, APOSTROPHE, OTHER, SPACE, WHITE = range(12)
# States: what stands before the next character.
INIT, AFTER_SPACE, AFTER_WHITE, IN_LETTERS, IN_NUMBER, IN_OTHER, OPEN, OPEN_R, OPEN_V, OPEN_L, CONTRACTED = range(11)
_LETTERS = {LETTER, SINGLE, R, V, L, E}
#: White space as the pattern's \s has it, by code point ranges.
_WHITE = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]


@cache
def _classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = LETTER
        elif kind == "N":
            out[i] = NUMBER
    for a, b in _WHITE:
        out[a : b + 1] = WHITE
    out[ord(" ")], out[ord("'")] = SPACE, APOSTROPHE
    for c in "stmd":
        out[ord(c)] = SINGLE
    for c, k in (("r", R), ("v", V), ("l", L), ("e", E)):
        out[ord(c)] = k
    return out


def _next(state: int, kind: int) -> int:
    if kind == END:
        return INIT
    if kind in (SPACE, WHITE):
        return AFTER_SPACE if kind == SPACE else AFTER_WHITE
    if kind == NUMBER:
        return IN_NUMBER
    if kind == OTHER:
        return IN_OTHER
    if kind == APOSTROPHE:
        return IN_OTHER if state in (AFTER_SPACE, IN_OTHER, OPEN) else OPEN
    if state == OPEN:
        return {SINGLE: CONTRACTED, R: OPEN_R, V: OPEN_V, L: OPEN_L}.get(kind, IN_LETTERS)
    if (state, kind) in ((OPEN_R, E), (OPEN_V, E), (OPEN_L, L)):
        return CONTRACTED
    return IN_LETTERS


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By class its function's number; by two functions that of the first, then the second; by function and state the next state."""
    unit = tuple(range(11))
    known = {unit: 0}
    todo = [unit]
    base = [tuple(_next(s, k) for s in range(11)) for k in range(12)]
    while todo:
        f = todo.pop()
        for g in base:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    apply = np.array(list(known), np.uint8)
    compose = np.array([[known[tuple(g[x] for x in f)] for g in known] for f in known], np.uint16)
    return np.array([known[f] for f in base], np.uint16), compose, apply


def _scan(f: np.ndarray, compose: np.ndarray, width: int = 128) -> np.ndarray:
    """Inclusive prefix compositions, by blocks: within blocks for all blocks at once, then over block totals, then both together."""
    n = len(f)
    if n <= width:
        out = np.empty(n, np.uint16)
        acc = 0
        for i in range(n):
            acc = out[i] = compose[acc, f[i]]
        return out
    rows = -(-n // width)
    cols = np.zeros(rows * width, np.uint16)  # 0 is the unit
    cols[:n] = f
    cols = np.ascontiguousarray(cols.reshape(rows, width).T)
    size, flat = len(compose), compose.ravel()
    for j in range(1, width):
        cols[j] = flat[cols[j - 1].astype(np.int32) * size + cols[j]]
    before = np.zeros(rows, np.int32)
    before[1:] = _scan(cols[-1], compose, width)[:-1]
    return flat[before[None, :] * size + cols].T.reshape(-1)[:n]


def starts(kinds: np.ndarray) -> np.ndarray:
    """Where pieces start, by character classes of texts that each end with END; END counts as a start."""
    functions, compose, apply = _monoid()
    after = apply[_scan(functions[kinds], compose), INIT]
    before = np.concatenate([np.array([INIT], np.uint8), after[:-1]])
    follow = np.concatenate([kinds[1:], np.array([END], np.uint8)])
    then = np.concatenate([after[1:], np.array([INIT], np.uint8)])
    white = (kinds == SPACE) | (kinds == WHITE)
    letter = (kinds >= LETTER) & (kinds <= E)
    follow_white = (follow == SPACE) | (follow == WHITE)
    in_white = (before == AFTER_SPACE) | (before == AFTER_WHITE)
    in_letters = (before == IN_LETTERS) | ((before >= OPEN_R) & (before <= OPEN_L))
    # In white space only the last character starts a piece, where more text follows: it may lead the next word.
    out = np.where(white, ~in_white | ((follow != END) & ~follow_white), True)
    plain = ~white & (kinds != END)
    same = (letter & in_letters) | ((kinds == NUMBER) & (before == IN_NUMBER)) | (((kinds == OTHER) | (kinds == APOSTROPHE)) & ((before == IN_OTHER) | (before == OPEN)))
    contraction = (before == OPEN) & ((after == CONTRACTED) | ((after >= OPEN_R) & (after <= OPEN_L) & (then == CONTRACTED)))
    out &= ~(plain & ((before == AFTER_SPACE) | same | contraction))
    return out | (before == INIT) | (kinds == END)


def pieces(texts: list[str]) -> list[list[str]]:
    """The pieces of each text."""
    out: list[list[str]] = []
    group: list[str] = []
    size = 0

    def flush() -> None:
        if not group:
            return
        joined = "\n".join(group) + "\n"
        ends = np.cumsum([len(t) + 1 for t in group]) - 1
        kinds = _classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        kinds[ends] = END
        at = np.flatnonzero(starts(kinds))
        last = np.searchsorted(at, ends)
        at = at.tolist()
        first = 0
        for k in last.tolist():
            out.append([joined[a:b] for a, b in zip(at[first:k], at[first + 1 : k + 1], strict=True)])
            first = k + 1
        group.clear()

    for t in texts:
        if group and size + len(t) > CHUNK:
            flush()
            size = 0
        group.append(t)
        size += len(t) + 1
    flush()
    return out


def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec(dict):
    """Pieces and their packed ids; as a dict it is the bounded cache."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def merged(self, raw: bytes) -> list[int]:
        """Always joins the pair of lowest rank, the leftmost of equal ones."""
        if raw in self.ranks:
            return [self.ranks[raw]]
        ranks, n = self.ranks, len(raw)
        if n <= SHORT:
            parts = [raw[i : i + 1] for i in range(n)]
            joint = [ranks.get(raw[i : i + 2], NEVER) for i in range(n - 1)]
            while joint and (low := min(joint)) != NEVER:
                i = joint.index(low)
                parts[i] += parts.pop(i + 1)
                del joint[i]
                if i:
                    joint[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
                if i < len(joint):
                    joint[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
            return [ranks[x] for x in parts]
        ends, befores = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = ends[i]
            # Stale: a part is gone or has grown since.
            if not alive[i] or j >= n or not alive[j] or ends[j] != end:
                continue
            alive[j] = False
            ends[i] = end
            if end < n:
                befores[end] = i
                if (r := ranks.get(raw[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (p := befores[i]) >= 0 and (r := ranks.get(raw[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        return [ranks[raw[i : ends[i]]] for i in range(n) if alive[i]]

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.merged(piece.encode("utf-8", "replace")), "<u4").tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = out
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.__getitem__, own)) for own in pieces(texts)]

    def ends(self, ids: bytes) -> bytes:
        """The byte offset behind each token, packed as the ids are."""
        return self.lengths[np.frombuffer(ids, "<u4")].cumsum().astype("<u4").tobytes()

    def decode(self, ids: bytes, ends: bytes | None = None) -> bytes:
        """The bytes of packed ids, each token's laid where the one before ends."""
        at, end = np.frombuffer(ids, "<u4"), np.frombuffer(self.ends(ids) if ends is None else ends, "<u4").astype(np.int64)
        out = []
        for first in range(0, len(at), LAID):
            own, to = at[first : first + LAID], end[first : first + LAID]
            start = int(end[first - 1]) if first else 0
            before = np.r_[start, to[:-1]]
            out.append(self.bytes[np.repeat(self.begins[own] - before, to - before) + np.arange(start, int(to[-1]))].tobytes())
        return b"".join(out)

    def span(self, ids: bytes, ends: bytes, start: int, stop: int) -> bytes:
        """Bytes start to stop of the text, from the tokens that cover them only."""
        at = np.frombuffer(ends, "<u4")
        stop = min(stop, int(at[-1]) if len(at) else 0)
        if stop <= start:
            return b""
        i, j = int(np.searchsorted(at, start, "right")), int(np.searchsorted(at, stop, "left")) + 1
        skip = start - (int(at[i - 1]) if i else 0)
        return self.decode(ids[4 * i : 4 * j])[skip : skip + stop - start]


def _codec(shared, kept: dict = {}) -> Codec:  # noqa: B006  one codec for each worker process
    if "codec" not in kept:
        kept["codec"] = Codec(shared.value)
    return kept["codec"]


def encode(df: DataFrame, ranks: dict[bytes, int], text: str = "text", out: str = "tokens") -> DataFrame:
    """df with a struct column: ids and ends, packed little-endian unsigned 32-bit integers."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary has a fixed size

    @F.pandas_udf("ids binary, ends binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared)
        for texts in batches:
            ids = codec.encode([t or "" for t in texts])
            yield pd.DataFrame({"ids": ids, "ends": [codec.ends(x) for x in ids]})

    return df.withColumn(out, encoded(F.col(text)))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str, out: str = "decoded") -> DataFrame:
    """df with a binary column: the bytes that packed ids stand for; null ids: no bytes."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared)
        for x in batches:
            yield pd.Series([codec.decode(v or b"") for v in x], dtype=object)

    return df.withColumn(out, decoded(F.col(ids)))


def round_trip(df: DataFrame, ranks: dict[bytes, int], text: str = "text", out: str = "trip") -> DataFrame:
    """df with a struct column: n_tokens and the SHA-256 of packed ids and of the bytes decoded from them. Only these leave the Python worker."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def tripped(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared)
        for texts in batches:
            ids = codec.encode([t or "" for t in texts])
            back = (codec.decode(x, codec.ends(x)) for x in ids)
            yield pd.DataFrame({"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back]})

    return df.withColumn(out, tripped(F.col(text)))


def _digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    ranks = load(vocabulary or public_tokenizers.path(VOCABULARY))
    return round_trip(docs.select("doc_id", "text"), ranks).select("doc_id", "trip.n_tokens", "trip.ids_sha256", "trip.decoded_sha256")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of the pipeline: each document's token count and digests."""
    return _digests(docs)
