"""64-bit hashes of a text's words, in numpy: equal words have equal hashes in every process."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Bytes that are hashed at once.
CHUNK = 1 << 22
_BASE = 0x5851F42D4C957F2D  # odd, so that its powers have inverses modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUES = mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWERED = _VALUES.copy()
_LOWERED[65:91] = _VALUES[97:123]
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.cumprod(np.r_[_U(1), np.full(size - 1, base, _U)])
    return _powers


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """One hash for each word, a run without \\x20 and \\x09-\\x0D; lower: A-Z count as a-z."""
    raw = (text or "").encode("utf-8", "replace")
    if len(raw) <= CHUNK:
        return _hashed(raw, lower)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        if end < len(raw):
            gap = np.flatnonzero(_GAP[np.frombuffer(raw, np.uint8, end - at, at)])
            while not len(gap) and end < len(raw):  # a word longer than a chunk
                end = min(len(raw), end + CHUNK)
                gap = np.flatnonzero(_GAP[np.frombuffer(raw, np.uint8, end - at, at)])
            end = at + int(gap[-1]) + 1 if len(gap) and end < len(raw) else end
        out.append(_hashed(raw[at:end], lower))
        at = end
    return np.concatenate(out)


def _hashed(raw: bytes, lower: bool) -> np.ndarray:
    code = np.frombuffer(raw, np.uint8)
    n = len(code)
    inside = ~_GAP[code]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, _U)
    up, down = _grown(n)
    run = np.empty(n + 1, _U)
    run[0] = 0
    np.cumsum((_LOWERED if lower else _VALUES)[code] * up[:n], out=run[1:])
    return mixed((run[end] - run[start]) * down[start] + (end - start).astype(_U))


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive ones; of the whole sequence, where it is shorter; none of an empty one."""
    if not len(hashes):
        return hashes
    n, m = max(1, len(hashes) - k + 1), None
    for i in range(min(k, len(hashes))):
        m = mixed((np.zeros(n, _U) if m is None else m) * _U(3) + hashes[i : i + n])
    return mixed(m + _U(len(hashes))) if len(hashes) < k else m
