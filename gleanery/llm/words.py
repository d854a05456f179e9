"""Words of whole Arrow text columns as 64-bit hashes, without a Python object per word.

A word is ``[^\\x20\\x09-\\x0D]+``. Hashes are polynomial over bytes, mixed at the end; they name
words and word windows within a job and are compared exactly where an operator promises exact words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _U(0xD6E8FEB86659FD93)
PIECE_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, _U), np.full(max(n, PIECE_BYTES + 2), _BASE if kind == "up" else _INVERSE)]))
        if n <= PIECE_BYTES + 2:
            _powers[kind] = have
    return have[:n]


def chunks(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


def joined(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a newline after each row, and where each row starts (one more entry at the end)."""
    parts = [b"" if x is None else x for x in texts.cast(pa.large_binary()).to_pylist()]
    data = b"\n".join([*parts, b""])
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=starts[1:])
    return np.frombuffer(data.lower() if lower else data, np.uint8), starts


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word."""
    space = np.concatenate([[True], IS_SPACE[data], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; bytes are taken in pieces that end at word ends, to bound memory."""
    out = np.empty(len(start), _U)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(start):
            stop = max(first + 1, int(np.searchsorted(end, start[first] + PIECE_BYTES, "right")))
            low, high = start[first], end[stop - 1]
            sums = np.zeros(high - low + 1, _U)
            np.cumsum((data[low:high].astype(_U) + _U(1)) * _power("up", high - low), out=sums[1:])
            own = sums[end[first:stop] - low] - sums[start[first:stop] - low]
            out[first:stop] = mix(own * _power("down", int(start[stop - 1] - low) + 1)[start[first:stop] - low])
            first = stop
    return out


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; positions too near the end are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    with np.errstate(over="ignore"):
        total = words[:n].copy()
        for j in range(1, k):
            total = total * _STEP + words[j : n + j]
        return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)
