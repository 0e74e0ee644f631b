"""Hashes of words and windows of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and powers from which ``span_hashes`` takes the hash of any span of bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_INVERSE, len(data)), out=sums[1:])
    return sums, _powers(_P, len(data) + 1)


def span_hashes(sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal spans have equal hashes, wherever they stand."""
    return mixed((sums[0][ends] - sums[0][starts]) * sums[1][starts])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text that ends with white space."""
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    return np.flatnonzero(~space & before), np.flatnonzero(space & ~before)


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n numbers."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n if count else 0):
        out = out * _Q + hashes[k : k + count]
    return mixed(out)


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    if len(values) < n:
        return values[:0]
    out, width = values, 1
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = n - width
    return np.minimum(out[:-rest], out[rest:]) if rest else out
