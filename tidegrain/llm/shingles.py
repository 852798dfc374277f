"""64-bit fingerprints of word k-grams of one text, in numpy."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_grams(text: str | None, k: int) -> np.ndarray:
    """Fingerprints of all k-word windows in order; A-Z lower-cased, words split at ASCII white space.  A text of fewer words
    is one window; a text without words has none."""
    return grams_of((text or "").encode().lower().split(), k)


def grams_of(words: list[bytes], k: int) -> np.ndarray:
    """word_grams() of a text that is split already."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    power, inverse = _tables(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTES[joined] * power[: len(joined)], out=sums[1:])
    ends = np.flatnonzero(joined == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) < k:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    return mixed((sums[ends] - sums[starts]) * inverse[starts])
