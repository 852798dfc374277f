"""Word-aligned coding of unsigned integers, whole blocks at a time in numpy.

A 64-bit word is a 4-bit selector (the top bits) and 60 bits of payload.  Selector k packs COUNTS[k] integers of
60 // COUNTS[k] bits, the first in the lowest bits; the last selector is an escape: the next word holds one integer whole.
Blocks of BLOCK integers start at a word of their own and their word offsets are kept, so all blocks of a segment are
encoded in step and decoded in any order.  Missing integers at the end of a block are padded with zeros in the last word.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK = 256


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each integer needs, exactly."""
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    top, bottom = np.frexp(high)[1], np.frexp(low)[1]
    return np.where(high > 0, top + 32, bottom).astype(np.int8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block)."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    padded = np.zeros((blocks, BLOCK + COUNTS[0]), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = values
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    widths = _widths(padded.reshape(-1)).reshape(padded.shape)
    # the first (densest) selector whose count of integers from here on all fit
    pick = np.full((blocks, BLOCK), ESCAPE, np.int8)
    span, have = widths, 1
    for k in range(len(COUNTS) - 1, -1, -1):
        count = COUNTS[k]
        while have < count:  # running maximum over `have` integers, widened by at most its own length
            step = min(have, count - have)
            span = np.maximum(span, np.pad(span[:, step:], ((0, 0), (0, step))))
            have += step
        fits = span[:, :BLOCK] <= 60 // count
        if not fits.any():  # then no denser selector fits either
            break
        pick[fits] = k
    lens = np.array([*COUNTS, 0, 1], np.int64)
    step = lens[pick].ravel()
    size = np.full(blocks, BLOCK, np.int64)
    size[-1] = n - (blocks - 1) * BLOCK
    at = np.arange(blocks) * BLOCK  # in every block at once, from word to word
    stop = at + size
    heads = np.zeros(blocks * BLOCK, bool)
    while len(at):
        heads[at] = True
        at = at + step[at]
        at, stop = at[at < stop], stop[at < stop]
    at = np.flatnonzero(heads)
    row = at // BLOCK
    chosen = pick.ravel()[at]
    source = at + row * COUNTS[0]  # padded rows are longer
    values = padded.ravel()
    escaped = chosen == ESCAPE
    place = np.arange(len(row)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(row) + int(escaped.sum()), np.uint64)
    for k, count in enumerate(COUNTS):
        own = np.flatnonzero(chosen == k)
        if len(own):
            word, base = np.full(len(own), k << 60, np.uint64), source[own]
            for j in range(count):
                word |= values[base + j] << np.uint64(j * (60 // count))
            words[place[own]] = word
    own = np.flatnonzero(escaped)
    words[place[own]] = np.uint64(ESCAPE << 60)
    words[place[own] + 1] = values[source[own]]
    return words, place[np.searchsorted(row, np.arange(blocks))]


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n integers of encode()."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    # the word after an escape is no selector word; escapes are found one after another only where there are any
    plain = np.ones(len(words), bool)
    for e in np.flatnonzero(selector == ESCAPE):
        if plain[e]:
            plain[e + 1] = False
    at = np.flatnonzero(plain)
    chosen = selector[at]
    lens = np.array([*COUNTS, 0, 1], np.int64)[chosen]
    block = np.searchsorted(offsets, at, side="right") - 1
    ahead = np.cumsum(lens) - lens
    first = np.searchsorted(at, offsets)
    place = block * BLOCK + ahead - ahead[first][block]
    end = np.minimum((block + 1) * BLOCK, n)
    for k, count in enumerate(COUNTS):
        own = np.flatnonzero(chosen == k)
        width = 60 // count
        mask = np.uint64((1 << width) - 1)
        for j in range(count if len(own) else 0):
            inside = own[place[own] + j < end[own]]
            out[place[inside] + j] = (words[at[inside]] >> np.uint64(j * width)) & mask
    own = np.flatnonzero(chosen == ESCAPE)
    out[place[own]] = words[at[own] + 1]
    return out
