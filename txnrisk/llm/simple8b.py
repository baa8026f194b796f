"""Simple-8b word-aligned coding of unsigned integers, vectorised over blocks.

A 64-bit word holds a 4-bit selector and 60 bits of payload. Selectors 1 to 14 pack a fixed count of equally wide values.
Values of more than 60 bits are escaped into two words: selector 0 with the low 60 bits, then selector 15 with the rest.
Values are cut into blocks of BLOCK; words never cross a block, and the number of words before each block is
kept, so that any block can be decoded on its own and all blocks of a segment at once.
"""

from __future__ import annotations

import numpy as np

# Values per word of selectors 1 to 14; each value has 60 // count bits.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], dtype=np.int64)
PAYLOAD = 60
LOW, HIGH = 0, 15
BLOCK = 128

#: Selector with the largest count that is at most k, for k from 0 to 60.
_SELECTOR = np.array([0] + [int(np.argmax((COUNTS[1:15] <= k))) + 1 for k in range(1, 61)], dtype=np.int64)
_MASK60 = np.uint64((1 << PAYLOAD) - 1)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words before each block) of unsigned integers; both empty for no values."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    blocks = -(-n // BLOCK)
    bits = np.full(blocks * BLOCK, 255, dtype=np.uint8)  # nothing fits past the end
    # The exponent of a rounded value may be one too large: a wider word, never a wrong one.
    bits[:n] = np.maximum(np.frexp(values.astype(np.float64))[1], 1)
    rows = bits.reshape(blocks, BLOCK)
    most, fitting = rows, np.ones((blocks, BLOCK), dtype=np.uint8)
    for count in range(2, PAYLOAD + 1):  # how many values from each position on are narrow enough for so many
        most = np.maximum(most[:, :-1], rows[:, count - 1 :])
        fits = most <= PAYLOAD // count
        if not fits.any():
            break
        fitting[:, : BLOCK - count + 1] += fits
    selectors = _SELECTOR[fitting.ravel()]
    taken = COUNTS[selectors]
    # Words start where the word before ends: all blocks go ahead in step.
    starts = np.zeros(blocks * BLOCK, dtype=bool)
    at = np.arange(blocks, dtype=np.int64) * BLOCK
    ends = np.minimum(at + BLOCK, n)
    while len(at):
        starts[at] = True
        at = at + taken[at]
        going = at < ends
        at, ends = at[going], ends[going]
    first = np.flatnonzero(starts)
    selector, size = selectors[first], taken[first]
    width = (PAYLOAD // size).astype(np.uint64)
    words = selector.astype(np.uint64) << np.uint64(PAYLOAD)
    for j in range(int(size.max())):
        more = np.flatnonzero(size > j)
        words[more] |= (values[first[more] + j] & _MASK60) << (width[more] * np.uint64(j))
    owner = first // BLOCK
    wide = np.flatnonzero(bits[first] > PAYLOAD)
    if len(wide):
        value = values[first[wide]]
        words[wide] = value & _MASK60  # selector 0
        words = np.insert(words, wide + 1, (value >> np.uint64(PAYLOAD)) | (np.uint64(HIGH) << np.uint64(PAYLOAD)))
        owner = np.insert(owner, wide + 1, owner[wide])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=blocks))[:-1]]).astype(np.uint32)
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of a segment."""
    if n == 0:
        return np.empty(0, np.uint64)
    words = np.asarray(words, dtype=np.uint64)
    selector = (words >> np.uint64(PAYLOAD)).astype(np.int64)
    counts = COUNTS[selector]
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets, len(words)).astype(np.int64)))
    first = before - before[offsets.astype(np.int64)][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    payload = words & _MASK60
    out = np.zeros(n, dtype=np.uint64)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        if s == LOW:
            continue
        if s == HIGH:
            out[first[rows]] = payload[rows - 1] | (words[rows] << np.uint64(PAYLOAD))
            continue
        bits = PAYLOAD // int(COUNTS[s])
        mask = np.uint64((1 << bits) - 1)
        for j in range(int(COUNTS[s])):
            kept = rows[first[rows] + j < end[rows]]
            if not len(kept):
                break
            out[first[kept] + j] = (payload[kept] >> np.uint64(j * bits)) & mask
    return out
