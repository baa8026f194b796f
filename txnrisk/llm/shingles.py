"""Hashes of word shingles and SuperMinHash signatures, vectorised over all texts of a batch."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _STEP, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
#: Bytes of text hashed at once; only a longer word takes more.
SEGMENT = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        out = []
        for base in (_BASE, _INVERSE):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers = tuple(out)
    return _powers


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of every text, number of words of each text); words lie between white space, nulls have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    limits = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[limits[0] : limits[-1]] if data is not None else np.empty(0, np.uint8)
    limits = limits - limits[0]
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[limits] = True
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1] | edge[1:-1]
    closes[:-1] &= ~word[1:] | edge[1:-1]
    first, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.empty(len(first), dtype=np.uint64)
    at = 0
    while at < len(first):
        start = first[at]
        stop = max(at + 1, int(np.searchsorted(end, start + SEGMENT, side="right")))
        part = data[start : end[stop - 1]]
        powers, inverses = _powers_to(len(part))
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * powers[: len(part)], out=total[1:])
        hashes[at:stop] = (total[end[at:stop] - start] - total[first[at:stop] - start]) * inverses[first[at:stop] - start]
        at = stop
    hashes = mix64(hashes + (end - first).astype(np.uint64) * _WORD)
    return hashes, np.diff(np.searchsorted(first, limits))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of every text, sorted within it; their number for each text).

    Shingles are k consecutive words; a text of fewer words, but not none, has its whole sequence as one shingle.
    """
    hashes, words = word_hashes(texts)
    n = len(words)
    counts = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    if not counts.sum():
        return np.empty(0, np.uint64), counts
    word_start = np.cumsum(words) - words
    owner = np.repeat(np.arange(n), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + word_start[owner]
    used = np.minimum(words, k)[owner]
    out = used.astype(np.uint64) * _WORD
    for j in range(k):
        more = np.flatnonzero(used > j) if (words < k).any() else slice(None)
        out[more] = out[more] * _STEP + hashes[at[more] + j]
    out = mix64(out)
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[fresh], np.bincount(owner[fresh], minlength=n)


def set_keys(shingles: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """128 bits that name each set; None for an empty one."""
    ends = np.cumsum(counts)
    return [hashlib.blake2b(shingles[a:b], digest_size=16).digest() if b > a else None for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]


def super_minhash(shingles: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of m values per non-empty set (rows of empty sets hold the maximum).

    Every element visits the m slots in an order of its own, a random permutation; its value at the i-th visited slot is
    i plus a random fraction, and a slot keeps its smallest value. All elements of a set take step i together, and a set
    is done as soon as each of its slots holds a value of an earlier step.
    """
    n = len(counts)
    slots = np.full(n * m, np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(n), counts)
    element = np.asarray(shingles, dtype=np.uint64)
    swaps: list[np.ndarray] = []  # with which place each element has swapped place t of its permutation
    for step in range(m):
        if not len(element):
            break
        draw = mix64(element + np.uint64((step + 1) * int(_BASE) % 2**64))
        place = step + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - step)) >> np.uint64(32)).astype(np.int64)
        slot = place.copy()
        for t in range(step - 1, -1, -1):  # what the earlier swaps have put there
            slot = np.where(slot == swaps[t], t, slot)
        np.minimum.at(slots, owner * m + slot, (np.uint64(step) << np.uint64(32)) | (draw >> np.uint64(32)))
        going = slots.reshape(n, m).max(axis=1) >= (np.uint64(step + 1) << np.uint64(32))
        keep = going[owner]
        swaps.append(place.astype(np.int16))
        if not keep.all():
            owner, element = owner[keep], element[keep]
            swaps = [s[keep] for s in swaps]
    return slots.reshape(n, m)


def bands_for(threshold: float, rows: int, miss: float) -> int:
    """How many bands of so many rows miss a pair at the threshold with at most the given probability."""
    return int(np.ceil(np.log(miss) / np.log1p(-(threshold**rows))))


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band's number is part of it."""
    n, m = signatures.shape
    bands = m // rows
    parts = signatures.reshape(n, bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _WORD + np.zeros((n, 1), dtype=np.uint64)
    for j in range(rows):
        key = mix64(key * _STEP + parts[:, :, j])
    return key.view(np.int64)


def linked_pairs(shingles: np.ndarray, counts: np.ndarray, percent: int, asked: np.ndarray | None = None) -> np.ndarray:
    """Boolean matrix: which of the asked sets (default: all), by row, reach 100 * intersection >= percent * union with which set, by column."""
    n = len(counts)
    asked = np.ones(n, dtype=bool) if asked is None else asked
    owner = np.repeat(np.arange(n), counts)
    order = np.argsort(shingles, kind="stable")
    tokens, owner = shingles[order], owner[order]
    opens = np.ones(len(tokens), dtype=bool)
    opens[1:] = tokens[1:] != tokens[:-1]
    column = np.cumsum(opens) - 1
    # Only shingles of several sets, an asked one among them, add to an intersection that is looked for.
    shared = (np.bincount(column, minlength=1) > 1) & (np.bincount(column, weights=asked[owner], minlength=1) > 0)
    owner, column = owner[shared[column]], column[shared[column]]
    common = np.zeros((int(asked.sum()), n))
    if len(column):
        column = np.concatenate([[0], np.cumsum(column[1:] != column[:-1])])
        width = max(256, 2_000_000 // n)
        cuts = np.searchsorted(column, np.arange(0, column[-1] + width + 1, width))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                part = np.zeros((n, width), dtype=np.float32)  # whole numbers below 2^24 add up exactly
                part[owner[a:b], column[a:b] % width] = 1
                common += part[asked] @ part.T
    size = np.asarray(counts, dtype=np.float64)
    union = size[asked][:, None] + size[None, :] - common
    return (100 * common >= percent * union) & (size[asked][:, None] > 0) & (size[None, :] > 0)
