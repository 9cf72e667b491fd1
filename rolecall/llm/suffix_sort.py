"""Two-stage suffix sorting in numpy: sort some suffixes, induce all others.

A suffix that is smaller than its successor (the suffix one place later) is sorted
directly. Every other suffix is larger than its successor, and so comes after it in
the order; scanning the order bucket by bucket (a bucket holds the suffixes of one first
symbol), each suffix found puts the one before it at the end of that one's bucket.
Inside a bucket, suffixes larger than their successors come first.
"""

from __future__ import annotations

import numpy as np

SYMBOLS = 256


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last is, by definition."""
    n = len(text)
    differs = np.r_[text[1:] != text[:-1], False]
    # The place, at or after i, where the run of equal symbols that i is in ends.
    ends = np.where(differs, np.arange(n), n)
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    following = np.append(text, 0)[np.minimum(ends + 1, n)]
    return (ends == n) | (text < following)


def two_stage_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The places of all suffixes of ``text`` (uint8), in the order of their first
    ``depth`` symbols; suffixes equal so far are in any order.

    The text should end with a symbol smaller than all others in it.
    """
    if not len(text):
        return np.zeros(0, np.int64)
    raw = text.tobytes()
    small = smaller_than_successor(text)
    direct = np.flatnonzero(small)
    # By bucket, so that few keys are held at a time.
    direct = direct[np.argsort(text[direct], kind="stable")]
    bounds = np.searchsorted(text[direct], np.arange(SYMBOLS + 1))
    induced: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
    order = []
    for symbol in range(SYMBOLS):
        mine = direct[bounds[symbol] : bounds[symbol + 1]].tolist()
        mine.sort(key=lambda i: raw[i : i + depth])
        wave = np.concatenate([*induced[symbol], np.zeros(0, np.int64)])
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == symbol) & ~small[before]]
        bucket.append(np.array(mine, np.int64))
        scanned = np.concatenate(bucket)
        induced[symbol] = []
        order.append(scanned)
        before = scanned[scanned > 0] - 1
        before = before[text[before] > symbol]
        if len(before):
            first = text[before]
            by_symbol = np.argsort(first, kind="stable")
            first, before = first[by_symbol], before[by_symbol]
            cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
            for part, its in zip(np.split(before, cuts), first[np.r_[0, cuts]]):
                induced[its].append(part)
    return np.concatenate(order)


def common_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """How many symbols the suffixes at ``left`` and ``right`` share, at most ``most``."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(text)
    words = np.zeros(n + 1, np.uint64)
    for k in range(8):
        words[:n] |= padded[k : n + k] << np.uint64(8 * k)
    shared = np.zeros(len(left), np.int64)
    going = np.arange(len(left))
    depth = 0
    while depth < most and len(going):
        a = words[np.minimum(left[going] + depth, n)]
        b = words[np.minimum(right[going] + depth, n)]
        apart = a ^ b
        lowest = apart & (~apart + np.uint64(1))
        same = np.where(apart == 0, 8, np.log2(np.maximum(lowest, 1).astype(float)) // 8)
        shared[going] += same.astype(np.int64)
        going = going[apart == 0]
        depth += 8
    return np.minimum(shared, most)
