"""Words of texts as numpy arrays, and hashes of runs of words."""

from __future__ import annotations

import hashlib

import numpy as np

WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
# Digits, letters and every byte of a character beyond ASCII.
_IS_ALNUM = np.zeros(256, bool)
_IS_ALNUM[48:58] = _IS_ALNUM[97:123] = _IS_ALNUM[128:] = True

_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTES_BASE = np.uint64(0x9E3779B97F4A7C15)
_LONGEST = 32  # bytes of a word that is hashed in place


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LENGTH_MIX = mixed(np.arange(_LONGEST + 1, dtype=np.uint64) + np.uint64(1))
# The first k of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Words:
    """The words of one text: ``hashes`` (64 bits each), ``starts`` and ``ends`` in ``data``.

    Words are runs of bytes that are not ASCII white space; with ``letters`` runs of
    a-z, 0-9 and all characters beyond ASCII, after lower-casing.
    """

    __slots__ = ("data", "starts", "ends", "hashes")

    def __init__(self, text: str | None, lower: bool = False, letters: bool = False):
        raw = (text or "").encode()
        data = np.frombuffer(raw, np.uint8)
        if lower or letters:
            data = _LOWERED[data]
            raw = data.tobytes()
        self.data = raw
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _IS_ALNUM[data] if letters else ~_IS_WHITE[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.hashes = _hashed(raw, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)


def _hashed(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each slice of raw: eight bytes at a time, mixed after each step.

    Slices of one length of up to eight bytes differ for certain, as every step is a
    bijection. A slice of more than _LONGEST bytes gets a digest.
    """
    # eights[i] are the eight bytes from i on.
    eights = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), 0, (1,))
    sizes = ends - starts
    out = _LENGTH_MIX[np.minimum(sizes, _LONGEST)]
    for begin in range(0, _LONGEST, 8):
        at = np.flatnonzero(sizes > begin)
        if not len(at):
            break
        part = eights[starts[at] + begin] & _FIRST[np.minimum(sizes[at] - begin, 8)]
        out[at] = mixed((out[at] ^ part) * _BYTES_BASE)
    for i in np.flatnonzero(sizes > _LONGEST).tolist():
        digest = hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8)
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Doubling: runs of 2k words come from two runs of k words.
    total, have, block, size, rest = None, 0, hashes, 1, length
    while True:
        if rest & 1:
            part = block[have : have + n]
            if total is None:
                total = part
            else:
                total = total * np.uint64(pow(int(_WORD_BASE), size, 1 << 64)) + part
            have += size
        rest >>= 1
        if not rest:
            return mixed(total + np.uint64(length))
        step = np.uint64(pow(int(_WORD_BASE), size, 1 << 64))
        block = block[:-size] * step + block[size:]
        size *= 2
