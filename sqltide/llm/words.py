"""Hashes of the words of many texts at once, from their bytes; no loop over words.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``.  Short words are hashed by a sum over
their letters; a sum of many letters can be made to collide, so words over ``SHORT`` bytes get a
keyed BLAKE2 digest instead.  Two kinds of hash that have nothing in common are on offer.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every output bit hangs on every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


#: Bytes up to which a word is hashed by its sum.
SHORT = 64


def _values(first: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte, and the same with A-Z taken as a-z."""
    plain = mix(np.arange(first, first + 256, dtype=U))
    lowered = plain.copy()
    lowered[ord("A"):ord("Z") + 1] = plain[ord("a"):ord("z") + 1]
    return plain, lowered


VALUES = (_values(1), _values(1001))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << int(n - 1).bit_length()
            self.up = np.multiply.accumulate(np.r_[U(1), np.full(size - 1, self.base, U)])
            self.down = np.multiply.accumulate(np.r_[U(1), np.full(size - 1, self.inverse, U)])


LETTERS = (Powers(0x9E3779B97F4A7C15), Powers(0xD1B54A32D192ED03))
ONE, TWO = Powers(0xC2B2AE3D27D4EB4F), Powers(0x165667B19E3779F9)


def word_hashes(texts: list[str], lower: bool = False,
                kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words begin (one entry more than texts)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    inside = ~SPACE[data]
    step = np.diff(inside.view(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(begin):
        return np.zeros(0, dtype=U), np.zeros(len(texts) + 1, dtype=np.int64)
    sizes = end - begin
    first = np.cumsum(sizes) - sizes
    powers = LETTERS[kind]
    powers.reach(SHORT)
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    values = VALUES[kind][lower][data[inside]] * powers.up[np.minimum(place, SHORT - 1)]
    hashes = mix(np.add.reduceat(values, first) + sizes.astype(U))
    for k in np.flatnonzero(sizes > SHORT):
        word = data[begin[k]:end[k]].tobytes()
        hashes[k] = np.frombuffer(hashlib.blake2b(
            word.lower() if lower else word, digest_size=8, key=bytes([kind])).digest(), "<u8")[0]
    bounds = np.searchsorted(begin, np.concatenate([[0], ends]))
    return hashes, bounds.astype(np.int64)


def window_hashes(words: np.ndarray, size: int, powers: Powers = ONE) -> np.ndarray:
    """Hash of each ``size`` consecutive entries; equal content gives equal hashes anywhere."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    powers.reach(len(words) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(words * powers.up[:len(words)])])
    return mix((sums[size:] - sums[:-size]) * powers.down[:n])


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. (sizes[0] of them), first[1], .. end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(first - (ends - sizes), sizes)
