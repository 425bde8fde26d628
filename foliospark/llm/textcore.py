"""Words and rolling word hashes over whole Arrow string columns, in numpy.

A word is a maximal run of bytes of a class; as no class splits the bytes above 0x7F, byte classes and the
code-point classes of the contracts agree. Words are known by 64-bit hashes of their bytes, sequences of words by
64-bit hashes of those. Every step of both scrambles all bits (no sums or polynomials, whose collisions could be
constructed or come with repetitive texts); words of over LONG bytes are hashed by BLAKE2b. Whoever removes or links
on equal hashes alone confirms that on the words, or names the odds.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa

from foliospark.llm.shared import strings

U64 = np.uint64
LONG = 4096
M1, M2, GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: _FIRST[n] keeps the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= M1
    x ^= x >> U64(27)
    x *= M2
    x ^= x >> U64(31)
    return x


#: Everything but the space and the control characters 9 to 13.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Digits, letters and everything above 0x7F.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Runs of ALNUM (1) and runs of other visible characters (2) are words of their own.
PIECES = np.where(ALNUM, 1, np.where(NOT_SPACE, 2, 0)).astype(np.uint8)


class Words:
    """The words of a column: starts and ends in `data`, 64-bit hashes, and ptr[d]:ptr[d + 1] for document d."""

    def __init__(self, column: pa.Array, kind: np.ndarray = NOT_SPACE, lower: bool = False):
        texts = strings(column)
        n = len(texts)
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offs = offs - offs[0]
        inside = kind[self.data].view(np.uint8)
        change = np.zeros(len(inside) + 1, bool)
        change[self.offs] = True
        change[1:-1] |= inside[1:] != inside[:-1]
        self.starts = np.flatnonzero((inside > 0) & change[:-1])
        self.ends = np.flatnonzero((inside > 0) & change[1:]) + 1
        self.ptr = np.searchsorted(self.starts, self.offs)
        self._lower = lower

    @cached_property
    def _eight(self) -> np.ndarray:
        return self._blocks(LOWER[self.data] if self._lower else self.data)

    @staticmethod
    def _blocks(data: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on, as a number."""
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        return np.ndarray((len(data),), "<u8", padded, strides=(1,))

    def block(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The `size` bytes (1 to 8) from `at` on, as a number."""
        return self._eight[at] & _FIRST[size]

    @cached_property
    def hashes(self) -> np.ndarray:
        lengths = self.ends - self.starts
        out = mix(lengths.astype(U64) * GOLD)
        on, at, left = slice(None), self.starts, lengths
        while len(at):
            out[on] = mix(out[on] * M2 ^ self.block(at, np.minimum(left, 8)))
            more = np.flatnonzero((left > 8) & (left <= LONG) if isinstance(on, slice) else left > 8)
            on, at, left = (more if isinstance(on, slice) else on[more]), at[more] + 8, left[more] - 8
        for k in np.flatnonzero(lengths > LONG):
            word = self.data[self.starts[k] : self.ends[k]].tobytes()
            out[k] = int.from_bytes(hashlib.blake2b(word.lower() if self._lower else word, digest_size=8).digest(), "little")
        return out

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def left(self) -> np.ndarray:
        """For each word, how many words its document has from it on, itself included."""
        return np.repeat(self.ptr[1:], self.counts) - np.arange(len(self.starts))


def _join(a: np.ndarray, la: int, b: np.ndarray, lb: int) -> np.ndarray:
    n = max(0, len(a) - lb)
    return mix(a[:n] * M2 ^ b[la : la + n])


def ladder(words: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size k, a hash of words[i:i + k] for every i where k words follow; built by doubling."""
    base = {1: words}
    while 2 * max(base) <= max(sizes, default=1):
        s = max(base)
        base[2 * s] = _join(base[s], s, base[s], s)
    out = {}
    for k in sizes:
        have, got, rest = 0, None, k
        for s in sorted(base, reverse=True):
            if rest >= s:
                got, have, rest = (base[s], s, rest - s) if got is None else (_join(got, have, base[s], s), have + s, rest - s)
        out[k] = mix(got + U64(k * int(GOLD) & (1 << 64) - 1))
    return out


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    return ladder(words, [k])[k]


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of x[i:i + k] for every full window."""
    have = 1
    while 2 * have <= k:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: max(0, len(x) - (k - have))], x[k - have :]) if have < k else x
