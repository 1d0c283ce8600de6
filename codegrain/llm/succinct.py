"""Packed bit vectors with rank and select, and Elias-Fano sequences over them, in numpy.

A vector has its bits in 64-bit words and, for every block of eight words, the
number of ones before it as a 32-bit number: one bit in sixteen beside the bits
themselves. rank() looks a block up and counts the rest of it; select() searches
the blocks' counts and then the one block. Both take arrays of queries.

Defined results: a vector without bits has no ones; rank() of its end is the
number of all ones; queries beyond the ones are an IndexError.
"""

from __future__ import annotations

import struct

import numpy as np

#: Words of a block, and the bits of a word.
BLOCK, WORD = 8, 64
#: Queries of select() that are spread out bit by bit at once.
_AT_ONCE = 1 << 14


class BitVector:
    """``n_bits`` bits in ``words``; ``before`` has the ones before each block, and the number of all at its end."""

    def __init__(self, words: np.ndarray, n_bits: int, before: np.ndarray | None = None) -> None:
        self.words, self.n_bits = words, n_bits
        if before is None:
            per = np.bitwise_count(words).reshape(-1, BLOCK).sum(axis=1, dtype=np.uint32)
            before = np.concatenate([np.zeros(1, np.uint32), np.cumsum(per, dtype=np.uint32)])
        self.before = before

    @classmethod
    def of(cls, flags: np.ndarray) -> "BitVector":
        """From a boolean array of fewer than 2**32 values."""
        n_words = -(-max(len(flags), 1) // (BLOCK * WORD)) * BLOCK
        packed = np.zeros(n_words * 8, np.uint8)
        packed[: -(-len(flags) // 8)] = np.packbits(flags, bitorder="little")
        return cls(packed.view("<u8"), len(flags))

    @property
    def ones(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        at = np.asarray(at, np.int64)
        word = np.minimum(at // WORD, len(self.words) - 1)
        block = word // BLOCK
        near = self.words[block[:, None] * BLOCK + np.arange(BLOCK)]
        counts = np.where(np.arange(BLOCK) < (word % BLOCK)[:, None], np.bitwise_count(near), 0).sum(axis=1, dtype=np.int64)
        rest = (at - word * WORD).astype(np.uint64)
        mask = np.where(rest >= WORD, ~np.uint64(0), (np.uint64(1) << (rest % np.uint64(WORD))) - np.uint64(1))
        return self.before[block].astype(np.int64) + counts + np.bitwise_count(self.words[word] & mask)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Places of the ones with these numbers, from 0."""
        nth = np.asarray(nth, np.int64)
        if len(nth) and (nth.min() < 0 or nth.max() >= self.ones):
            raise IndexError(f"{self.ones} ones")
        out = np.empty(len(nth), np.int64)
        for i in range(0, len(nth), _AT_ONCE):
            k = nth[i : i + _AT_ONCE]
            block = np.searchsorted(self.before, k, side="right") - 1
            near = self.words[block[:, None] * BLOCK + np.arange(BLOCK)]
            ends = np.cumsum(np.bitwise_count(near), axis=1, dtype=np.int64)
            left = k - self.before[block]
            word = (ends <= left[:, None]).sum(axis=1)
            rows = np.arange(len(k))
            left = left - np.where(word > 0, ends[rows, np.maximum(word - 1, 0)], 0)
            bits = np.unpackbits(near[rows, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            seen = np.cumsum(bits, axis=1, dtype=np.uint8)
            bit = (seen <= left[:, None]).sum(axis=1)
            out[i : i + _AT_ONCE] = (block * BLOCK + word) * WORD + bit
        return out


_HEAD = struct.Struct("<QQBxxxxxxx")


def _pack(low: np.ndarray, width: int) -> bytes:
    bits = (low[:, None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


class EliasFano:
    """A sequence of numbers that never falls, from 0 on, in some 2 + log2(largest / length) bits each; any of them by select()."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: BitVector) -> None:
        self.n, self.width, self.low, self.high = n, width, low, high

    @staticmethod
    def dump(values: np.ndarray) -> bytes:
        """The bytes of a sequence of unsigned 64-bit numbers: header, low bits, high bits, counts of the blocks; padded to words."""
        values = np.asarray(values, np.uint64)
        n, largest = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (largest // n).bit_length() - 1) if n else 0
        low = _pack(values & np.uint64((1 << width) - 1), width) if width else b""
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(at[-1]) + 1 if n else 0, bool)
        flags[at] = True
        high = BitVector.of(flags)
        pad = lambda b: b + b"\0" * (-len(b) % 8)
        return _HEAD.pack(n, len(flags), width) + pad(low) + high.words.tobytes() + pad(high.before.astype("<u4").tobytes())

    @classmethod
    def load(cls, raw: bytes | memoryview, at: int = 0) -> tuple["EliasFano", int]:
        """The sequence at a place of ``raw``, and the place behind it; nothing is unpacked."""
        n, n_bits, width = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        n_low = -(-n * width // 8)
        low = np.frombuffer(raw, np.uint8, n_low, at)
        at += n_low + -n_low % 8
        n_words = -(-max(n_bits, 1) // (BLOCK * WORD)) * BLOCK
        words = np.frombuffer(raw, "<u8", n_words, at)
        at += 8 * n_words
        n_before = n_words // BLOCK + 1
        before = np.frombuffer(raw, "<u4", n_before, at)
        at += 4 * n_before
        return cls(n, width, low, BitVector(words, n_bits, before)), at + -at % 8

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The numbers at these places of the sequence."""
        nth = np.asarray(nth, np.int64)
        out = (self.high.select(nth) - nth).astype(np.uint64) << np.uint64(self.width)
        for b in range(self.width):
            at = nth * self.width + b
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return out

    def first_at_least(self, value: int) -> int:
        """The first place whose number is ``value`` or more, or the length, by halving."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            if int(self.select(np.array([mid]))[0]) < value:
                lo = mid + 1
            else:
                hi = mid
        return lo
