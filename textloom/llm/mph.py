"""A minimal perfect hash over 64-bit keys, built and probed with numpy.

Keys are hashed into a bit array; those that are alone at their place are set, the others go to the next, smaller array. A
key's number is the count of set bits before its own. About 3.5 bits a key. A key that was not given gets any number or -1,
so users keep a fingerprint for each number.
"""

import struct

import numpy as np

from textloom.llm.common import mixed

SPREAD = 1.7
WORD = np.uint64(64)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes, self.before, total = levels, sizes, [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.before.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
        self.n = total

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        """keys: distinct."""
        rest, levels, sizes = keys.astype(np.uint64, copy=False), [], []
        while len(rest):
            size = max(64, int(len(rest) * SPREAD))
            at = mixed(rest, len(levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            packed = np.packbits(alone, bitorder="little")
            levels.append(np.pad(packed, (0, -len(packed) % 8)).view(np.uint64))
            sizes.append(size)
            rest = rest[~alone[at.astype(np.int64)]]
            if len(levels) > 200:
                raise ValueError("the keys are not distinct")
        return cls(levels, sizes)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, from 0 to n - 1; -1 for some of the keys that were not given."""
        keys = keys.astype(np.uint64, copy=False)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (bits, size, before) in enumerate(zip(self.levels, self.sizes, self.before, strict=True)):
            if not len(left):
                break
            at = mixed(keys[left], k) % np.uint64(size)
            word, bit = (at // WORD).astype(np.int64), at % WORD
            own = bits[word]
            here = (own >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(own & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[here]] = before[word[here]] + below[here]
            left = left[~here]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<I{len(self.sizes)}Q", len(self.sizes), *self.sizes)
        return head + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> "PerfectHash":
        (count,) = struct.unpack_from("<I", data)
        sizes = list(struct.unpack_from(f"<{count}Q", data, 4))
        at, levels = 4 + 8 * count, []
        for size in sizes:
            words = -(-size // 64)
            levels.append(np.frombuffer(data, np.uint64, words, at))
            at += 8 * words
        return cls(levels, sizes)
