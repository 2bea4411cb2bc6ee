"""A compressed full-text index over word sequences: suffix order, Burrows-Wheeler transform, wavelet matrix, backward search.

All steps work on arrays, many positions or patterns at a time.
"""

import numpy as np

SIX, LOW = np.int64(6), np.int64(63)


class Bits:
    """Packed bits with counts of ones before each 64 of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` bits are set."""
        word = at >> SIX
        below = self.words[word] & ((np.uint64(1) << (at & LOW).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels, starts, every = [], np.zeros(top + 1, np.int64), np.arange(top + 1)
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            set_bits = (symbols >> shift & 1).astype(bool)
            bits = Bits(set_bits)
            self.levels.append((shift, bits))
            symbols = np.concatenate([symbols[~set_bits], symbols[set_bits]])
            ones = bits.ones(starts)
            starts = np.where(every >> shift & 1, bits.zeros + ones, starts - ones)
        # Where each symbol's own places begin on the last level.
        self.starts = starts

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first `at` places."""
        for shift, bits in self.levels:
            ones = bits.ones(at)
            at = np.where(symbols >> shift & 1, bits.zeros + ones, at - ones)
        return at - self.starts[symbols]


class FmIndex:
    """The index of texts (arrays of word numbers from 1), for patterns of `depth` words and one more.

    Suffixes are sorted by their first words only, a power of two above `depth`; backward search is exact up to there.
    """

    def __init__(self, texts: list[np.ndarray], depth: int):
        self.depth = depth
        sizes = np.array([len(x) + 1 for x in texts])
        self.symbols = np.concatenate([y for x in texts for y in (x, [0])]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        n, rank, width = len(self.symbols), self.symbols, 1
        while True:
            later = np.zeros(n, np.int64)
            later[: max(0, n - width)] = rank[width:] + 1
            key = rank * (int(rank.max()) + 2) + later
            order = np.argsort(key, kind="stable")
            changes = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = changes
            width *= 2
            if width <= depth:
                half, half_width = rank, width
            if width > depth + 1:
                break
        self.order = order
        # Rows whose suffixes share their first `depth` words form a group: both halves, which overlap, are equal.
        second = np.zeros(n, np.int64)
        gap = depth - half_width
        second[: n - gap] = half[gap:] + 1
        same = (np.diff(half[order]) == 0) & (np.diff(second[order]) == 0)
        self.group = np.concatenate([[0], np.cumsum(~same)])
        self.group_starts = np.concatenate([np.flatnonzero(np.concatenate([[True], ~same])), [n]])
        transformed = self.symbols[order - 1]
        counts = np.bincount(self.symbols, minlength=int(self.symbols.max()) + 2)
        self.first = np.cumsum(counts) - counts
        self.wavelet = WaveletMatrix(transformed, int(self.symbols.max()))

    def extended(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that begin with each symbol and then the pattern of the rows from low to high."""
        ranks = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        start = self.first[symbols]
        return start + ranks[: len(low)], start + ranks[len(low) :]

    def statistics(self, patterns: list[np.ndarray], least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each pattern, streamed from its end: the length of the match that begins at each place, up to depth, and the
        least value (of the texts, given as `least`) over its occurrences; the largest number where the match is shorter than depth."""
        values = np.minimum.reduceat(least[self.owner][self.order], self.group_starts[:-1])
        sizes = np.array([len(x) for x in patterns])
        by_size = np.argsort(-sizes, kind="stable")
        flat, starts = np.concatenate(patterns).astype(np.int64), np.cumsum(sizes) - sizes
        lengths, found = np.zeros(len(flat), np.int64), np.full(len(flat), np.iinfo(np.int64).max)
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.symbols), np.int64)
        length = np.zeros(len(patterns), np.int64)
        for step in range(int(sizes.max(initial=0))):
            by_size = by_size[: int(np.searchsorted(-sizes[by_size], -step, "left"))]
            at = starts[by_size] + sizes[by_size] - 1 - step
            a, b = self.extended(flat[at], low[by_size], high[by_size])
            longer = length[by_size] + 1
            gone = a >= b
            if gone.any():
                # No such match: it is taken up again from single words. Shorter matches than depth are not told apart.
                a[gone], b[gone] = self._again(flat, at[gone], starts[by_size[gone]] + sizes[by_size[gone]], longer, np.flatnonzero(gone))
            full = longer >= self.depth
            if full.any():
                # One word too many at the end: all rows that share the first `depth` words match.
                own = self.group[a[full]]
                a[full], b[full] = self.group_starts[own], self.group_starts[own + 1]
                longer[full] = self.depth
                found[at[full]] = values[own]
            low[by_size], high[by_size], length[by_size] = a, b, longer
            lengths[at] = longer
        cuts = np.cumsum(sizes)[:-1]
        return list(zip(np.split(lengths, cuts), np.split(found, cuts), strict=True))

    def _again(self, flat: np.ndarray, at: np.ndarray, ends: np.ndarray, longer: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest match, up to depth, that begins at each place: by bisection on its end."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.symbols), np.int64)
        most = np.minimum(ends - at, self.depth)
        short, long = np.zeros(len(at), np.int64), most.copy()
        while (short < long).any():
            middle = (short + long + 1) // 2
            a, b = self._find(flat, at, middle)
            ok = b > a
            short, long = np.where(ok, middle, short), np.where(ok, long, middle - 1)
        a, b = self._find(flat, at, short)
        longer[where] = short
        low[:], high[:] = a, b
        return low, high

    def _find(self, flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that begin with the `size` words from each place on."""
        a, b = np.zeros(len(at), np.int64), np.full(len(at), len(self.symbols), np.int64)
        for step in range(int(size.max(initial=0))):
            on = np.flatnonzero((step < size) & (a < b))
            if len(on):
                a[on], b[on] = self.extended(flat[at[on] + size[on] - 1 - step], a[on], b[on])
        return a, b
