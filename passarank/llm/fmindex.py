"""A compressed word index: the Burrows-Wheeler transform of a shard in a wavelet matrix of packed bits.

A symbol takes as many bits as the shard's vocabulary needs. Backward search narrows the interval of suffixes
that begin with a pattern, from its last word to its first; many patterns are searched at once.
"""

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """A packed bit vector with the number of ones before any place."""

    def __init__(self, bits):
        packed = np.zeros(-(-bits.size // 64) * 8 + 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: raw.size] = raw
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]])

    def ones(self, place):
        at = place >> 6
        low = (_ONE << (place & 63).astype(np.uint64)) - _ONE
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class Wavelet:
    """A sequence of symbols that counts any symbol before any place."""

    def __init__(self, symbols, distinct):
        self.levels = []
        self.depth = max(int(distinct - 1).bit_length(), 1)
        self.size = symbols.size
        for level in range(self.depth - 1, -1, -1):
            bits = (symbols >> level & 1).astype(bool)
            self.levels.append((Bits(bits), int(bits.size - bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.first = self._down(np.arange(distinct), np.zeros(distinct, np.int64))

    def _down(self, symbol, place):
        for depth, (bits, zeros) in enumerate(self.levels):
            ones = bits.ones(place)
            set_ = (symbol >> (self.depth - 1 - depth) & 1).astype(bool)
            place = np.where(set_, zeros + ones, place - ones)
        return place

    def count(self, symbol, place):
        """How often each symbol occurs before its place."""
        return self._down(symbol, place) - self.first[symbol]


def suffix_order(symbols, depth):
    """The suffixes in order of their first ``depth`` symbols or more, by prefix doubling."""
    rank, have = symbols.astype(np.int64), 1
    while True:
        ahead = np.zeros_like(rank)
        ahead[: rank.size - have] = rank[have:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + ahead
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty_like(rank)
        rank[order] = steps
        have *= 2
        if have >= depth or (steps.size and steps[-1] == steps.size - 1):
            return order


class Index:
    """Search in symbols 0 to ``distinct`` - 1 for patterns of at most ``depth`` symbols.

    The first symbol is 0, which patterns do not hold. The order of suffixes beyond ``depth`` symbols
    does not matter to such patterns.
    """

    def __init__(self, symbols, distinct, depth):
        self.order = suffix_order(symbols, depth + 1)
        # The last symbol comes before the 0 at the front, as in a circle, where no pattern meets it.
        self.wavelet = Wavelet(symbols[self.order - 1], distinct)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=distinct))])

    def statistics(self, symbols, ends, depth):
        """Matching statistics of the indexed text itself: for the ``depth`` symbols up to each end, how
        many of the last ones occur in another place too, and the suffixes (from, to) that begin with them.

        A search ends where its interval holds the place itself alone.
        """
        length = np.zeros(ends.size, np.int64)
        low, high = np.zeros(ends.size, np.int64), np.full(ends.size, symbols.size)
        alive = np.arange(ends.size)
        for step in range(depth):
            symbol = symbols[ends[alive] - step]
            start = self.smaller[symbol]
            new_low = start + self.wavelet.count(symbol, low[alive])
            new_high = start + self.wavelet.count(symbol, high[alive])
            several = new_high - new_low > 1
            alive, new_low, new_high = alive[several], new_low[several], new_high[several]
            if not alive.size:
                break
            low[alive], high[alive] = new_low, new_high
            length[alive] += 1
        return length, low, high

    def earliest(self, low, high):
        """The first place of the text among the suffixes of each interval; intervals are equal or apart."""
        starts, which = np.unique(low, return_inverse=True)
        stops = np.zeros_like(starts)
        stops[which] = high
        edges = np.stack([starts, stops], axis=1).ravel()
        found = np.minimum.reduceat(np.append(self.order, self.order.size), edges)[::2] if edges.size else edges
        return found[which]
