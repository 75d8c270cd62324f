"""Compressed full-text index of whole numbers, and matching statistics against it.

The index keeps the Burrows-Wheeler transform of a text in a wavelet matrix: one bit
vector per bit of a symbol, packed, with a running count per 64 bits.  A pattern is
matched from its last symbol backwards; every step maps an interval of the sorted
suffixes to that of a pattern one symbol longer.  Many patterns are matched at once.
"""

import numpy as np

ONE = np.uint64(1)


class Bits:
    """A packed bit vector that counts the ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(8 - len(packed) % 8, dtype=np.uint8)])
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = self.words[word] & ((ONE << (at & 63).astype(np.uint64)) - ONE)
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """How often a symbol occurs before a place of a sequence."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(kinds - 1).bit_length())
        for bit in range(self.depth - 1, -1, -1):
            ones = (symbols >> bit) & 1
            self.levels.append(Bits(ones.astype(np.uint8)))
            self.zeros.append(len(symbols) - int(ones.sum()))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        self.start = self._down(np.arange(kinds), np.zeros(kinds, dtype=np.int64))

    def _down(self, symbol, at):
        for level, zeros, bit in zip(self.levels, self.zeros, range(self.depth - 1, -1, -1)):
            ones = level.ones(at)
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.start[symbol]


def suffix_order(text: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Starts of all suffixes, sorted; `parts` marks the ends of parts, each an end of its own."""
    rank = np.where(text == 0, parts, text + parts.max(initial=0) + 1)
    _, rank = np.unique(rank, return_inverse=True)
    n, step = len(text), 1
    while rank.max(initial=0) < n - 1:
        second = np.full(n, -1, dtype=np.int64)
        second[:n - step] = rank[step:]
        _, rank = np.unique(rank * (n + 1) + second + 1, return_inverse=True)
        step *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order


class FMIndex:
    """Index of several sequences of symbols from 1 up; `longest` bounds the matches asked for.

    Matches never run over the end of a sequence.  Besides the transform the index
    keeps, for every length up to `longest`, where the suffixes that agree in so many
    symbols begin and end, so that a match can be cut on its right.
    """

    def __init__(self, sequences: list, longest: int):
        self.longest = longest
        ends = np.cumsum([len(s) + 1 for s in sequences]) - 1
        text = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=np.int64)
        part = np.zeros(len(text), dtype=np.int64)
        begin = 0
        for number, (s, end) in enumerate(zip(sequences, ends)):
            text[begin:end], part[begin:end + 1], begin = s, number, end + 1
        self.kinds = int(text.max(initial=0)) + 1
        self.places = suffix_order(text, part)
        self.transform = WaveletMatrix(text[self.places - 1], self.kinds)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.kinds))])
        self.text, self.n = text, len(text)
        self._cuts()

    def _cuts(self):
        """common[p]: symbols the suffixes p-1 and p share; low, high: per length, the interval around p."""
        n, text, places = self.n, self.text, self.places
        common = np.zeros(n + 1, dtype=np.int32)
        alive = np.arange(1, n)
        for length in range(self.longest):
            a, b = places[alive - 1] + length, places[alive] + length
            ok = (a < n) & (b < n)
            alive, a, b = alive[ok], a[ok], b[ok]
            alive = alive[(text[a] == text[b]) & (text[a] > 0)]
            if not len(alive):
                break
            common[alive] = length + 1
        self.common = common
        at = np.arange(n + 1, dtype=np.int32)
        self.low = np.zeros((self.longest + 1, n + 1), dtype=np.int32)
        self.high = np.full((self.longest + 1, n + 1), n, dtype=np.int32)
        for length in range(1, self.longest + 1):
            border = common < length
            self.low[length] = np.maximum.accumulate(np.where(border, at, 0))
            after = np.minimum.accumulate(np.where(border, at, n)[::-1])[::-1]
            self.high[length, :-1] = after[1:]

    def matches(self, patterns: np.ndarray):
        """Matching statistics of rows of symbols, aligned right and filled with 0 on the left.

        For every symbol: how many from there on occur in the index, `longest` at most,
        and the interval of sorted suffixes that start with them.
        """
        rows, width = patterns.shape
        length = np.zeros(rows, dtype=np.int64)
        low, high = np.zeros(rows, dtype=np.int64), np.full(rows, self.n, dtype=np.int64)
        out = [np.zeros((rows, width), dtype=np.int32) for _ in range(3)]
        for column in range(width - 1, -1, -1):
            symbol = patterns[:, column]
            known = (symbol > 0) & (symbol < self.kinds)
            # A word the index does not have, or the filling, ends every match.
            lost = ~known
            length[lost], low[lost], high[lost] = 0, 0, self.n
            full = np.flatnonzero(known & (length == self.longest))
            length[full] -= 1
            at = low[full]
            low[full], high[full] = self.low[self.longest - 1, at], self.high[self.longest - 1, at]
            todo = np.flatnonzero(known)
            while len(todo):
                s = symbol[todo]
                a = self.first[s] + self.transform.rank(s, low[todo])
                b = self.first[s] + self.transform.rank(s, high[todo])
                found = a < b
                done = todo[found]
                low[done], high[done] = a[found], b[found]
                length[done] += 1
                # The others drop symbols on their right until the interval grows.
                todo = todo[~found]
                todo = todo[length[todo] > 0]  # a known symbol always follows the empty match
                shorter = np.maximum(self.common[low[todo]], self.common[high[todo]])
                shorter = np.minimum(shorter, length[todo] - 1)
                at = low[todo]
                length[todo] = shorter
                low[todo], high[todo] = self.low[shorter, at], self.high[shorter, at]
            for kept, now in zip(out, (length, low, high)):
                kept[:, column] = now
        return out

    def smallest(self, values: np.ndarray) -> np.ndarray:
        """Per sorted suffix: the smallest of `values` (one per place of the text) among all that
        agree with it in `longest` symbols."""
        ordered = values[self.places]
        starts = np.flatnonzero(self.common[:-1] < self.longest)
        least = np.minimum.reduceat(ordered, starts)
        return np.repeat(least, np.diff(np.append(starts, self.n)))
