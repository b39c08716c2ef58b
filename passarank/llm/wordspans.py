"""Words between ASCII blanks, found in the bytes of Arrow text columns."""

import numpy as np
import pyarrow as pa

from passarank.llm import kernels

# Bytes of text that one slice of a batch takes; one longer text makes a slice of its own.
SLICE_BYTES = 2 << 20
# Words that are hashed at once.
HASHED = 1 << 17
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def slices(column, limit=SLICE_BYTES):
    """Ranges of rows with about ``limit`` bytes of text each."""
    sizes = np.cumsum(np.diff(_offsets(column)))
    start = 0
    while start < len(column):
        done = sizes[start - 1] if start else 0
        stop = max(int(np.searchsorted(sizes, done + limit, side="right")), start + 1)
        yield start, stop
        start = stop


def _plain(column):
    return column.cast(pa.large_string()).fill_null("")


def _offsets(column):
    column = _plain(column)
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)


class Spans:
    """The words of a text column: byte ranges, the borders of each text among them, hashes."""

    def __init__(self, column):
        column = _plain(column)
        offsets = _offsets(column)
        held = column.buffers()[2] if len(column) else None
        self.data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and held.size else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]
        inside = ~_BLANK[self.data]
        edge = np.zeros(self.data.size + 1, bool)
        edge[self.offsets] = True
        after = np.ones(self.data.size + 1, bool)  # nothing of the same word lies before this byte
        after[1:-1] = ~inside[:-1]
        after |= edge
        self.starts = np.flatnonzero(inside & after[:-1])
        before = np.ones(self.data.size, bool)  # nothing of the same word lies behind this byte
        before[:-1] = ~inside[1:]
        before |= edge[1:]
        self.stops = np.flatnonzero(inside & before) + 1
        self.borders = np.searchsorted(self.starts, self.offsets)

    def hashes(self, hasher=None):
        hasher = hasher or kernels.Words()
        out = np.empty(self.starts.size, np.uint64)
        for at in range(0, out.size, HASHED):
            first, last = self.starts[at : at + HASHED], self.stops[at : at + HASHED]
            out[at : at + HASHED] = hasher.hash_spans(self.data, first, last - first)
        return out

    def stretch(self, first, last):
        """The bytes from word ``first`` up to the end of word ``last``."""
        return self.data[self.starts[first] : self.stops[last]].tobytes()

    def text(self, number):
        return self.data[self.offsets[number] : self.offsets[number + 1]].tobytes()


def left_in_text(borders):
    """How many words there are from each word to the end of its text, itself included."""
    return np.repeat(borders[1:], np.diff(borders)) - np.arange(borders[-1])
