"""Vectorised text kernels that run inside tasks: words, shingles, sorted counts."""

import numpy as np

# Characters that one pass of the kernels holds; longer texts go through in pieces of this size.
PIECE = 1 << 19
_TO_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x):
    """Finaliser of the splitmix64 generator on an array of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _TO_MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _TO_MIX[1]
    return x ^ (x >> np.uint64(31))


def pieces(texts, limit=PIECE):
    """Lists of (text number, part) with about ``limit`` characters each, in order.

    A text longer than the limit is cut after white space, or in mid-word where there is none
    near the cut. A missing text counts as empty.
    """
    group, held = [], 0
    for number, text in enumerate(texts):
        text = text or ""
        start = 0
        while start < len(text) or start == 0:
            stop = min(len(text), start + limit)
            if stop < len(text):
                while stop > start + limit - 4096 and not text[stop - 1].isspace():
                    stop -= 1
                if not text[stop - 1].isspace():
                    stop = start + limit
            part = text[start:stop]
            if group and held + len(part) > limit:
                yield group
                group, held = [], 0
            group.append((number, part))
            held += len(part) + 1
            start = max(stop, 1)
    if group:
        yield group


def code_points(parts):
    """Code points of the parts, each followed by a line feed, and where each part ends."""
    codes = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.cumsum([len(p) + 1 for p in parts])


def classes(test):
    """A look-up of ``test`` (a method of str) for the first 65,536 characters."""
    return np.fromiter((test(chr(i)) for i in range(0x10000)), bool, 0x10000)


def is_class(codes, table, test):
    """Which code points pass ``test``; the few beyond the table are asked one by one."""
    found = table[np.minimum(codes, 0xFFFF)]
    far = np.flatnonzero(codes > 0xFFFF)
    if far.size:
        kinds, where = np.unique(codes[far], return_inverse=True)
        found[far] = np.fromiter((test(chr(c)) for c in kinds.tolist()), bool, kinds.size)[where]
    return found


class Words:
    """Hashes of the lower-cased words (runs of letters and digits) of many texts."""

    def __init__(self):
        self.table = classes(str.isalnum)
        self.powers = np.ones(1, np.uint64)

    def spans(self, codes):
        """First and one past the last code point of each word."""
        inside = np.zeros(codes.size + 2, np.int8)
        inside[1:-1] = is_class(codes, self.table, str.isalnum)
        step = np.diff(inside)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def power(self, longest):
        if self.powers.size < longest:
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.full(longest * 2, 0x100000001B3 * 2 + 1, np.uint64))
        return self.powers

    def hash_spans(self, codes, starts, lengths):
        """A 64-bit hash of the code points of each span."""
        if not starts.size:
            return np.empty(0, np.uint64)
        first = np.cumsum(lengths) - lengths
        place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
        letters = codes[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
        summed = np.add.reduceat(letters * self.power(int(lengths.max()))[place], first)
        return mix64(summed + lengths.astype(np.uint64) * _STEP)

    def hashes(self, texts):
        """Word hashes of all texts in order, and the borders of each text among them."""
        found, counts = [np.empty(0, np.uint64)], np.zeros(len(texts) + 1, np.int64)
        for group in pieces(texts):
            codes, ends = code_points([part.lower() for _, part in group])
            starts, stops = self.spans(codes)
            found.append(self.hash_spans(codes, starts, stops - starts))
            per_part = np.diff(np.searchsorted(starts, ends), prepend=0)
            np.add.at(counts, np.array([n for n, _ in group]) + 1, per_part)
        return np.concatenate(found), np.cumsum(counts)


def shingles(words, borders, size):
    """Hashes of ``size`` words in a row, and the borders of each text among them.

    A text with fewer words has one shingle of all its words; one without words has none.
    """
    total, lengths = words.size, np.diff(borders)
    left = np.repeat(borders[1:], lengths) - np.arange(total)  # words from here to the end of the text
    out = np.zeros(total, np.uint64)
    for j in range(size):
        if total > j:
            part = mix64(words[j:] + np.uint64((j + 1) * int(_STEP) % (1 << 64)))
            out[: total - j] += np.where(left[: total - j] > j, part, np.uint64(0))
    short = (lengths < size) & (lengths > 0)
    keep = left >= size
    keep[borders[:-1][short]] = True
    counts = np.where(short, 1, np.maximum(lengths - size + 1, 0))
    return mix64(out[keep]), np.concatenate([[0], np.cumsum(counts)])


def counted(values, borders):
    """Distinct values within each text with their counts: (text number, value, count), by text."""
    owner = np.repeat(np.arange(borders.size - 1, dtype=np.int64), np.diff(borders))
    if not values.size:
        return owner, values, np.empty(0, np.int64)
    # Sorting a key that depends on the text keeps equal values of one text together.
    salted = mix64(values ^ mix64((owner.astype(np.uint64) + np.uint64(1)) * _STEP))
    order = np.argsort(salted)
    runs = salted[order]
    first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    counts = np.diff(np.concatenate([first, [runs.size]]))
    picked = order[first]
    by_text = np.argsort(owner[picked], kind="stable")
    return owner[picked][by_text], values[picked][by_text], counts[by_text]


def slices(texts, limit=4 * PIECE):
    """Ranges of texts with about ``limit`` characters each; one longer text makes a range."""
    start, held = 0, 0
    for stop, text in enumerate(texts):
        held += len(text or "")
        if held >= limit:
            yield start, stop + 1
            start, held = stop + 1, 0
    if start < len(texts):
        yield start, len(texts)
