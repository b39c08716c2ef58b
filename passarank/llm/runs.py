"""Periodic runs of words by string synchronising sets.

At every dyadic scale t a set of positions is chosen by what follows them alone: position i is in the
set if, of the hashes of the t-word stretches that start at i to i + t, the smallest is the first or the
last. Stretches that are themselves highly periodic (period at most t / 3) do not take part. Two
neighbouring positions of the set with the same next 2t words, t to 2t - 1 words apart, propose their
distance as a period. A run of period q in [t, 2t) with four periods or more holds such a pair: only a
stretch with a period of at most t / 3 has no position, and such a small period would be the run's own.
Those small periods, left out here, are proposed at their own smaller scale. Proposals are extended word by
word to maximal runs, so every run that comes out is exact.

Names of stretches are hashes put together from the names of their halves. A stretch that occurs once in
its text starts no equal pair at any larger scale, so positions drop out early.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passarank.llm import kernels, wordspans

LEAST_WORDS, LEAST_PERIODS = 6, 4
_SEED = np.uint64(0xA24BAED4963EE407)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _combine(first, second):
    return kernels.mix64(kernels.mix64(first + _SEED) + second)


def _window_min(values, size):
    """The smallest of ``size`` neighbours, from each value on; the last ones see fewer."""
    best, have = values.copy(), 1
    while have < size:
        step = min(have, size - have)
        best[:-step] = np.minimum(best[:-step], best[step:])
        have += step
    return best


def _repeated(names, places):
    """Which names occur again, and how far the next occurrence is (0: none); places ascend."""
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    again = np.zeros(names.size, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    ahead = np.zeros(names.size, np.int64)
    ahead[order[:-1][same]] = np.diff(places[order])[same]
    return again, ahead


def proposals(words, borders):
    """(position, period) pairs of all texts; ``words`` are hashes, ``borders`` cut them into texts."""
    total = words.size
    owner = np.repeat(np.arange(borders.size - 1, dtype=np.uint64), np.diff(borders))
    left = wordspans.left_in_text(borders)
    longest = int(np.diff(borders).max(initial=0))
    places = np.arange(total)
    names = _combine(kernels.mix64(owner + np.uint64(1)), words)  # equal only within one text
    again, ahead = _repeated(names, places)
    places, names, ahead = places[again], names[again], ahead[again]
    half_at = half_names = half_ahead = None
    found, scale = [], 1
    while places.size and LEAST_PERIODS * scale <= longest:
        at = np.full(total + 1, -1, np.int64)
        at[places] = np.arange(places.size)
        # Contexts: the next 2t words, named where both halves are repeated ones.
        behind = np.where(left[places] >= 2 * scale, at[np.minimum(places + scale, total)], -1)
        has = np.flatnonzero(behind >= 0)
        contexts, spots = _combine(names[has], names[behind[has]]), places[has]
        again, next_ahead = _repeated(contexts, spots)
        has, contexts, spots, next_ahead = has[again], contexts[again], spots[again], next_ahead[again]
        order = kernels.mix64(names ^ _SEED)
        if half_at is not None:
            order[_highly_periodic(places, scale, half_at, half_names, half_ahead)] = _NEVER
        smallest = _window_min(order, scale + 1)[has]
        in_set = (smallest != _NEVER) & ((smallest == order[has]) | (smallest == order[np.minimum(has + scale, order.size - 1)]))
        # The set is a property of the context, so the next equal context is in it as well.
        pairs = in_set & (next_ahead >= scale) & (next_ahead < 2 * scale)
        if pairs.any():
            found.append(np.stack([spots[pairs], next_ahead[pairs], np.full(pairs.sum(), 2 * scale)]))
        half_at, half_names, half_ahead = at, names, ahead
        places, names, ahead = spots, contexts, next_ahead
        scale *= 2
    return np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)


def _highly_periodic(places, scale, half_at, half_names, half_ahead):
    """Which stretches of ``scale`` words have a period of at most a third of their length.

    Their first half comes again a period later, within the stretch, and so does the last half
    a period earlier; both together hold the period throughout.
    """
    half = scale // 2
    period = half_ahead[half_at[places]]
    close = np.flatnonzero((period > 0) & (period * 3 <= scale))
    last = half_at[places[close] + half]
    shifted = half_at[places[close] + half - period[close]]
    sound = (last >= 0) & (shifted >= 0)
    sound &= half_names[last] == half_names[shifted]
    return close[sound]


def _reach(words, first, second, limit, step):
    """How many words agree from ``first`` and ``second`` on in direction ``step``, at most ``limit``."""
    length = np.zeros(first.size, np.int64)
    open_, block = np.flatnonzero(limit > 0), 8
    while open_.size:
        room = limit[open_] - length[open_]
        span = np.arange(block)
        inside = span < room[:, None]
        offset = (length[open_][:, None] + span) * step
        a = np.where(inside, first[open_][:, None] + offset, 0)
        b = np.where(inside, second[open_][:, None] + offset, 0)
        differs = ~inside | (words[a] != words[b])
        stopped = differs.any(axis=1)
        length[open_] += np.where(stopped, differs.argmax(axis=1), block)
        open_ = open_[~stopped]
        block = min(block * 2, max(8, (1 << 20) // max(open_.size, 1)))
    return length


def runs(words, borders, least_words=LEAST_WORDS, least_periods=LEAST_PERIODS):
    """Maximal runs of all texts as arrays (start, length, period), by start, then period.

    ``least_periods`` must be at least 4: below it a run need not hold a pair of its scale.
    """
    if least_periods < LEAST_PERIODS:
        raise ValueError(f"runs of fewer than {LEAST_PERIODS} periods are not all found")
    place, period, seen = proposals(words, borders)
    order = np.lexsort((place, period))
    place, period, seen = place[order], period[order], seen[order]
    # Pairs of one period whose stretches share a period's length lie in the same run.
    stop = place + period + seen
    fresh = np.ones(place.size, bool)
    fresh[1:] = (period[1:] != period[:-1]) | (place[1:] > stop[:-1] - period[1:])
    place, period = place[fresh], period[fresh]
    text = np.searchsorted(borders, place, side="right") - 1
    back = _reach(words, place - 1, place + period - 1, place - borders[text], -1)
    ahead = _reach(words, place, place + period, borders[text + 1] - place - period, 1)
    start, length = place - back, back + ahead + period
    keep = length >= np.maximum(least_words, least_periods * period)
    found = np.unique(np.stack([start[keep], period[keep], length[keep]]), axis=1)
    return found[0], found[2], found[1]


def _periodic_tails(spans, ids, share):
    """Word numbers after the rewrite of every ``share``-th text: its tail repeats the tail's beginning.

    A text is rewritten if the checksum of its id divides by ``share``; what is left of the checksum
    chooses where the tail starts and how often it repeats.
    """
    take = np.arange(spans.starts.size)
    for number, checksum in enumerate(ids):
        size = int(spans.borders[number + 1] - spans.borders[number])
        if checksum is None or checksum % share or not size:
            continue
        rest = checksum // share
        tail = rest % size
        period = 1 + (size - tail) // (3 + rest % 8)
        first = int(spans.borders[number]) + tail
        take[first : first + size - tail] = first + np.arange(size - tail) % period
    return take


def _digest(data):
    return hashlib.sha256(data).hexdigest()


REPORT = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_runs", T.LongType())]
    + [T.StructField(name, T.LongType()) for name in ("start", "length", "period", "exponent_milli")]
    + [T.StructField(name, T.StringType()) for name in ("runs_sha256", "collapsed_sha256", "collapsed")]
    + [T.StructField("runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])))]
)


def periodic_runs(docs, id_col="doc_id", text_col="text", rewrite=None, whole=True):
    """Every document's runs of repeated word sequences, and its text without the repeats.

    A run is a maximal stretch of words with smallest period q, of at least six words and four periods.
    Words are what lies between ASCII blanks. Returns ``id``, ``n_words``, ``n_runs``, the run with the most
    periods (``start``, ``length``, ``period``, ``exponent_milli``; ties: smallest start, then period; null
    without a run), ``runs_sha256``, ``collapsed_sha256``, and, if ``whole``, the ``runs`` themselves and
    the ``collapsed`` text: the words that no run holds beyond its first q, joined by blanks.

    ``rewrite`` (a number) makes the tail of about every ``rewrite``-th text periodic first, chosen by the
    checksum of the id; documents without an id stay as they are. Null and empty texts have no words and no
    runs; repeated rows give a row each; other columns, whatever their names, are not read. Texts are
    worked on a slice of a batch at a time; one very long text is held with some 100 bytes per word.
    """
    report = REPORT if whole else T.StructType([f for f in REPORT.fields if f.name not in ("runs", "collapsed")])
    checksum = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) if rewrite else F.lit(None).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), checksum.alias("checksum"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_reporter(rewrite, whole), report)


def _reporter(rewrite, whole):
    names = [f.name for f in REPORT.fields if whole or f.name not in ("runs", "collapsed")]

    def report(batches):
        hasher = kernels.Words()
        for batch in batches:
            for start, stop in wordspans.slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                columns = _columns(part, hasher, rewrite, whole)
                yield pa.RecordBatch.from_arrays([part.column("id"), *[columns[n] for n in names[1:]]], names)

    return report


def _columns(part, hasher, rewrite, whole):
    spans = wordspans.Spans(part.column("text"))
    take = _periodic_tails(spans, part.column("checksum").to_pylist(), rewrite) if rewrite else np.arange(spans.starts.size)
    words = spans.hashes(hasher)[take]
    borders = spans.borders
    start, length, period = runs(words, borders)
    dropped = np.zeros(words.size + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    kept = np.cumsum(dropped[:-1]) == 0
    edges = np.searchsorted(start, borders)
    local = start - borders[np.searchsorted(borders, start, side="right") - 1]

    out = {name: [] for name in ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed", "runs")}
    for number in range(borders.size - 1):
        first, last = borders[number], borders[number + 1]
        mine = list(zip(*[a[edges[number] : edges[number + 1]].tolist() for a in (local, length, period)]))
        pieces = spans.text(number).split()
        if mine or (take[first:last] != np.arange(first, last)).any():
            pieces = [pieces[i] for i in (take[first:last][kept[first:last]] - first).tolist()]
        collapsed = b" ".join(pieces)
        top = _most_periods(mine)
        for name, value in zip(("start", "length", "period"), top or (None,) * 3):
            out[name].append(value)
        out["n_words"].append(int(last - first))
        out["n_runs"].append(len(mine))
        out["exponent_milli"].append(1000 * top[1] // top[2] if top else None)
        out["runs_sha256"].append(_digest("".join(f"{s},{n},{q}\n" for s, n, q in mine).encode()))
        out["collapsed_sha256"].append(_digest(collapsed))
        if whole:
            out["collapsed"].append(collapsed.decode())
            out["runs"].append([dict(zip(("start", "length", "period"), run)) for run in mine])
    kinds = {"runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "collapsed": pa.string()}
    kinds["runs"] = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
    return {name: pa.array(values, kinds.get(name, pa.int64())) for name, values in out.items() if whole or name not in ("runs", "collapsed")}


def _most_periods(found):
    """The run of the largest exact length / period; of equal ones the first."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best
