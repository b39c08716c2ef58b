"""Substring dedup: word windows that occur earlier in the corpus, by compressed word indexes per shard.

Every window names an anchor, the five words in it with the smallest hash, and windows in a row with the
same anchor make a piece. Equal windows have equal anchors, so pieces dealt out by anchor bring all places
of a window to one shard, and the work grows with the text, not with texts times shards.

Pieces are first known by hashes alone. A piece that occurred before in the same words is a repeat as a whole. Of
the others, those whose anchor occurs in no other words hold no repeat. What is left goes, with its words, to
a shard: an index of the Burrows-Wheeler transform in a wavelet matrix. The shard's texts are streamed
through it by backward search, which gives the matching statistics; where they reach the window's length, the
window's first place decides whether it is a repeat.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passarank.llm import kernels, wordspans
from passarank.llm.common import placed
from passarank.llm.fmindex import Index
from passarank.plans.sizing import durable

WINDOW, GRAM = 20, 5
SHARD_WORDS = 1 << 20
# An anchor with more different pieces is taken apart into single windows.
CROWDED = 5_000
# Pieces of one sorted range; the ranges grow in number with the pieces.
RANGE_PIECES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x2545F4914F6CDD1D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

PLACE = "doc long, file_key long, row_no long, start long"
_ORDER = ["lacks_id", "doc", "file_key", "row_no", "start"]


def _grams(words, size):
    out = np.zeros(words.size, np.uint64)
    for j in range(size):
        out[: words.size - j] += kernels.mix64(words[j:] + np.uint64((j + 1) * int(_STEP) % (1 << 64)))
    return kernels.mix64(out)


def _leftmost_min(values, size):
    """Where the first of the smallest of ``size`` neighbours lies, from each value on."""
    at, have = np.arange(values.size), 1
    while have < size and have < values.size:
        step = min(have, size - have)
        later = at[step:]
        at = np.concatenate([np.where(values[later] < values[at[:-step]], later, at[:-step]), at[-step:]])
        have += step
    return at


def _powers(base, size):
    out = np.full(max(size, 1), base)
    out[0] = 1
    return np.cumprod(out)


def cut(words, borders, window, gram):
    """The pieces of all texts: first word, number of windows, hash of the anchor, hash of all words."""
    left = wordspans.left_in_text(borders)
    opens = left >= window
    if not opens.any():
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.int64),) * 2
    grams = _grams(words, gram)
    anchor = _leftmost_min(grams, window - gram + 1)
    # Where a text begins, the window before it, at the end of the last text, is not open.
    fresh = opens.copy()
    fresh[1:] &= ~opens[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(fresh)
    number = np.add.reduceat(opens.astype(np.int64), first)
    # Windows that are not open lie between pieces and count none, as each text ends with some.
    length = number + window - 1
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernels.mix64(words + _STEP) * _powers(_BASE, words.size))])
        whole = (sums[first + length] - sums[first]) * _powers(_INVERSE, words.size)[first]
        whole = kernels.mix64(whole + length.astype(np.uint64) * _STEP)
    return first, number, grams[anchor[first]].view(np.int64), whole.view(np.int64)


def _cutter(window, gram):
    """Arrow batches of placed texts to their pieces; a piece seen before in the slice is marked ``later``."""

    def pieces(batches):
        hasher = kernels.Words()
        for batch in batches:
            for start, stop in wordspans.slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                spans = wordspans.Spans(part.column("text"))
                first, number, key, whole = cut(spans.hashes(hasher), spans.borders, window, gram)
                owner = np.searchsorted(spans.borders, first, side="right") - 1
                columns = [part.column(name).take(pa.array(owner)) for name in ("doc", "file_key", "row_no")]
                lacks = np.asarray(columns[0].is_null())
                ids = columns[0].fill_null(0).to_numpy()
                begin = first - spans.borders[owner]
                order = np.lexsort((begin, columns[2].to_numpy(), columns[1].to_numpy(), ids, lacks, whole, key))
                later = np.zeros(first.size, bool)
                later[order[1:]] = (key[order][1:] == key[order][:-1]) & (whole[order][1:] == whole[order][:-1])
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(lacks), *map(pa.array, (begin, number.astype(np.int32), key, whole, later))],
                    ["doc", "file_key", "row_no", "lacks_id", "start", "windows", "key", "whole", "later"],
                )

    return pieces


def _sift(batches):
    """Sorted pieces without those that surely hold no repeat; ``later`` marks repeats as a whole.

    A first piece stays where another piece shares its anchor. At the edges of a batch the neighbours are not
    known, so it stays there as well; the index decides about all that stay.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, whole = batch.column("key").to_numpy(), batch.column("whole").to_numpy()
        later = np.zeros(key.size, bool)
        later[1:] = (key[1:] == key[:-1]) & (whole[1:] == whole[:-1])
        later[0] = last == (key[0], whole[0])
        last = key[-1], whole[-1]
        first = np.flatnonzero(~later)
        names = key[first]
        shared = (names == key[0]) | (names == key[-1])
        same = names[1:] == names[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        keep = later.copy()
        keep[first] = shared
        kept = batch.filter(pa.array(keep))
        yield kept.set_column(kept.schema.get_field_index("later"), "later", pa.array(later[keep]))


PIECES = "doc long, file_key long, row_no long, lacks_id boolean, start long, windows int, key long, whole long, later boolean"


def _sifted(pieces, name):
    """Pieces that are repeats as a whole (``later``) or may hold some, stored."""
    firsts = pieces.filter("not later")
    ranges = max(-(-firsts.count() // RANGE_PIECES), pieces.sparkSession.sparkContext.defaultParallelism)
    # Equal pieces lie in one range; those of a crowded anchor spread over several.
    dealt = firsts.repartitionByRange(ranges, "key", "whole").sortWithinPartitions("key", "whole", *_ORDER)
    return durable(dealt.mapInArrow(_sift, PIECES).unionByName(pieces.filter("later")), name)


RESULT = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    + [T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())]
)


def _outcome(text, covered):
    words = text.split()
    kept = b" ".join([w for w, c in zip(words, covered.tolist()) if not c] if covered is not None else words)
    removed = int(np.count_nonzero(covered)) if covered is not None else 0
    return len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode()


def _remover(window, whole):
    """Arrow batches of (doc, text, marks) to the outcome; marks are windows that are repeats."""
    names = [f.name for f in RESULT.fields if whole or f.name != "kept"]

    def remove(batches):
        for batch in batches:
            for start, stop in wordspans.slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                texts, marks = part.column("text"), part.column("marks")
                rows = []
                for number in range(part.num_rows):
                    text = (texts[number].as_py() or "").encode()
                    spots = marks[number].values
                    covered = None
                    if spots is not None and len(spots):
                        at = spots.field("start").to_numpy()
                        size = spots.field("windows").to_numpy().astype(np.int64)
                        edges = np.zeros(int((at + size).max()) + window, np.int64)
                        np.add.at(edges, at, 1)
                        np.add.at(edges, at + size + window - 1, -1)
                        covered = np.cumsum(edges)[:-1] > 0
                        covered = np.concatenate([covered, np.zeros(max(len(text.split()) - covered.size, 0), bool)])
                    rows.append(_outcome(text, covered))
                columns = list(zip(*rows)) if rows else [[]] * 4
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)][: len(names) - 1]
                yield pa.RecordBatch.from_arrays([part.column("doc"), *arrays], names)

    return remove


def _contents(window):
    """Arrow batches of (place, text, spots) to a row per spot with its words, from the first byte to the last."""

    def contents(batches):
        for batch in batches:
            for start, stop in wordspans.slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                spans = wordspans.Spans(part.column("text"))
                lists = part.column("spots")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(part.num_rows), sizes)
                spots = lists.flatten()
                at = spots.field("start").to_numpy() + spans.borders[owner]
                stop_at = at + spots.field("windows").to_numpy() + window - 2
                words = [spans.stretch(a, b) for a, b in zip(at.tolist(), stop_at.tolist())]
                places = [part.column(name).take(pa.array(owner)) for name in ("doc", "file_key", "row_no", "lacks_id")]
                fields = [spots.field(name) for name in ("start", "windows", "key", "crowded")]
                yield pa.RecordBatch.from_arrays(
                    [*places, *fields, pa.array(words, pa.binary())],
                    ["doc", "file_key", "row_no", "lacks_id", "start", "windows", "key", "crowded", "words"],
                )

    return contents


def _singles(window):
    """The windows of pieces with a crowded anchor, each a piece of its own known by a hash of its words."""

    def singles(batches):
        hasher = kernels.Words()
        for batch in batches:
            spans = wordspans.Spans(batch.column("words").cast(pa.string()))
            words = spans.hashes(hasher)
            number = np.diff(spans.borders) - window + 1
            owner = np.repeat(np.arange(batch.num_rows), number)
            inside = np.arange(owner.size) - np.repeat(np.cumsum(number) - number, number)
            at = spans.borders[owner] + inside
            whole = np.zeros(at.size, np.uint64)
            for j in range(window):
                whole = kernels.mix64(whole + words[at + j] * _BASE + _STEP)
            places = [batch.column(name).take(pa.array(owner)) for name in ("doc", "file_key", "row_no", "lacks_id")]
            begin = batch.column("start").to_numpy()[owner] + inside
            key = kernels.mix64(whole ^ _BASE).view(np.int64)
            columns = [pa.array(begin), pa.array(np.ones(at.size, np.int32)), pa.array(key), pa.array(whole.view(np.int64)), pa.array(np.zeros(at.size, bool))]
            yield pa.RecordBatch.from_arrays(
                [*places, *columns], ["doc", "file_key", "row_no", "lacks_id", "start", "windows", "key", "whole", "later"]
            )

    return singles


def _searcher(window):
    """A shard's pieces to those of their windows that occur earlier, as stretches of windows."""

    def search(table):
        batch = table.combine_chunks().to_batches()[0]
        batch = batch.set_column(batch.schema.get_field_index("doc"), "doc", batch.column("doc").fill_null(0))
        order = np.lexsort([np.asarray(batch.column(name)) for name in reversed(_ORDER)])
        batch = batch.take(pa.array(order))
        spans = wordspans.Spans(batch.column("words").cast(pa.string()))
        names, symbols = np.unique(spans.hashes(), return_inverse=True)
        # Pieces lie in order of their places, each behind a symbol 0 that no window holds.
        sizes = np.diff(spans.borders)
        owner = np.repeat(np.arange(sizes.size), sizes)
        text = np.zeros(symbols.size + sizes.size, np.int64)
        place = np.arange(symbols.size) + owner + 1
        text[place] = symbols + 1
        index = Index(text, names.size + 1, window)
        ends = place[np.arange(symbols.size) - spans.borders[owner] >= window - 1]
        length, low, high = index.statistics(text, ends, window)
        hit = np.flatnonzero(length >= window)
        starts = ends[hit] - window + 1
        repeated = starts > index.earliest(low[hit], high[hit])
        starts = starts[repeated]
        of = np.searchsorted(place[spans.borders[:-1]], starts, side="right") - 1
        begin = starts - place[spans.borders[:-1]][of] + batch.column("start").to_numpy()[of]
        fresh = np.ones(starts.size, bool)
        fresh[1:] = (of[1:] != of[:-1]) | (begin[1:] != begin[:-1] + 1)
        first = np.flatnonzero(fresh)
        windows = np.diff(np.append(first, starts.size)).astype(np.int32)
        pick = pa.array(of[first])
        keys = [batch.column(name).take(pick) for name in ("file_key", "row_no")]
        return pa.table([*keys, pa.array(begin[first], pa.int64()), pa.array(windows)], names=["file_key", "row_no", "start", "windows"])

    return search


def without_repeats(docs, window=WINDOW, id_col="doc_id", text_col="text", gram=GRAM, shard_words=SHARD_WORDS, crowded=CROWDED, whole=True):
    """Every document without the words of windows that occur earlier in the corpus.

    A window is ``window`` words of one document in a row; words are what lies between ASCII blanks. Its word
    sequence occurs earlier if it starts in a document with a smaller id, or earlier in the same one. Windows are
    judged on the input. Returns ``id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, if ``whole``,
    the ``kept`` words joined by blanks.

    Null and empty texts and those with fewer words than a window stay whole. Documents without an id come
    after all others; rows with equal ids are documents of their own, in the order of their files and rows, so
    the first of repeated rows stays. An empty table gives no rows; other columns are not read. One very
    long text is held with some 100 bytes per word; its pieces go to many shards.

    A shard holds about ``shard_words`` words, shards grow in number with the pieces. Of an anchor with more than
    ``crowded`` different pieces the windows are sorted one by one instead, so no shard grows with a
    frequent passage. The list of such anchors that is broadcast has at most one row per ``crowded`` pieces.
    """
    if not 1 < gram < window:
        raise ValueError("a window must be longer than an anchor")
    rows = placed(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")))
    rows = rows.select("row.doc", "row.text", "file_key", "row_no")
    pieces = durable(rows.mapInArrow(_cutter(window, gram), PIECES), "pieces")
    marks = _sifted(pieces, "sifted")

    firsts = marks.filter("not later")
    many = durable(firsts.groupBy("key").count().filter(F.col("count") > crowded).select(F.col("key").alias("_key"), F.lit(True).alias("_crowded")), "crowded")
    marked = marks.join(F.broadcast(many), F.col("key") == F.col("_key"), "left")
    spot = F.struct("start", "windows", "key", F.coalesce("_crowded", F.lit(False)).alias("crowded"))
    # All marks of a document, as many as its own words make.
    by_row = marked.groupBy("file_key", "row_no").agg(
        F.collect_list(F.when(F.col("later"), F.struct("start", "windows"))).alias("repeats"),
        F.collect_list(F.when(~F.col("later"), spot)).alias("spots"),
    )
    # Documents whose windows are all judged are done; the others wait for the shards.
    joined = durable(rows.join(by_row, ["file_key", "row_no"], "left").withColumn("lacks_id", F.col("doc").isNull()), "marked")
    waiting = joined.filter(F.size("spots") > 0)
    done = joined.filter(F.col("spots").isNull() | (F.size("spots") == 0))

    contents = durable(
        waiting.select("doc", "file_key", "row_no", "lacks_id", "text", "spots").mapInArrow(
            _contents(window),
            "doc long, file_key long, row_no long, lacks_id boolean, start long, windows int, key long, crowded boolean, words binary",
        ),
        "contents",
    )
    singles = _sifted(contents.filter("crowded").mapInArrow(_singles(window), PIECES), "singles").filter("later")
    plain = contents.filter("not crowded").drop("crowded")
    words = plain.agg(F.coalesce(F.sum(F.col("windows") + window), F.lit(0)).alias("words")).first()["words"]
    shards = max(-(-words // shard_words), 1)
    found = (
        plain.withColumn("shard", F.pmod(F.col("key"), F.lit(shards)))
        .groupBy("shard").applyInArrow(_searcher(window), "file_key long, row_no long, start long, windows int")
    )
    places = ["file_key", "row_no"]
    late = found.unionByName(singles.select(*places, "start", "windows"))
    late = late.groupBy(*places).agg(F.collect_list(F.struct("start", "windows")).alias("late"))
    settled = waiting.join(late, places, "left").select("doc", "text", F.concat("repeats", F.coalesce("late", F.expr("array()"))).alias("marks"))
    done = done.select("doc", "text", F.coalesce("repeats", F.expr("cast(array() as array<struct<start: bigint, windows: int>>)")).alias("marks"))
    result = RESULT if whole else T.StructType([f for f in RESULT.fields if f.name != "kept"])
    return done.unionByName(settled).mapInArrow(_remover(window, whole), result)
