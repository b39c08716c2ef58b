"""Near-duplicate classes by ProbMinHash sketches, banding and exact verification.

Similarity is the probability Jaccard similarity of five-word shingles weighted by their counts:
the chance that two documents draw the same shingle from a shared Poisson process. Every shingle
is a process with its weight as rate; each arrival picks a register, and a register keeps the
earliest. Arrivals are drawn round by round and a shingle ends when it is later than every register.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from passarank.llm import kernels
from passarank.llm.common import boxed
from passarank.plans.sizing import durable, small

SHINGLE, THRESHOLD, REGISTERS, BAND_ROWS = 5, 0.8, 168, 6
# Texts of one bucket that are compared in one task by the last comparison.
TILE_MEMBERS, TILE_OUTSIDERS = 512, 128
_DRAW = np.uint64(0xD1342543DE82EF95)


def registers(owner, values, weights, texts, size):
    """The winning shingle of each register, one row per text; texts without shingles hold zeros."""
    best = np.full(texts * size, np.inf)
    winner = np.zeros(texts * size, np.uint64)
    latest = np.full(texts, np.inf)
    time = np.zeros(values.size)
    rate = weights.astype(np.float64)
    turn, check = 0, 1
    while values.size:
        turn += 1
        with np.errstate(over="ignore"):
            drawn = kernels.mix64(values + np.uint64(turn * int(_DRAW) % (1 << 64)))
        time = time - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        slot = owner * size + (kernels.mix64(drawn ^ _DRAW) % np.uint64(size)).astype(np.int64)
        early = np.flatnonzero(time < best[slot])
        np.minimum.at(best, slot[early], time[early])
        won = early[best[slot[early]] == time[early]]
        winner[slot[won]] = values[won]
        if turn >= check:  # early termination
            check = max(turn + 1, turn * 5 // 4)
            active = np.unique(owner)
            latest[active] = best.reshape(texts, size)[active].max(axis=1)
            alive = time < latest[owner]
            owner, values, time, rate = owner[alive], values[alive], time[alive], rate[alive]
    return winner.reshape(texts, size)


def bands(winner, rows):
    """One hash per band of ``rows`` registers; the band's number is part of it."""
    texts, size = winner.shape
    grouped = winner.reshape(texts, size // rows, rows)
    out = np.zeros((texts, size // rows), np.uint64)
    for j in range(rows):
        out = kernels.mix64(out ^ grouped[:, :, j])
    return kernels.mix64(out + np.arange(size // rows, dtype=np.uint64) * _DRAW)


def _sketcher(shingle, size, rows):
    """Arrow batches of (key, id, text) to (key, id, bands); bands are null without a word."""

    def sketch(batches):
        words = kernels.Words()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for start, stop in kernels.slices(texts):
                hashes, borders = words.hashes(texts[start:stop])
                owner, values, counts = kernels.counted(*kernels.shingles(hashes, borders, shingle))
                number = stop - start
                found = bands(registers(owner, values, counts, number, size), rows).view(np.int64)
                has = np.diff(borders) > 0
                ends = np.concatenate([[0], np.cumsum(np.where(has, found.shape[1], 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, mask=np.concatenate([~has, [False]])), pa.array(found[has].ravel())
                )
                part = batch.slice(start, number)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["key", "id", "bands"])

    return sketch


def similarity(values_a, counts_a, values_b, counts_b):
    """Probability Jaccard similarity of two weighted sets given by sorted distinct values."""
    if not values_a.size or not values_b.size:
        return 0.0
    common, at_a, at_b = np.intersect1d(values_a, values_b, assume_unique=True, return_indices=True)
    if not common.size:
        return 0.0
    x, y = counts_a / counts_a.sum(), counts_b / counts_b.sum()
    cx, cy = x[at_a], y[at_b]
    ratio = cx / cy
    order = np.argsort(ratio)
    cx, cy, ratio = cx[order], cy[order], ratio[order]
    # For element i: shares of a where the ratio is at least its own, shares of b below it.
    first = np.searchsorted(ratio, ratio, side="left")
    below_x = np.concatenate([[0.0], np.cumsum(cx)])[first]
    below_y = np.concatenate([[0.0], np.cumsum(cy)])[first]
    only_b = 1.0 - cy.sum()
    return float((1.0 / ((1.0 - below_x) / cx + (below_y + only_b) / cy)).sum())


class Weighted:
    """The distinct shingles of texts with their counts, remembered by key up to a bounded number."""

    def __init__(self, shingle, shingles_held=1 << 21):
        self.words, self.shingle = kernels.Words(), shingle
        self.kept, self.room, self.limit = {}, shingles_held, shingles_held

    def __call__(self, key, text):
        """(values, counts, the values as a set if each occurs once); ``text`` is an Arrow scalar."""
        found = self.kept.get(key)
        if found is None:
            values, _ = kernels.shingles(*self.words.hashes([text.as_py()]), self.shingle)
            values, counts = np.unique(values, return_counts=True)
            found = values, counts, frozenset(values.tolist()) if (counts == 1).all() else None
            self.room -= values.size
            if self.room < 0:
                self.kept, self.room = {}, self.limit - values.size
            self.kept[key] = found
        return found


def alike(one, other):
    """Similarity of two results of ``Weighted``; with equal weights it is that of the plain sets."""
    if one[2] is not None and other[2] is not None:
        common = len(one[2] & other[2])
        return common / max(1, len(one[2]) + len(other[2]) - common)
    return similarity(*one[:2], *other[:2])


def _verifier(shingle, threshold):
    """Arrow batches of (a, text_a, b, text_b) to the pairs (a, b) that reach the threshold."""

    def verify(batches):
        weighted = Weighted(shingle)
        for batch in batches:
            a, text_a, b, text_b = batch.columns
            keep = [
                alike(weighted(x, text_a[i]), weighted(y, text_b[i])) >= threshold - 1e-12
                for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist()))
            ]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return verify


def _tile_linker(shingle, threshold):
    """Links between the members and the outsiders of one tile that have different roots.

    Roots that a link has joined are not compared again, as one link is enough to join them.
    """
    held = []

    def link(members, outsiders):
        if not held:
            held.append(Weighted(shingle))
        weighted, joined, found = held[0], {}, []

        def root(name):
            while name in joined:
                name = joined[name]
            return name

        sides = [
            [(key, own, weighted(key, texts[i])) for key, own, i in sorted(zip(t["key"].to_pylist(), t["root"].to_pylist(), range(t.num_rows)))]
            for t, texts in ((outsiders, outsiders["text"]), (members, members["text"]))
        ]
        # Which members hold each shingle. The outsider's weight on what both hold bounds the similarity.
        holder = np.repeat(np.arange(members.num_rows), np.array([w[0].size for _, _, w in sides[1]], np.int64))
        values = np.concatenate([w[0] for _, _, w in sides[1]] or [np.empty(0, np.uint64)])
        order = np.argsort(values, kind="stable")
        holder, values = holder[order], values[order]
        for key, own, mine in sides[0]:
            low, high = np.searchsorted(values, mine[0], side="left"), np.searchsorted(values, mine[0], side="right")
            sizes = high - low
            at = np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
            common = np.bincount(holder[at], np.repeat(mine[1] / mine[1].sum(), sizes), minlength=members.num_rows)
            for j in np.flatnonzero(common >= threshold - 1e-9).tolist():
                other, its, theirs = sides[1][j]
                if root(own) != root(its) and alike(mine, theirs) >= threshold - 1e-12:
                    joined[root(own)] = root(its)
                    found.append((min(key, other), max(key, other)))
        return pa.Table.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return link


def components(links):
    """The smallest key connected to each key of ``links`` (a, b): a table (key, root).

    Each round takes the least root among the neighbours and then the root's root, so that long
    chains halve. Every round is stored, which keeps the lineage short.
    """
    both = durable(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links"
    )
    roots = durable(both.groupBy(F.col("a").alias("key")).agg(F.min(F.least("a", "b")).alias("root")), "roots")
    while True:
        near = (
            both.join(roots.select(F.col("key").alias("b"), F.col("root").alias("near")), "b")
            .groupBy(F.col("a").alias("key")).agg(F.min("near").alias("near"))
        )
        lower = roots.join(near, "key").select("key", "root", F.least("root", "near").alias("low"))
        jumped = lower.join(
            roots.select(F.col("key").alias("low"), F.col("root").alias("far")), "low", "left"
        ).select("key", "root", F.least("low", "far").alias("low"))
        stored = durable(jumped, "roots")
        changed = stored.filter(F.col("root") != F.col("low")).limit(1).count()
        roots = stored.select("key", F.col("low").alias("root"))
        if not changed:
            return roots


def joined_roots(roots, links):
    """``roots`` after more links: only the roots that the links join go through ``components`` again."""
    of_a = roots.select(F.col("key").alias("a"), F.col("root").alias("root_a"))
    of_b = roots.select(F.col("key").alias("b"), F.col("root").alias("root_b"))
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")
    )
    moved = components(ends.filter("a != b").distinct())
    later = roots.join(moved.select(F.col("key").alias("root"), F.col("root").alias("to")), "root", "left")
    first = moved.join(roots.select("key"), "key", "left_anti")
    return durable(later.select("key", F.coalesce("to", "root").alias("root")).union(first.select("key", "root")), "roots")


def _tiles(open_rows):
    """Members and outsiders of open buckets, cut into tiles of bounded size.

    Outsiders are the members outside a bucket's largest root; each meets every member in one tile.
    """
    by_root = open_rows.groupBy("band", "root").count().groupBy("band")
    shape = durable(
        by_root.agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most"))
        .select(
            "band", "main",
            F.ceil(F.col("all") / TILE_MEMBERS).cast("int").alias("parts"),
            F.ceil((F.col("all") - F.col("most")) / TILE_OUTSIDERS).cast("int").alias("outer_parts"),
        ),
        "tiles",
    )
    rows = open_rows.join(shape, "band")

    def dealt(df, own, number, other, name):
        return df.select(
            "band", "key", "root", F.pmod(F.xxhash64("key", "band"), F.col(own)).cast("int").alias(number),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(name),
        )

    members = dealt(rows, "parts", "part", "outer_parts", "outer_part")
    return members, dealt(rows.filter("root != main"), "outer_parts", "outer_part", "parts", "part")


def near_duplicates(
    docs, id_col="doc_id", text_col="text", shingle=SHINGLE, threshold=THRESHOLD, registers=REGISTERS, band_rows=BAND_ROWS
):
    """One row per document with the class of near duplicates it belongs to.

    Returns ``id``, ``key`` (digest of the text, null for a null text), ``root`` (digest that stands for
    the class, null for a text without a word) and ``class_id``, the smallest id of the class. Texts are linked if their similarity is at least ``threshold``; a class is what
    links connect, and equal texts are always together. A text of fewer than ``shingle`` words has
    one shingle of all of them. Null texts and texts without any word are alone, each its own
    class. Null ids belong to the class of their text but never name it (a class of null ids
    only has a null class_id). Rows may repeat; every one comes back. Other columns are not looked at.

    Equal texts are merged first, so a huge group of copies is one key. Each band bucket then sends
    its members to one centre, the smallest key, not to each other. Buckets that still join different
    components get a second, band-dependent centre; last, the texts outside the largest component of
    a bucket are compared with all its texts, in tiles, so no link between two texts of a bucket is lost.
    """
    keyed = docs.select(
        F.unhex(F.md5(F.col(f"`{text_col}`").cast("binary"))).alias("key"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
    )
    id_type = keyed.schema["id"].dataType.simpleString()
    sketch = durable(
        keyed.select("key", "id", F.coalesce("text", F.lit("")).alias("text"))
        .mapInArrow(_sketcher(shingle, registers, band_rows), f"key binary, id {id_type}, bands array<bigint>"),
        "sketch",
    )
    entries = durable(
        sketch.filter(F.col("key").isNotNull() & F.col("bands").isNotNull())
        .groupBy("key").agg(F.first("bands").alias("bands"))
        .select("key", F.explode("bands").alias("band")),
        "bands",
    )
    shared = durable(entries.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1"), "shared")
    members = durable(entries.join(small(shared), "band"), "members")
    centres = durable(
        members.groupBy("band").agg(F.min("key").alias("centre"), F.min_by("key", F.xxhash64("band", "key")).alias("second")), "centres"
    )
    wanted = small(durable(members.select("key").distinct(), "wanted"))
    found = keyed.filter(F.col("key").isNotNull()).join(wanted, "key", "left_semi")
    texts = durable(found.groupBy("key").agg(F.first("text").alias("text")), "texts")
    verify = _verifier(shingle, threshold)

    def linked(pairs):
        left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
        joined = pairs.join(left, "a").join(right, "b").select("a", "text_a", "b", "text_b")
        return durable(joined.mapInArrow(verify, "a binary, b binary"), "verified")

    def ordered(one, other):
        return F.least(one, other).alias("a"), F.greatest(one, other).alias("b")

    def open_buckets():
        rooted = members.filter("members > 2").join(roots, "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
        apart = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
        return durable(rooted.join(apart.select("band"), "band"), "open")

    centred = members.join(centres.select("band", "centre"), "band").filter("key != centre")
    pairs = durable(centred.select(*ordered("key", "centre")).distinct(), "pairs")
    roots = components(linked(pairs))

    rows = open_buckets()
    seconds = rows.join(centres.select("band", "second"), "band").filter("key = second").select("band", "second", F.col("root").alias("second_root"))
    fresh = rows.join(seconds, "band").filter("root != second_root").select(*ordered("key", "second"))
    fresh = durable(fresh.distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    roots = joined_roots(roots, linked(fresh))

    rows = open_buckets()
    tile = ["band", "part", "outer_part"]
    columns = [*tile, "key", "root", "text"]
    inner, outer = (df.join(texts, "key").select(*columns).toDF(*columns).groupBy(*tile) for df in _tiles(rows))
    found = inner.cogroup(outer).applyInArrow(_tile_linker(shingle, threshold), "a binary, b binary")
    roots = joined_roots(roots, durable(found, "verified"))
    named = (
        sketch.filter(F.col("bands").isNotNull()).groupBy("key").agg(F.min("id").alias("least"))
        .join(roots, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    )
    names = named.groupBy("root").agg(F.min("least").alias("class_id"))
    named = durable(named.join(names, "root").select("key", "class_id", "root"), "names")
    return sketch.join(named, "key", "left").select(
        "id", "key", "root", F.when(F.col("bands").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id")
    )


def without_near_duplicates(docs, id_col="doc_id", text_col="text", **settings):
    """The documents with one of each class left: the one with the smallest id, then digest.

    Rows that agree in id and text are one document, of which one row stays. Null texts and texts
    without a word all stay. All columns are kept as they are, whatever their names; an empty table stays empty,
    and very long texts count whole.
    """
    classes = near_duplicates(docs, id_col, text_col, **settings).filter(F.col("root").isNotNull())
    each = durable(classes.groupBy("root", "id", "key").agg(F.count("*").alias("copies")), "classes")
    first = each.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "key", "copies")).alias("kept"))
    first = durable(first.select("kept.*"), "kept")

    def same(other):
        return (F.col("own_key") == other["key"]) & F.col("own_id").eqNullSafe(other["id"])

    gone = durable(each.join(first.select("id", "key"), (each["key"] == first["key"]) & each["id"].eqNullSafe(first["id"]), "left_anti"), "gone")
    own_key = F.unhex(F.md5(F.col(f"`{text_col}`").cast("binary")))
    keyed = docs.select(boxed(docs), F.col(f"`{id_col}`").alias("own_id"), own_key.alias("own_key"))
    gone = small(gone.select("id", "key"))
    kept = keyed.join(gone, same(gone), "left_anti")
    again = first.filter("copies > 1").select("id", "key")
    if again.limit(1).count():
        again = small(durable(again, "again"))
        single = kept.join(again, same(again), "left_semi").dropDuplicates(["own_id", "own_key"])
        kept = kept.join(again, same(again), "left_anti").union(single)
    return kept.select("row.*")
