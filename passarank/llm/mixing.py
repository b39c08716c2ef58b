"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The documents of a source are shuffled and laid end to end; every ``block_words`` words make a block.
The slots of the mix are golden-ratio points: slot i lies at the fractional part of i × 0.618…, and
the cumulative target shares tell whose slot it is. The k-th slot of a source takes its k-th block,
starting over after the last, until the source's target is met. Documents are in the mix because a slot took
their block, at the slot's place.
"""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passarank.llm.common import blocked_prefix, open_folder, placed, qualified
from passarank.plans.sizing import durable, scratch_path, small

WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
BLOCK_WORDS, MAX_SOURCES = 2048, 100_000
_CHUNK_BITS = 16
_GOLDEN = (5**0.5 - 1) / 2
_HEX = 15  # digits of a digest that order the documents of a source


def words(text):
    """Number of words: runs of anything but blanks and the control characters from tab to return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes, weights=WEIGHTS, share=SHARE, epochs=EPOCHS):
    """Target words of each source: (source, source_size) to (source, source_size, nth, target).

    Sources in code point order, null last, take the weights in turn. A target stops at ``epochs`` times
    the source's size; the excess is shared by weight among the others until none is above. Sources by
    size ÷ weight are capped up to some point, so running sums find that point at once.
    """
    numbered = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("nth", F.lit(len(weights))).cast("int") + 1)
    limits = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum(
        "weight"
    ).over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = limits.withColumn("level", level).withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("nth"), F.col("level")))).over(whole)
    target = F.when(F.col("capped") | free.isNull(), F.col("cap").cast("double")).otherwise(free["level"] * F.col("weight"))
    return levels.select("source", "source_size", "nth", target.alias("target"))


def _owners(borders):
    """Arrow batches of (slot) to (slot, chunk, nth): the source whose share holds the slot's point."""

    def deal(batches):
        for batch in batches:
            slot = batch.column(0).to_numpy()
            high, low = np.divmod(slot, 1 << _CHUNK_BITS)
            # In two steps, so that the fraction stays exact for very long schedules.
            point = ((high * ((_GOLDEN * (1 << _CHUNK_BITS)) % 1.0)) % 1.0 + low * _GOLDEN) % 1.0
            nth = np.minimum(np.searchsorted(borders, point, side="right"), len(borders) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(high), pa.array(nth)], ["slot", "chunk", "owner"])

    return deal


# Of this many times as many points as there are turns, every share holds as many as it has turns: golden-ratio
# points leave no interval of width w empty for more than (2 + _GOLDEN) / w of them in a row.
_POINTS = 3


def slots(spark, needed, max_sources=MAX_SOURCES):
    """Slots of the mix: (owner, turn, slot), a row per turn of every source.

    ``needed`` has ``nth`` and ``turns`` per source. The k-th point in a source's share is the slot of its k-th
    turn; points beyond its turns belong to nobody, so slots have gaps, most of them at the end, where sources whose
    points came late catch up. One number per source reaches the driver, at most ``max_sources``.
    """
    turns = {r["nth"]: r["turns"] for r in needed.filter("turns > 0").limit(max_sources + 1).collect()}
    if len(turns) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    shares = np.zeros(max(turns, default=0) + 1)
    for nth, count in turns.items():
        shares[nth] = count
    total = int(shares.sum())
    borders = np.cumsum(shares) / max(total, 1)
    parts = max(1, min(_POINTS * total >> _CHUNK_BITS, 100_000))
    dealt = spark.range(0, _POINTS * total, 1, parts).withColumnRenamed("id", "slot").mapInArrow(
        _owners(borders), "slot bigint, chunk bigint, owner bigint"
    )
    dealt = durable(dealt.withColumn("one", F.lit(1)), "slots")
    turn = blocked_prefix(dealt, "one", ["slot"], "chunk", ["owner"]).select("owner", F.col("before").alias("turn"), "slot")
    wanted = small(durable(needed.filter("turns > 0").select(F.col("nth").alias("of"), "turns"), "turns"))
    return turn.join(wanted, (F.col("owner") == F.col("of")) & (F.col("turn") < F.col("turns"))).select("owner", "turn", "slot")


def schedule(docs, id_col="doc_id", text_col="text", source_col="source", seed=20, block_words=BLOCK_WORDS):
    """When the mix takes each document: one row per document.

    Returns ``file_key`` and ``row_no`` (the row's place, see ``placed``), ``id``, ``size`` in words,
    ``source_size``, ``target`` of its source, and ``first`` and ``second``: the positions in the mix at
    which it is taken, null if it is not. Documents are taken whole: one whose middle lies before the
    source's target in the laid-out words, so a source misses its target by half a document at most
    and no document is taken more than twice. The order within a source comes from a digest of seed,
    id and text: reruns agree. Null sources are a source of their own; null and blank texts have
    no words, and like every text of a source without words they are not taken. Rows may repeat and
    count each. A huge source is summed in blocks of its order, never in one task.
    """
    return _schedule(placed(docs), id_col, text_col, source_col, seed, block_words)


def _schedule(rows, id_col="doc_id", text_col="text", source_col="source", seed=20, block_words=BLOCK_WORDS):
    """``schedule`` of placed rows."""
    spark = rows.sparkSession
    field = F.col("row")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(field[id_col].cast("string"), F.lit("")), F.coalesce(field[text_col], F.lit(""))))
    narrow = durable(
        rows.select(
            "file_key", "row_no", field[id_col].alias("id"), field[source_col].alias("source"), words(field[text_col]).alias("size"),
            F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("long").alias("place"),
        ),
        "sizes",
    )
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = durable(targets(sizes), "targets").withColumn("goal", F.round("target").cast("long"))
    goals = goals.withColumn("turns", F.ceil(F.col("goal") / block_words).cast("long"))
    dealt = durable(slots(spark, goals.select("nth", "turns")), "dealt")
    count = narrow.count()
    blocks = max(1, min(1 << _CHUNK_BITS, count // 20_000))
    leading = F.shiftright(F.col("place"), 4 * _HEX - _CHUNK_BITS)
    cut = narrow.withColumn("block", F.shiftright(leading * blocks, _CHUNK_BITS).cast("int"))
    laid = blocked_prefix(cut, "size", ["place", "id", "size", "file_key", "row_no"], "block", ["source"])
    listed = goals.select(F.col("source").alias("of"), "source_size", "target", "goal", "nth")
    laid = laid.join(small(listed), F.col("source").eqNullSafe(F.col("of")))
    middle = F.col("before") * 2 + F.col("size")  # in half words
    for name, epoch in (("first", 0), ("second", 1)):
        at = middle + F.col("source_size") * (2 * epoch)
        turn = F.when((F.col("size") > 0) & (at < F.col("goal") * 2), F.floor(at / (2 * block_words)).cast("long"))
        laid = laid.withColumn(f"turn_{name}", turn)
        taken = dealt.select(F.col("owner").alias(f"owner_{name}"), F.col("turn").alias(f"at_{name}"), F.col("slot").alias(f"slot_{name}"))
        # A document is taken because the slots hold its block: without a slot it is not.
        laid = laid.join(
            taken, (F.col("nth") == F.col(f"owner_{name}")) & (F.col(f"turn_{name}") == F.col(f"at_{name}")), "left"
        ).withColumn(name, F.col(f"slot_{name}"))
    return laid.select("file_key", "row_no", "id", "size", "source_size", "target", "first", "second")


# Rows of a file whose positions a task holds at once.
_STRETCH_BITS = 18


def mixed(docs, position="position", **settings):
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    ``position`` names a column for its place: order by it to read the mix in sequence. An input column of that
    name is dropped; with ``None`` there is no such column and all input columns stay, whatever their names.
    An empty table gives an empty mix.

    Texts are not moved. The positions are stored by file and stretch of rows, and the task that scans a stretch
    reads its positions, at any size of the schedule.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if position is None or c.lower() != position.lower()]
    rows = placed(docs.select(*[F.col(f"`{c}`") for c in names]))
    plan = durable(_schedule(rows, **settings), "schedule")
    takes = plan.select("file_key", "row_no", F.explode(F.array_compact(F.array("first", "second"))).alias("position"))
    takes = takes.withColumn("stretch", F.shiftright("row_no", _STRETCH_BITS))
    path = qualified(spark, scratch_path(spark, "takes"))
    dealt = takes.repartition("file_key", "stretch").sortWithinPartitions("file_key", "stretch", "row_no", "position")
    dealt.write.partitionBy("file_key", "stretch").parquet(path)
    schema = T.StructType([rows.schema["row"], T.StructField("position", T.LongType())])
    found = rows.select("row", "file_key", "row_no").mapInArrow(_taken(path), schema)
    return found.select("row.*", *([F.col("position").alias(position)] if position else []))


def _taken(path):
    """Arrow batches of (row, file_key, row_no) to the rows as often as they are taken, with their positions."""

    def positions(system, base, file, stretch):
        folder = f"{base}/file_key={file}/stretch={stretch}"
        listed = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        tables = [pq.read_table(f.path, filesystem=system, columns=["row_no", "position"], partitioning=None) for f in listed if f.path.endswith(".parquet")]
        if not tables:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        whole = pa.concat_tables(tables)
        return whole["row_no"].to_numpy(), whole["position"].to_numpy()

    def take(batches):
        system, base = open_folder(path)
        known, held = None, None
        for batch in batches:
            file, number = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            stretch = number >> _STRETCH_BITS
            edges = np.flatnonzero(np.concatenate([[True], (file[1:] != file[:-1]) | (stretch[1:] != stretch[:-1])])) if len(file) else []
            for start, stop in zip(edges, [*edges[1:], len(file)]):
                if known != (file[start], stretch[start]):
                    known = file[start], stretch[start]
                    held = positions(system, base, *known)
                first = np.searchsorted(held[0], number[start:stop], side="left")
                times = np.searchsorted(held[0], number[start:stop], side="right") - first
                which = np.repeat(np.arange(start, stop), times)
                at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(held[1][at])], ["row", "position"])

    return take
