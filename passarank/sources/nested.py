"""Nested export: one JSON line per parent with its optional stat and its children."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passarank.plans.prefix import running_total
from passarank.plans.sizing import BROADCAST_BYTES, durable, storing
from passarank.schemas import NESTED_COURSE

# Children a line for parents without a bound: at some 10 KB a text a line stays near 10 MB.
LINE_CHILDREN = 1_000
# Bytes that the first id of a line is taken for, when it is asked whether they fit a broadcast.
START_BYTES = 64


def _lists(children, by, child_id):
    """Children as one array per group, in the order of their ids."""
    record = F.struct(*[c for c in children.columns if c != "part"])
    ordered = F.array_sort(F.collect_list(F.struct(F.col(child_id).alias("_order"), record.alias("_child"))))
    return children.groupBy(*by).agg(ordered.alias("_children")).withColumn("reviews", F.col("_children._child")).drop("_children")


def nest(parents, children, stats, key="course_id", child_id="id", per_line=None, line_bytes=None, text="text"):
    """Parents with ``review_stat`` and ``reviews`` (empty if there are none).

    The caller chooses the layout, whatever the sizes. Without ``per_line`` or ``line_bytes`` every parent takes one
    line with all its children, which a row must be able to hold: only for parents with a bound. With ``per_line``
    a parent takes as many lines as its children fill, in the order of their ids; with ``line_bytes`` a line ends with
    the child whose ``text`` reaches the next multiple of that many bytes, so it holds less than that many
    beyond its last child. Every line then has a ``part``, numbered from 0 without gaps, so every parent has
    part 0. Children without a parent's key are in no line.
    """
    children = children.filter(F.col(key).isNotNull())  # else they gather in a group of their own
    stat = stats.select(F.col(key).alias("id"), F.struct(*stats.columns).alias("review_stat"))
    described = parents.join(stat, "id", "left")
    if per_line is None and line_bytes is None:
        lists = _lists(children, [key], child_id).withColumnRenamed(key, "id")
        lines, columns = described.join(lists, "id", "left"), [*parents.columns, "review_stat", "reviews"]
    else:
        placed = _placed(children, key, child_id, text, per_line, line_bytes)
        lists = _lists(placed, [key, "part"], child_id).withColumnRenamed(key, "id")
        # A copy of the parent goes to each of its lines: moving the lists by parent would gather a hot one's children again,
        # and they lie as the join wants them.
        numbers = placed.select(F.col(key).alias("id"), "part").distinct()
        first = described.join(numbers.filter("part = 0").select("id"), "id", "left_anti").withColumn("part", F.lit(0))
        first = first.withColumn("reviews", F.lit(None).cast(lists.schema["reviews"].dataType))
        columns = [*parents.columns, "part", "review_stat", "reviews"]
        lines = lists.join(described.join(numbers, "id"), ["id", "part"]).select(*columns).unionByName(first.select(*columns))
    none = F.array().cast(lists.schema["reviews"].dataType)
    return lines.withColumn("reviews", F.coalesce("reviews", none)).select(*columns)


def _placed(children, key, child_id, text, per_line, line_bytes):
    """The children with the ``part`` they go to; those without an id go to none.

    A line is known by its first id. Where lines are so few that these ids fit a broadcast, texts are not moved to learn their line.
    """
    parts = _parts(children, key, child_id, text, per_line, line_bytes)
    if per_line is None or children.count() // per_line * START_BYTES > BROADCAST_BYTES:
        return children.join(parts, [key, child_id]).select(*children.columns, "part")
    starts = parts.filter("part > 0").groupBy(key, "part").agg(F.min(child_id).alias("_start"))
    starts = durable(starts.groupBy(key).agg(F.sort_array(F.collect_list("_start")).alias("_starts")), "starts")
    most = starts.agg(F.coalesce(F.max(F.size("_starts")), F.lit(0)).alias("most")).first()["most"]
    part = _not_above(F.col("_starts"), F.col(child_id), most).alias("part")
    with_starts = children.filter(F.col(child_id).isNotNull()).join(F.broadcast(starts), key, "left")
    return with_starts.select(*children.columns, part)


def _not_above(items, value, most):
    """How many of at most ``most`` sorted items of an array are not above a value; found by halving, none for a missing array."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(most.bit_length()))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(items, at + step - 1) <= value, at + step).otherwise(at))


def _parts(children, key, child_id, text, per_line, line_bytes):
    """The line that each child id goes to: ``key, child_id, part``. Only ids and sizes are put in order, no texts.
    Children that repeat an id of their parent share its line."""
    if per_line is not None:
        ids = children.select(key, child_id).distinct()
        return running_total(ids, F.lit(1), "_place", [child_id], [key]).select(
            key, child_id, F.floor((F.col("_place") - 1) / per_line).cast("int").alias("part")
        )
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    sizes = children.groupBy(key, child_id).agg(F.sum(size).alias("_size"))
    total = running_total(sizes, F.col("_size"), "_total", [child_id], [key])
    cut = durable(total.select(key, child_id, F.floor((F.col("_total") - F.col("_size")) / line_bytes).alias("_cut")), "cuts")
    # A text longer than a line skips numbers; the few numbers of a parent are made dense.
    dense = cut.select(key, "_cut").distinct().withColumn(
        "part", (F.row_number().over(Window.partitionBy(key).orderBy("_cut")) - 1).cast("int")
    )
    return cut.join(dense, [key, "_cut"]).select(key, child_id, "part")


def as_json(nested):
    """Add ``json``: missing scalars stay as null, but a missing stat has no key at all."""

    def written(*left_out):
        return F.to_json(F.struct(*[c for c in nested.columns if c not in left_out]), {"ignoreNullFields": "false"})

    return nested.withColumn("json", F.when(F.col("review_stat").isNull(), written("review_stat")).otherwise(written()))


def write_export(nested, path, compression="gzip"):
    """JSON Lines, a file per task. Compressed files are each read by one task; with ``none`` large files are split."""
    writer = as_json(nested).select("json").write.mode("overwrite").option("compression", compression)
    with storing(nested.sparkSession):
        writer.option("zlib.compress.level", "BEST_SPEED").text(path)


CORRUPT = "_corrupt_line"


def _scan(spark, path, schema, indented):
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
    return reader.option("multiLine", indented).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_export(spark, path, schema=NESTED_COURSE, indented=False, key="id"):
    """Read an export; ``indented`` reads a single array over many lines, which is one task per file.

    Only sound lines come out; ``rejected_lines`` has the others.
    """
    nested = _scan(spark, path, schema, indented).filter(F.col(CORRUPT).isNull() & F.col(key).isNotNull())
    return nested.select(*schema.names).withColumn("part", F.coalesce("part", F.lit(0)))


def rejected_lines(spark, path, schema=NESTED_COURSE, key="id"):
    """The lines of an export that ``read_export`` leaves out: ``file``, ``line`` as it stands, and ``state``.

    ``unreadable`` lines are no JSON of the schema, a value of a wrong type included; lines with ``no id`` are, but name
    no parent. Blank lines count as neither. Nothing of a rejected line reaches the collections; mended lines
    can be written to a file of their own beside the others.
    """
    held = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", held, {"columnNameOfCorruptRecord": CORRUPT})
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), parsed.alias("record"))
    unreadable = F.col("record").isNull() | F.col(f"record.{CORRUPT}").isNotNull()
    state = F.when(unreadable, "unreadable").when(F.col(f"record.{key}").isNull(), "no id")
    return lines.filter(F.trim("line") != "").withColumn("state", state).filter("state is not null").select("file", "line", "state")
