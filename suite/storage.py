"""Writes that are read back: tables, replaced children, nested export, collections."""

import uuid

from pyspark.sql import functions as F

from passarank.plans.sizing import scratch_path
from passarank.schemas import PAGE
from passarank.sources import collections, nested, pages, tables
from suite import common as C
from suite.registry import Registry

register = Registry()


@register("SELECT page_id, url, md5(html) AS html_md5 FROM pages")
def landed_pages(spark, folder):
    path = scratch_path(spark, "pages")
    pages.write_pages(C.table(spark, folder, "pages"), path)
    return pages.read_pages(spark, path).select("page_id", "url", F.md5("html").alias("html_md5"))


@register("SELECT page_id, url, length(html) AS n_chars FROM pages UNION ALL SELECT -1 - doc_id, source, length(text) FROM documents")
def append_entities(spark, folder):
    """A table made from its schema, made again without effect, filled by two appends."""
    path, name = scratch_path(spark, "entities"), f"entities_{uuid.uuid4().hex}"
    tables.create_if_absent(spark, name, PAGE, path)
    tables.create_if_absent(spark, name, PAGE, path)
    tables.append(C.table(spark, folder, "pages"), path)
    more = C.table(spark, folder, "documents").select((-1 - F.col("doc_id")).alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))
    tables.append(more, path)
    spark.sql(f"DROP TABLE {name}")  # only the name: the rows lie outside the warehouse
    return tables.scan(spark, path, PAGE).select("page_id", "url", F.length("html").alias("n_chars"))


REPLACED = """
    SELECT doc_id, quality, toxic FROM labels ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'fr') USING (doc_id)
    UNION ALL SELECT doc_id, 1, 0 FROM documents WHERE lang = 'fr' AND n_chars > 1000
"""


def _relabelled(spark, folder):
    """French documents get new labels if they are long, and lose theirs if not."""
    labels, documents = C.table(spark, folder, "labels"), C.table(spark, folder, "documents")
    parents = documents.filter("lang = 'fr'")
    return labels, parents, parents.filter("n_chars > 1000").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))


@register(REPLACED)
def replace_children(spark, folder):
    """To a fresh path."""
    labels, parents, fresh = _relabelled(spark, folder)
    path = scratch_path(spark, "labels")
    tables.store(tables.replace_children(labels, parents, fresh, "doc_id"), path)
    return tables.scan(spark, path, labels.schema)


@register(REPLACED)
def replace_children_in_place(spark, folder):
    """In the buckets concerned."""
    labels, parents, fresh = _relabelled(spark, folder)
    path = scratch_path(spark, "labels")
    tables.store_children(labels, path, "doc_id", buckets=64)
    tables.replace_stored_children(spark, path, labels.schema, parents, fresh, "doc_id")
    return tables.scan_children(spark, path, labels.schema, "doc_id")


@register("""
    SELECT 1 AS version, doc_id, quality, toxic FROM labels
    UNION ALL SELECT 2, doc_id, quality, toxic FROM labels WHERE doc_id % 3 <> 0
    UNION ALL SELECT 3, doc_id, quality, toxic FROM labels WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 1
    UNION ALL SELECT 3, doc_id, 7, 7 FROM labels WHERE doc_id % 4 = 1
""")
def replaced_versions(spark, folder):
    """Children replaced twice: all three versions."""
    labels, path = C.table(spark, folder, "labels"), scratch_path(spark, "labels")
    tables.store_children(labels, path, "doc_id", buckets=16)
    third, fourth = labels.filter("doc_id % 3 = 0"), labels.filter("doc_id % 4 = 1")
    tables.replace_stored_children(spark, path, labels.schema, third, third.limit(0), "doc_id")
    fresh = fourth.select("doc_id", F.lit(7).cast("int").alias("quality"), F.lit(7).cast("int").alias("toxic"))
    tables.replace_stored_children(spark, path, labels.schema, fourth, fresh, "doc_id")
    versions = [tables.scan_children(spark, path, labels.schema, "doc_id", n).select(F.lit(n).alias("version"), "*") for n in (1, 2, 3)]
    return versions[0].unionByName(versions[1]).unionByName(versions[2])


def _nested_customers(spark, folder, per_line=None):
    """Customers with their orders; those with a debt have no stat."""
    customers, orders = C.table(spark, folder, "customer"), C.table(spark, folder, "orders")
    parents = customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("course_name"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("room"))
    children = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("course_id"), F.col("o_orderpriority").alias("text"))
    stats = customers.filter("c_acctbal >= 0").select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("course_id"), F.col("c_nationkey").alias("attendance")
    )
    return nested.nest(parents, children, stats, per_line=per_line)


CHILDREN_SQL = """
    SELECT o_custkey, list({'id': o_orderkey, 'course_id': o_custkey, 'text': o_orderpriority} ORDER BY o_orderkey) AS reviews
    FROM orders GROUP BY o_custkey
"""


@register(f"""
    SELECT c_custkey AS id,
           CASE WHEN c_acctbal >= 0 THEN
             to_json({{'id': c_custkey, 'course_name': c_name, 'room': nullif(c_mktsegment, 'BUILDING'),
                       'review_stat': {{'id': c_custkey, 'course_id': c_custkey, 'attendance': c_nationkey}}, 'reviews': coalesce(reviews, [])}})::VARCHAR
           ELSE to_json({{'id': c_custkey, 'course_name': c_name, 'room': nullif(c_mktsegment, 'BUILDING'), 'reviews': coalesce(reviews, [])}})::VARCHAR
           END AS json
    FROM customer LEFT JOIN ({CHILDREN_SQL}) ON o_custkey = c_custkey
""")
def nested_export(spark, folder):
    return nested.as_json(_nested_customers(spark, folder)).select("id", "json")


@register("""
    WITH placed AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders),
         lists AS (SELECT o_custkey, place // 3 AS part, list({'id': o_orderkey, 'course_id': o_custkey, 'text': o_orderpriority} ORDER BY o_orderkey) AS reviews
                   FROM placed GROUP BY ALL)
    SELECT c_custkey AS id, coalesce(part, 0) AS part,
           CASE WHEN c_acctbal >= 0 THEN
             to_json({'id': c_custkey, 'course_name': c_name, 'room': nullif(c_mktsegment, 'BUILDING'), 'part': coalesce(part, 0),
                      'review_stat': {'id': c_custkey, 'course_id': c_custkey, 'attendance': c_nationkey}, 'reviews': coalesce(reviews, [])})::VARCHAR
           ELSE to_json({'id': c_custkey, 'course_name': c_name, 'room': nullif(c_mktsegment, 'BUILDING'), 'part': coalesce(part, 0),
                         'reviews': coalesce(reviews, [])})::VARCHAR
           END AS json
    FROM customer LEFT JOIN lists ON o_custkey = c_custkey
""")
def nested_export_parts(spark, folder):
    """At most three orders a line."""
    lines = nested.as_json(_nested_customers(spark, folder, per_line=3))
    return lines.select("id", F.col("part").cast("long").alias("part"), "json")


@register("""
    WITH child AS (SELECT doc_id AS id, try_cast(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS course_id, text, coalesce(strlen(text), 0) AS size FROM documents),
         cut AS (SELECT *, (sum(size) OVER (PARTITION BY course_id ORDER BY id) - size) // 20000 AS cut FROM child WHERE course_id IS NOT NULL),
         part AS (SELECT *, dense_rank() OVER (PARTITION BY course_id ORDER BY cut) - 1 AS part FROM cut)
    SELECT p_partkey AS id, CAST(coalesce(part, 0) AS INT) AS part, CAST(count(c.id) AS INT) AS n_reviews, min(c.id) AS first_id,
        md5(coalesce(string_agg(text, '' ORDER BY c.id), '')) AS texts_md5
    FROM (SELECT p_partkey FROM part_table) p LEFT JOIN part c ON course_id = p_partkey GROUP BY ALL
""".replace("FROM part_table", "FROM parts").replace("WITH child", "WITH parts AS (FROM main.part), child"))
def nested_export_bytes(spark, folder):
    """Lines of some 20,000 bytes of text, whatever the number of children."""
    documents, part = C.table(spark, folder, "documents"), C.table(spark, folder, "part")
    children = documents.select(F.col("doc_id").alias("id"), F.regexp_extract("source", r"(\d+)", 1).try_cast("long").alias("course_id"), "text")
    parents = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("course_name"))
    stats = part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("course_id"))
    lines = nested.nest(parents, children, stats, line_bytes=20_000)
    return lines.select(
        "id", "part", F.size("reviews").alias("n_reviews"), F.array_min("reviews.id").alias("first_id"),
        F.md5(F.array_join("reviews.text", "")).alias("texts_md5"),
    )


@register("""
    SELECT c_custkey AS id, c_name AS course_name, CASE WHEN c_acctbal >= 0 THEN c_nationkey END::DOUBLE AS attendance, o_orderkey AS review_id, o_orderpriority AS text
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey
""")
def nested_scan(spark, folder):
    """The export written as JSON lines, read with its schema and flattened."""
    path = scratch_path(spark, "export")
    nested.write_export(_nested_customers(spark, folder, per_line=nested.LINE_CHILDREN), path)
    back = nested.read_export(spark, path)
    return back.select("id", "course_name", "review_stat.attendance", F.explode_outer("reviews").alias("review")).select(
        "id", "course_name", "attendance", F.col("review.id").alias("review_id"), "review.text"
    )


@register(f"SELECT passage_id, entity_id, feedback_id, text FROM ({C.SENTENCE_ROWS})")
def collection_rebuild(spark, folder):
    """Embedded sentences written twice to the same collection and read back."""
    path = scratch_path(spark, "collection")
    passages = C.sentence_passages(spark, folder).select("passage_id", "entity_id", "feedback_id", "text")
    collections.rebuild(passages, path, add=C.embedded)
    collections.rebuild(passages, path, add=C.embedded)
    return collections.read_collection(spark, path, C.embedded(passages).schema).drop("embedding")


@register("""
    SELECT CASE c_custkey % 5 WHEN 1 THEN 'unreadable' WHEN 2 THEN 'unreadable' ELSE 'no id' END AS state,
        CASE c_custkey % 5 WHEN 1 THEN '{"id": ' || c_custkey || ', "course_name": "' || c_name WHEN 2 THEN '{"id": "' || c_name || '"}'
            ELSE '{"course_name": "' || c_name || '"}' END AS line
    FROM customer WHERE c_custkey % 5 IN (1, 2, 3)
    UNION ALL SELECT 'ok', c_custkey || ' ' || c_name FROM customer WHERE c_custkey % 5 IN (0, 4)
""")
def nested_rejected(spark, folder):
    """An export with lines cut off, ids of a wrong type and lines without an id: those, and what is sound."""
    number = F.col("c_custkey") % 5
    line = (
        F.when(number == 1, F.expr("concat('{\"id\": ', c_custkey, ', \"course_name\": \"', c_name)"))
        .when(number == 2, F.expr("concat('{\"id\": \"', c_name, '\"}')")).when(number == 3, F.expr("concat('{\"course_name\": \"', c_name, '\"}')"))
        .otherwise(F.expr("concat('{\"id\": ', c_custkey, ', \"course_name\": \"', c_name, '\"}')"))
    )
    path = scratch_path(spark, "export")
    C.table(spark, folder, "customer").select(line.alias("value")).write.text(path)
    sound = nested.read_export(spark, path).select(F.lit("ok").alias("state"), F.concat_ws(" ", "id", "course_name").alias("line"))
    return nested.rejected_lines(spark, path).select("state", "line").unionByName(sound)
