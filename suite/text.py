"""Text preparation, passages, vectors."""

from pyspark.sql import functions as F

from passarank.fixed_values import TITLE_SUFFIX
from passarank.functions import text as X
from passarank.operators import passages as P
from passarank.operators.embed import DIMENSIONS, embedder
from passarank.operators.embed import embed_once as encode_once
from passarank.plans.prefix import dense_ids
from passarank.plans.sizing import scratch_path
from passarank.sources.nested import LINE_CHILDREN, nest
from suite import common as C
from suite.registry import Registry

register = Registry()


@register(f"SELECT doc_id, {C.NORMAL.format('text')} AS text FROM documents")
def normalize_text(spark, folder):
    return C.table(spark, folder, "documents").select("doc_id", X.normalize(F.col("text")).alias("text"))


@register(r"SELECT doc_id, trim(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')) AS text FROM documents")
def normalize_any_language(spark, folder):
    return C.table(spark, folder, "documents").select("doc_id", X.normalize(F.col("text"), any_language=True).alias("text"))


@register(r"""
    SELECT page_id, split_part(split_part(nullif(regexp_extract(title, '^\s*(\S+)', 1), ''), '(', 1), '[', 1) AS prefix
    FROM (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)
    UNION ALL
    SELECT -1 - p_partkey, split_part(p_type || '(' || p_name, '(', 1) FROM part
""")
def title_prefix(spark, folder):
    """Titles of pages, and part types with a bracketed name."""
    pages = C.table(spark, folder, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))
    parts = C.table(spark, folder, "part").select((-1 - F.col("p_partkey")).alias("page_id"), F.concat("p_type", F.lit("("), "p_name").alias("title"))
    return pages.unionByName(parts).select("page_id", X.title_prefix(F.col("title")).alias("prefix"))


@register("SELECT p_partkey, p_name AS with_number, p_name AS without_number FROM part")
def strip_ordinal(spark, folder):
    numbered = F.concat(F.col("p_size"), F.lit(":  "), F.col("p_name"))
    return C.table(spark, folder, "part").select(
        "p_partkey", X.strip_ordinal(numbered).alias("with_number"), X.strip_ordinal(F.col("p_name")).alias("without_number")
    )


@register(f"""
    SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos
    FROM (SELECT doc_id, {C.SENTENCES.format('text')} AS s FROM documents)
""")
def sentence_split(spark, folder):
    return C.table(spark, folder, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


@register("""
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
""")
def line_split(spark, folder):
    return C.table(spark, folder, "documents").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "line"))


@register(f"SELECT passage_id, entity_id, feedback_id, pos, text FROM ({C.SENTENCE_ROWS})")
def sentence_passages(spark, folder):
    return C.sentence_passages(spark, folder).select("passage_id", "entity_id", "feedback_id", "pos", "text")


@register(f"""
    SELECT passage_id, (row_number() OVER (ORDER BY feedback_id::BIGINT, pos) - 1)::VARCHAR AS row_id FROM ({C.SENTENCE_ROWS})
""")
def dense_passage_ids(spark, folder):
    passages = C.sentence_passages(spark, folder).select("passage_id", F.col("feedback_id").cast("long").alias("doc_id"), "pos")
    return dense_ids(passages, ["doc_id", "pos"]).select("passage_id", "row_id")


def _courses(spark, folder):
    """Parts with a document as intro and a numbered list as syllabus; some have no intro."""
    intro = C.table(spark, folder, "documents").select(F.col("doc_id").alias("p_partkey"), F.col("text").alias("intro"))
    syllabus = F.concat(F.lit("1: "), F.col("p_type"), F.lit("\n2: "), F.col("p_brand"), F.lit("\n"))
    return C.table(spark, folder, "part").join(intro, "p_partkey", "left").withColumn("syllabus", syllabus)


@register(f"""
    WITH a AS (SELECT p_partkey, [split_part(p_name, ' ', 1) || '{TITLE_SUFFIX}']
                      || coalesce({C.SENTENCES.format('text')}, []) || [p_type, p_brand, ''] AS texts
               FROM part LEFT JOIN documents ON doc_id = p_partkey),
         e AS (SELECT p_partkey::VARCHAR AS entity_id, unnest(texts) AS s, generate_subscripts(texts, 1) - 1 AS pos FROM a)
    SELECT entity_id || '#' || pos AS passage_id, entity_id, pos, {C.NORMAL.format('s')} AS text FROM e
    WHERE {C.NORMAL.format('s')} <> ''
""")
def passage_concat(spark, folder):
    texts = P.entity_passages(F.col("p_name"), F.col("intro"), F.col("syllabus"))
    return P.explode_passages(_courses(spark, folder), "p_partkey", texts).select("passage_id", "entity_id", "pos", "text")


@register("""
    SELECT p_partkey, concat_ws(chr(10), p_name, text, p_type) AS document FROM part LEFT JOIN documents ON doc_id = p_partkey
""")
def entity_document(spark, folder):
    document = P.entity_document(F.col("p_name"), F.col("intro"), F.col("p_type"))
    return _courses(spark, folder).select("p_partkey", document.alias("document"))


def nested_parts(spark, folder):
    """Parts with the documents of the source of the same number nested inside."""
    parents = C.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("course_name"))
    children = C.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.regexp_extract("source", r"(\d+)", 1).try_cast("long").alias("course_id"), "text"
    )
    stats = C.table(spark, folder, "part").filter("p_size > 25").select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("course_id"), F.col("p_size").alias("satisfaction")
    )
    return nest(parents, children, stats, per_line=LINE_CHILDREN)


@register("""
    SELECT p_partkey::VARCHAR AS entity_id, doc_id::VARCHAR AS feedback_id, text
    FROM part JOIN documents ON source = 'src' || p_partkey
""")
def nonempty_feedback(spark, folder):
    """Feedback out of nested entities; entities without any are gone."""
    return P.feedback_table(nested_parts(spark, folder)).select("entity_id", "feedback_id", "text")


@register("SELECT p_partkey AS id, doc_id, text FROM part JOIN documents ON source = 'src' || p_partkey")
def nested_texts(spark, folder):
    """One field of every nested record."""
    nested = nested_parts(spark, folder)
    both = F.arrays_zip(P.nested_texts("reviews", "id").alias("doc_id"), P.nested_texts("reviews").alias("text"))
    return nested.select("id", F.inline(both).alias("doc_id", "text"))


@register(f"SELECT s.passage_id, s.feedback_id, s.entity_id, d.n_chars FROM ({C.SENTENCE_ROWS}) s JOIN documents d ON d.doc_id::VARCHAR = s.feedback_id")
def feedback_lineage(spark, folder):
    """Every sentence finds its document again by the id it carries."""
    documents = C.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("feedback_id"), "n_chars")
    passages = P.feedback_passages(C.documents_as_feedback(spark, folder))
    return passages.join(documents, "feedback_id").select("passage_id", "feedback_id", "entity_id", "n_chars")


@register("SELECT p_partkey::VARCHAR AS course_id, p_name AS course_name, p_brand AS course_no, p_size::VARCHAR AS credit FROM part")
def metadata_strings(spark, folder):
    renamed = C.table(spark, folder, "part").withColumnsRenamed(
        {"p_partkey": "course_id", "p_name": "course_name", "p_brand": "course_no", "p_size": "credit"}
    )
    return P.as_metadata(renamed, ["course_id", "course_name", "course_no", "credit"])


def _profile(vector):
    """Numbers that tell one vector from another, rounded."""
    moment = F.aggregate(
        F.transform(vector, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda total, x: total + x
    )
    return [
        F.size(F.filter(vector, lambda x: x != 0)).alias("n_nonzero"),
        F.round(moment, 4).alias("moment"),
        F.size(vector).alias("n_values"),
    ]


PROFILE = "list_count(list_filter(v, lambda x: x <> 0)) AS n_nonzero, round(list_dot_product(v, range(1, 65)::DOUBLE[]), 4) AS moment, len(v) AS n_values"


@register(f"WITH s AS ({C.SENTENCE_ROWS}), v AS ({C.sql_vectors('s', 'passage_id')}) SELECT passage_id, {PROFILE} FROM v")
def embed_passages(spark, folder):
    vectors = C.embedded(C.sentence_passages(spark, folder))
    return vectors.select("passage_id", *_profile(F.col("embedding")))


@register(f"WITH s AS ({C.SENTENCE_ROWS}), v AS ({C.sql_vectors('s', 'passage_id')}) SELECT passage_id, {PROFILE} FROM v")
def embed_once(spark, folder):
    """Every different text encoded once, those of the benchmark and of French documents already in an earlier call."""
    store, passages = scratch_path(spark, "vectors"), C.sentence_passages(spark, folder)
    french = C.table(spark, folder, "documents").filter("lang = 'fr'").select(F.col("doc_id").cast("string").alias("feedback_id"))
    encode_once(C.table(spark, folder, "benchmark"), store=store)
    encode_once(passages.join(french, "feedback_id"), store=store)
    return encode_once(passages, store=store).select("passage_id", *_profile(F.col("embedding")))


@register(f"WITH s AS (SELECT item_id, text FROM benchmark), v AS ({C.sql_vectors('s', 'item_id')}) SELECT item_id, {PROFILE} FROM v")
def embed_queries(spark, folder):
    """The same encoder as a column function."""
    vectors = C.table(spark, folder, "benchmark").select("item_id", embedder()(F.col("text")).alias("embedding"))
    return vectors.select("item_id", *_profile(F.col("embedding")))


assert DIMENSIONS == 64  # the SQL twins spell the size out
