"""Shared inputs: the given tables in the roles the operators expect, on both sides."""

from pyspark.sql import functions as F

from passarank.functions import text as X
from passarank.operators.embed import embed
from passarank.operators.passages import explode_passages
from passarank.plans.sizing import spread

OTHER = "unlisted"


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vector_queries(spark, folder):
    """Every vector is a sub-query of the request that its label names."""
    vectors = table(spark, folder, "embeddings")
    counts = vectors.groupBy("label").agg(F.count("*").cast("int").alias("n_queries"))
    return vectors.join(counts, "label").select(
        F.col("label").cast("string").alias("request_id"), F.col("vec_id").alias("query_idx"), "n_queries", "embedding"
    )


def vector_passages(spark, folder):
    """Every vector is a passage; its entity is the source of the document with the same number."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    return table(spark, folder, "embeddings").join(documents, "vec_id", "left").select(
        F.col("vec_id").cast("string").alias("passage_id"),
        F.coalesce("source", F.lit(OTHER)).alias("entity_id"),
        F.col("vec_id").cast("string").alias("feedback_id"),
        "embedding",
    )


def documents_as_feedback(spark, folder):
    return spread(table(spark, folder, "documents")).select(
        F.col("doc_id").cast("string").alias("feedback_id"), F.col("source").alias("entity_id"), "text"
    )


def document_passages(spark, folder):
    """Whole documents as passages of their source."""
    return documents_as_feedback(spark, folder).withColumnRenamed("feedback_id", "passage_id")


def sentence_passages(spark, folder):
    feedback = documents_as_feedback(spark, folder)
    return explode_passages(feedback, "entity_id", X.sentences(F.col("text")), parent="feedback_id")


def not_blank(texts):
    return F.filter(texts, lambda t: t != "")


def text_sub_queries(spark, folder):
    """Benchmark items as requests: sentences ask for the topic, lines for the evaluation."""
    from passarank.operators.requests import sub_queries

    items = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("request_id"),
        not_blank(X.sentences(F.col("text"))).alias("topic"),
        not_blank(X.lines(F.col("text"))).alias("evaluation"),
    )
    return sub_queries(items.withColumn("valid", F.lit(True)))


def entities(spark, folder):
    """Parts as entities, numbered like the sources of documents."""
    part = table(spark, folder, "part")
    return part.select(
        F.concat(F.lit("src"), F.col("p_partkey")).alias("entity_id"),
        F.col("p_name").alias("course_name"),
        F.col("p_brand").alias("course_no"),
        F.col("p_size").cast("string").alias("course_class"),
        F.col("p_type").alias("department"),
        F.concat_ws("\n", "p_name", "p_brand", "p_type").alias("info"),
    )


def embedded(df):
    return embed(df, "text")


# SQL fragments -----------------------------------------------------------------------------

NORMAL = r"trim(regexp_replace({0}, '[^ㄱ-ㅎㅏ-ㅣ가-힣a-zA-Z0-9]+', ' ', 'g'))"
SENTENCES = r"string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

SENTENCE_ROWS = f"""
    SELECT feedback_id, entity_id, pos, {NORMAL.format('s')} AS text, feedback_id || '#' || pos AS passage_id
    FROM (SELECT doc_id::VARCHAR AS feedback_id, source AS entity_id,
                 unnest({SENTENCES.format('text')}) AS s,
                 generate_subscripts({SENTENCES.format('text')}, 1) - 1 AS pos
          FROM documents)
    WHERE {NORMAL.format('s')} <> ''
"""

COSINE = """round(1 - CASE WHEN {a}_len * {b}_len > 0 THEN list_dot_product({a}_v, {b}_v) / ({a}_len * {b}_len)
                   ELSE 0 END, 6) + 0.0"""


def sql_vectors(source, key):
    """Hashed word counts at unit length, as the default encoder makes them, of ``source(key, text)``."""
    return f"""
    SELECT {key}, list(x ORDER BY slot) AS v, sqrt(list_dot_product(list(x ORDER BY slot), list(x ORDER BY slot))) AS len
    FROM (SELECT i.{key}, i.slot, coalesce(c.n / sqrt(sum(c.n * c.n) OVER (PARTITION BY i.{key})), 0)::FLOAT::DOUBLE AS x
          FROM (SELECT {key}, slot FROM {source}, (SELECT unnest(range(64)) AS slot)) i
          LEFT JOIN (SELECT {key}, slot, count(*) AS n
                     FROM (SELECT {key}, ('0x' || substr(md5(lower(w)), 1, 8))::BIGINT % 64 AS slot
                           FROM (SELECT {key}, unnest(regexp_extract_all(text, '[ㄱ-ㅎㅏ-ㅣ가-힣a-zA-Z0-9]+')) AS w FROM {source}))
                     GROUP BY ALL) c
          ON c.{key} = i.{key} AND c.slot = i.slot)
    GROUP BY {key}
    """


VECTOR_HITS = f"""
    q AS (SELECT label::VARCHAR AS request_id, vec_id AS query_idx, count(*) OVER (PARTITION BY label) AS n_queries,
                 embedding::DOUBLE[] AS q_v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS q_len
          FROM embeddings),
    p AS (SELECT vec_id::VARCHAR AS passage_id, coalesce(source, '{OTHER}') AS entity_id,
                 embedding::DOUBLE[] AS p_v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS p_len
          FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
    pairs AS (SELECT request_id, query_idx, n_queries, passage_id, entity_id, {COSINE.format(a='q', b='p')} AS distance
              FROM q, p),
    hits AS (SELECT *, row_number() OVER (PARTITION BY request_id, query_idx ORDER BY distance, passage_id) AS pos
             FROM pairs QUALIFY pos <= 256)
"""


def sql_kept(hits, out, threshold, topk=8):
    """CTEs that mark the hits that count, by the same rule in plain SQL."""
    return f"""
    {out}_m AS (SELECT *, distance > {threshold} AS over,
              row_number() OVER (PARTITION BY request_id, query_idx, entity_id, distance > {threshold}
                                 ORDER BY distance, passage_id) AS place,
              min(distance) OVER (PARTITION BY request_id, query_idx, entity_id) <= {threshold} AS passed FROM {hits}),
    {out}_n AS (SELECT *,
              count(DISTINCT CASE WHEN passed THEN entity_id END) OVER (PARTITION BY request_id, query_idx) AS seen,
              coalesce(sum(CASE WHEN over AND NOT passed AND place = 1 THEN 1 ELSE 0 END)
                OVER (PARTITION BY request_id, query_idx ORDER BY over, distance, entity_id, passage_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS added FROM {out}_m),
    {out} AS (SELECT * EXCLUDE (passed, seen, added) FROM {out}_n WHERE NOT over OR seen + added < {topk})
    """


def sql_ranked(kept, out, topk=8):
    """CTEs from kept hits to the best entities per request."""
    return f"""
    {out}_means AS (SELECT request_id, query_idx, entity_id, max(n_queries) AS n_queries,
                sum(round(distance * 1000000)::BIGINT)::DOUBLE / (count(*) * 1000000.0) AS mean_distance,
                min({{'over': over, 'distance': distance, 'entity': CASE WHEN over THEN entity_id ELSE '' END,
                     'passage_id': passage_id}}) AS first_hit
              FROM {kept} GROUP BY ALL),
    {out}_ranks AS (SELECT *, rank() OVER (PARTITION BY request_id, query_idx ORDER BY mean_distance) AS rank
              FROM {out}_means),
    {out}_fused AS (SELECT request_id, entity_id, round(sum(1.0::DOUBLE / rank) / max(n_queries), 12) AS score,
                min({{'query_idx': query_idx, 'first_hit': first_hit}}) AS first_seen
              FROM {out}_ranks GROUP BY ALL),
    {out} AS (SELECT request_id, entity_id, score,
                row_number() OVER (PARTITION BY request_id ORDER BY score DESC, first_seen) AS place
              FROM {out}_fused QUALIFY place <= {topk})
    """
