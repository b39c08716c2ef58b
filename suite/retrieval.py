"""Search, fusion and two-stage recommendation."""

from pyspark.sql import functions as F

from passarank.functions.scores import cosine_distance
from passarank.operators import fusion as U
from passarank.operators import recommend as R
from passarank.operators.knn import nearest_passages
from passarank.operators.pruned import Cells, nearest_in_cells, store_cells
from passarank.plans.sizing import durable, scratch_path
from passarank.sources import collections
from suite import common as C
from suite.registry import Registry

register = Registry()
THRESHOLDS = (0.6, 0.75, 0.85)


@register(f"""
    WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS a_v,
                      sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS a_len FROM embeddings),
         f AS (SELECT label, a_v AS b_v, a_len AS b_len FROM v WHERE vec_id IN (SELECT min(vec_id) FROM v GROUP BY label))
    SELECT vec_id, {C.COSINE.format(a='a', b='b')} AS distance FROM v JOIN f USING (label)
""")
def cosine_distance_pairs(spark, folder):
    """Every vector against the first vector of its label."""
    vectors = C.table(spark, folder, "embeddings")
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return vectors.join(first, "label").select("vec_id", cosine_distance(F.col("embedding"), F.col("first")).alias("distance"))


HIT = "request_id, query_idx, pos, passage_id, entity_id, distance"
HIT_COLUMNS = HIT.split(", ")


@register(f"WITH {C.VECTOR_HITS} SELECT {HIT} FROM hits")
def cosine_knn(spark, folder):
    return nearest_passages(C.vector_queries(spark, folder), C.vector_passages(spark, folder)).select(*HIT_COLUMNS)


@register(f"WITH {C.VECTOR_HITS} SELECT {HIT} FROM hits WHERE pos <= 20")
def knn_pruned(spark, folder):
    """From a collection stored in cells, of which only those are read that can hold a hit."""
    path, passages = scratch_path(spark, "cells"), C.vector_passages(spark, folder)
    store_cells(passages, path, cells=16)
    hits = nearest_in_cells(C.vector_queries(spark, folder), Cells(spark, path, passages.schema), k=20)
    return hits.select(*HIT_COLUMNS)


@register(f"WITH {C.VECTOR_HITS} SELECT {HIT} FROM hits WHERE pos <= 10")
def knn_default_hits(spark, folder):
    """No number of hits given."""
    hits = nearest_passages(C.vector_queries(spark, folder), C.vector_passages(spark, folder), k=None)
    return hits.select(*HIT_COLUMNS)


CANDIDATES = "SELECT DISTINCT e.label::VARCHAR, d.source FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id AND l.toxic = 1 JOIN documents d ON d.doc_id = e.vec_id"


@register(f"""
    WITH {C.VECTOR_HITS},
    few AS (SELECT *, row_number() OVER (PARTITION BY request_id, query_idx ORDER BY distance, passage_id) AS place
            FROM pairs WHERE (request_id, entity_id) IN ({CANDIDATES}) QUALIFY place <= 256)
    SELECT request_id, query_idx, place AS pos, passage_id, entity_id, distance FROM few
""")
def knn_candidate_filter(spark, folder):
    """Each request may only see the sources of documents marked toxic under its label."""
    marked = C.table(spark, folder, "labels").filter("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    sources = C.table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("entity_id"))
    candidates = (
        C.table(spark, folder, "embeddings").select("vec_id", F.col("label").cast("string").alias("request_id"))
        .join(marked, "vec_id").join(sources, "vec_id").select("request_id", "entity_id")
    )
    hits = nearest_passages(C.vector_queries(spark, folder), C.vector_passages(spark, folder), candidates=candidates)
    return hits.select(*HIT_COLUMNS)


def _all_hits(spark, folder):
    """The hits with what fusion needs of them, which is what then moves to their sub-query."""
    hits = nearest_passages(C.vector_queries(spark, folder), C.vector_passages(spark, folder))
    return hits.select(*U.QUERY, "n_queries", "passage_id", "entity_id", "distance")


KEPT = "threshold, request_id, query_idx, passage_id, entity_id, distance, over"


@register(
    f"WITH {C.VECTOR_HITS}, "
    + ", ".join(C.sql_kept("hits", f"kept{i}", t) for i, t in enumerate(THRESHOLDS))
    + " UNION ALL ".join(
        f" SELECT {t}::DOUBLE AS threshold, request_id, query_idx, passage_id, entity_id, distance, over::INT AS over FROM kept{i}"
        for i, t in enumerate(THRESHOLDS)
    )
)
def threshold_fallback(spark, folder):
    """Three thresholds: nearly all fallback, mixed, nearly none. All hits move once, to their sub-query, for all of them."""
    hits = durable(_all_hits(spark, folder), "hits").repartition(*U.QUERY)
    parts = [
        U.kept_hits(hits, t).withColumns({"threshold": F.lit(t), "over": F.col("over").cast("int")}).select(*KEPT.split(", "))
        for t in THRESHOLDS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


KEPT_75 = f"WITH {C.VECTOR_HITS}, {C.sql_kept('hits', 'kept', 0.75)}"


def _kept(spark, folder):
    return U.kept_hits(_all_hits(spark, folder), 0.75)


@register(f"{KEPT_75}, {C.sql_ranked('kept', 'r')} SELECT request_id, query_idx, entity_id, mean_distance, rank, 1.0::DOUBLE / rank AS score FROM r_ranks")
def entity_mean_rank(spark, folder):
    ranked = U.reciprocal_ranks(U.entity_means(_kept(spark, folder)))
    return ranked.select("request_id", "query_idx", "entity_id", "mean_distance", "rank", "score")


@register(f"{KEPT_75}, {C.sql_ranked('kept', 'r')} SELECT request_id, entity_id, score, place FROM r")
def rank_fusion_topk(spark, folder):
    return U.rank_entities(_kept(spark, folder)).select("request_id", "entity_id", "score", "place")


@register(f"""{KEPT_75} SELECT request_id, entity_id, string_agg(passage_id, ',' ORDER BY query_idx, over, place) AS passages
    FROM kept WHERE over OR place <= 4 GROUP BY ALL""")
def supporting_map(spark, folder):
    """One map per request, an entry per entity; its entries as rows."""
    maps = U.supporting_map(U.supporting_examples(_kept(spark, folder)))
    rows = maps.select("request_id", F.explode("supporting").alias("entity_id", "passages"))
    return rows.select("request_id", "entity_id", F.array_join("passages", ",").alias("passages"))


@register(f"{KEPT_75} SELECT request_id, entity_id, query_idx, over::INT AS over, place, passage_id FROM kept WHERE over OR place <= 4")
def supporting_examples(spark, folder):
    examples = U.supporting_examples(_kept(spark, folder))
    return examples.select("request_id", "entity_id", "query_idx", F.col("over").cast("int").alias("over"), "place", "passage_id")


def _both_aspects(queries):
    return queries.withColumn("aspect", F.explode(F.array(F.lit("topic"), F.lit("evaluation"))))


def sql_blend(first, second, out):
    return f"""
    {out} AS (SELECT request_id, entity_id, a.score AS stage1_score, b.score AS stage2_score,
                 a.score * 0.65::DOUBLE + b.score * 0.35::DOUBLE AS score,
                 row_number() OVER (PARTITION BY request_id ORDER BY a.score * 0.65::DOUBLE + b.score * 0.35::DOUBLE DESC, b.place) AS place
          FROM {first} a JOIN {second} b USING (request_id, entity_id))
    """


@register(f"""
    WITH {C.VECTOR_HITS}, {C.sql_kept('hits', 'k1', 0.75)}, {C.sql_ranked('k1', 's1')},
    hits2 AS (SELECT *, row_number() OVER (PARTITION BY request_id, query_idx ORDER BY distance, passage_id) AS place2
              FROM pairs SEMI JOIN s1 USING (request_id, entity_id) QUALIFY place2 <= 256),
    {C.sql_kept('hits2', 'k2', 0.75)}, {C.sql_ranked('k2', 's2')}, {sql_blend('s1', 's2', 'b')}
    SELECT request_id, entity_id, stage1_score, stage2_score, score, place FROM b
""")
def two_stage_recommend(spark, folder):
    """Every vector asks in both aspects; the second stage searches the sources of the first."""
    passages = C.vector_passages(spark, folder)
    ranking, _ = R.recommend(_both_aspects(C.vector_queries(spark, folder)), passages, passages, threshold=0.75)
    return ranking.select("request_id", "entity_id", "stage1_score", "stage2_score", "score", "place")


# Text to result: benchmark items ask, documents and their sentences answer.
TEXT_STAGES = f"""
    items AS (SELECT item_id::VARCHAR AS request_id,
                     list_filter({C.SENTENCES.format('text')}, lambda t: t <> '') AS topic,
                     list_filter(string_split(text, chr(10)), lambda t: t <> '') AS evaluation FROM benchmark),
    sub AS (SELECT request_id, 'topic' AS aspect, len(topic) AS n_queries, unnest(topic) AS text,
                   generate_subscripts(topic, 1) - 1 AS query_idx FROM items
            UNION ALL
            SELECT request_id, 'evaluation', len(evaluation), unnest(evaluation),
                   generate_subscripts(evaluation, 1) - 1 FROM items),
    sub_text AS (SELECT DISTINCT text AS id, text FROM sub),
    sub_vec AS ({C.sql_vectors('sub_text', 'id')}),
    q AS (SELECT s.*, v.v AS q_v, v.len AS q_len FROM sub s JOIN sub_vec v ON v.id = s.text),
    docs AS (SELECT doc_id::VARCHAR AS passage_id, source AS entity_id, text FROM documents),
    doc_vec AS ({C.sql_vectors('docs', 'passage_id')}),
    p1 AS (SELECT docs.passage_id, entity_id, v AS p_v, len AS p_len FROM docs JOIN doc_vec USING (passage_id)),
    hits1 AS (SELECT request_id, query_idx, n_queries, passage_id, entity_id, {C.COSINE.format(a='q', b='p')} AS distance,
                     row_number() OVER (PARTITION BY request_id, query_idx ORDER BY distance, passage_id) AS pos
              FROM q, p1 WHERE aspect = 'topic' QUALIFY pos <= 256),
    {C.sql_kept('hits1', 'k1', 0.6)}, {C.sql_ranked('k1', 's1')},
    sentence AS ({C.SENTENCE_ROWS}),
    sentence_vec AS ({C.sql_vectors('sentence', 'passage_id')}),
    p2 AS (SELECT sentence.passage_id, entity_id, feedback_id, v AS p_v, len AS p_len FROM sentence JOIN sentence_vec USING (passage_id)),
    hits2 AS (SELECT request_id, query_idx, n_queries, passage_id, p2.entity_id, feedback_id, {C.COSINE.format(a='q', b='p')} AS distance,
                     row_number() OVER (PARTITION BY request_id, query_idx ORDER BY distance, passage_id) AS pos
              FROM q JOIN s1 USING (request_id) JOIN p2 ON p2.entity_id = s1.entity_id
              WHERE aspect = 'evaluation' QUALIFY pos <= 256),
    {C.sql_kept('hits2', 'k2', 0.6)}, {C.sql_ranked('k2', 's2')}, {sql_blend('s1', 's2', 'b')},
    support AS (SELECT k2.* FROM k2 SEMI JOIN b USING (request_id, entity_id) WHERE over OR k2.place <= 4),
    texts AS (SELECT request_id, entity_id, feedback_id, text FROM
              (SELECT DISTINCT request_id, entity_id, feedback_id FROM support) w JOIN documents ON doc_id::VARCHAR = feedback_id),
    collected AS (SELECT request_id, entity_id, list(text ORDER BY feedback_id) AS reviews FROM texts GROUP BY ALL),
    entity AS (SELECT 'src' || p_partkey AS entity_id, p_name AS course_name, p_brand AS course_no, p_size::VARCHAR AS course_class,
                      p_type AS department, concat_ws(chr(10), p_name, p_brand, p_type) AS info FROM part),
    enriched AS (SELECT b.request_id, entity_id, score, b.place, course_name, course_no, course_class, department, info,
                        coalesce(reviews, []) AS reviews
                 FROM b JOIN entity USING (entity_id) LEFT JOIN collected USING (request_id, entity_id))
"""


def _answers(spark, folder):
    """Embedded collections are stored once; both stages and the lookups read them."""
    topic = durable(C.embedded(C.document_passages(spark, folder)).drop("text"), "topic")
    feedback = durable(C.embedded(C.sentence_passages(spark, folder)).drop("text", "pos"), "feedback")
    return R.recommend_texts(C.text_sub_queries(spark, folder), topic, feedback)


def _enriched(spark, folder):
    ranking, support = _answers(spark, folder)
    documents = R.supporting_documents(support, C.documents_as_feedback(spark, folder))
    return R.enrich(ranking, C.entities(spark, folder), documents)


@register(f"WITH {TEXT_STAGES} SELECT request_id, entity_id, stage1_score, stage2_score, score, place FROM b")
def recommend_from_text(spark, folder):
    ranking, _ = _answers(spark, folder)
    return ranking.select("request_id", "entity_id", "stage1_score", "stage2_score", "score", "place")


@register(f"WITH {TEXT_STAGES} SELECT request_id, entity_id, feedback_id, text FROM texts")
def supporting_documents(spark, folder):
    """Distinct documents behind the supporting sentences."""
    _, support = _answers(spark, folder)
    documents = R.supporting_documents(support, C.documents_as_feedback(spark, folder))
    return documents.select("request_id", "entity_id", "feedback_id", "text")


@register(f"""
    WITH {TEXT_STAGES}
    SELECT request_id, entity_id, score, place, course_name, course_no, course_class, department, info,
           len(reviews) AS n_reviews, md5(array_to_string(reviews, chr(10))) AS reviews_md5 FROM enriched
""")
def recommend_enriched(spark, folder):
    return _enriched(spark, folder).select(
        "request_id", "entity_id", "score", "place", "course_name", "course_no", "course_class", "department", "info",
        F.size("reviews").alias("n_reviews"),
        F.md5(F.array_join("reviews", "\n")).alias("reviews_md5"),
    )


@register(f"""
    WITH {TEXT_STAGES}
    SELECT request_id, place, course_no || '-' || course_class AS course_num_class, course_name, department,
           array_to_string(reviews, chr(10) || '___' || chr(10)) AS review_text FROM enriched WHERE place <= 5
""")
def recommend_display(spark, folder):
    shown = R.display(_enriched(spark, folder))
    return shown.select("request_id", "place", "course_num_class", "course_name", "department", "review_text")


@register("""
    SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def documents_by_id(spark, folder):
    ids = C.table(spark, folder, "labels").filter("toxic = 1")
    return R.documents_by_id(C.table(spark, folder, "documents"), ids, "doc_id").select("doc_id", "source", "n_chars")


@register(f"""
    WITH {TEXT_STAGES}
    SELECT request_id, entity_id, course_name, course_no, department, info, len(reviews)::VARCHAR AS n_reviews,
           array_to_string(reviews, chr(10)) AS review FROM enriched WHERE place = 1
""")
def evidence_record(spark, folder):
    """The best result's whole record as context: fields read back out of its JSON."""
    found = R.evidence(_enriched(spark, folder), whole_record=True)
    fields = [F.get_json_object("info", f"$.{name}").alias(name) for name in ("entity_id", "course_name", "course_no", "department", "info")]
    n_reviews = F.json_array_length(F.get_json_object("info", "$.reviews")).cast("string").alias("n_reviews")
    return found.select("request_id", *fields, n_reviews, "review")


@register("""
    SELECT doc_id::VARCHAR AS feedback_id, source AS entity_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def collection_lookup(spark, folder):
    """Documents by id out of a stored collection."""
    path, feedback = scratch_path(spark, "collection"), C.documents_as_feedback(spark, folder).select("feedback_id", "entity_id", "text")
    collections.rebuild(feedback, path)
    ids = C.table(spark, folder, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("feedback_id"))
    stored = collections.read_collection(spark, path, feedback.schema, with_bucket=True)
    return R.documents_by_id(stored, ids, "feedback_id")
