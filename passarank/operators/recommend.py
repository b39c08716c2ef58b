"""Two-stage recommendation for a batch of requests, and the shapes in which it is shown."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from passarank import fixed_values as fixed
from passarank.operators.embed import HashingEncoder, embed
from passarank.operators.fusion import kept_hits, rank_entities, supporting_examples
from passarank.operators.knn import nearest_passages
from passarank.operators.requests import EVALUATION, TOPIC
from passarank.plans.sizing import durable, small
from passarank.sources.collections import within


def retrieve(queries, passages, candidates=None, k=fixed.HITS_PER_QUERY, threshold=fixed.CALLERS_THRESHOLD,
             topk=fixed.ENTITIES_RETURNED, **options):
    """Nearest passages with those that count marked and the others gone."""
    return kept_hits(nearest_passages(queries, passages, k, candidates, **options), threshold, topk)


def blend(first, second, first_weight=fixed.TOPIC_WEIGHT, second_weight=fixed.EVALUATION_WEIGHT):
    """Weighted sum of both stages for the entities of the second; ties keep the second stage's order."""
    best_first = Window.partitionBy("request_id").orderBy(F.desc("score"), "stage2_place")
    both = first.select("request_id", "entity_id", F.col("score").alias("stage1_score")).join(
        second.select("request_id", "entity_id", F.col("score").alias("stage2_score"), F.col("place").alias("stage2_place")),
        ["request_id", "entity_id"],
    )
    score = F.col("stage1_score") * first_weight + F.col("stage2_score") * second_weight
    return both.withColumn("score", score).withColumn("place", F.row_number().over(best_first))


def recommend(queries, topic_passages, feedback_passages, k=fixed.HITS_PER_QUERY, threshold=fixed.CALLERS_THRESHOLD,
              topk=fixed.ENTITIES_RETURNED, **options):
    """Answer all requests: rank entities by topic, rerank them by their feedback.

    ``queries`` holds the embedded sub-queries of both aspects. Returns the ranking and the feedback
    passages that support it. The small results of both stages are stored, so nothing runs twice.
    """
    _, ranking, support = recommend_stages(queries, topic_passages, feedback_passages, k, threshold, topk, **options)
    return ranking, support


def recommend_stages(queries, topic_passages, feedback_passages, k=fixed.HITS_PER_QUERY, threshold=fixed.CALLERS_THRESHOLD,
                     topk=fixed.ENTITIES_RETURNED, **options):
    """``recommend`` with the first stage's entities before the ranking, for ``outcomes``."""

    def of(aspect):
        return queries.filter(F.col("aspect") == aspect).drop("aspect")

    topic_hits = retrieve(of(TOPIC), topic_passages, None, k, threshold, topk, **options)
    first = durable(rank_entities(topic_hits, topk), "stage1")
    feedback_hits = retrieve(of(EVALUATION), feedback_passages, first, k, threshold, topk, **options)
    feedback_hits = durable(feedback_hits, "stage2-hits")
    ranking = durable(blend(first, rank_entities(feedback_hits, topk)), "ranking")
    support = supporting_examples(feedback_hits).join(ranking.select("request_id", "entity_id"), ["request_id", "entity_id"])
    return first, ranking, support


def recommend_texts(sub_queries, topic_passages, feedback_passages, encoder=HashingEncoder, **options):
    """``recommend`` for sub-queries that are still text."""
    return recommend(durable(embed(sub_queries, "text", encoder), "queries").drop("text"), topic_passages, feedback_passages, **options)


ANSWERED, NO_TOPIC_HIT, NO_EVALUATED_ENTITY = "answered", "no topic hit", "no evaluated entity"


def outcomes(split, first, ranking):
    """What became of every request: ``split`` with its ``outcome`` and ``n_results``.

    ``split`` is ``parse_split``'s result, ``first`` and ``ranking`` come from ``recommend_stages``. A request without a
    readable split keeps its state (``unreadable``, ``empty``); the others are ``answered``, have ``no topic hit``, or have
    topic hits but ``no evaluated entity``, as no entity of theirs has feedback. One row per row of ``split``:
    requests that are repeated share their outcome.
    """

    def counted(df, name):
        # A few rows per request, combined before they are shuffled.
        return df.groupBy(F.col("request_id").alias("_request")).agg(F.count("*").alias(name))

    found = counted(first, "_topics").join(counted(ranking, "_results"), "_request", "left")
    state = (
        F.when(~F.col("valid"), F.col("state")).when(F.col("_topics").isNull(), NO_TOPIC_HIT)
        .when(F.col("_results").isNull(), NO_EVALUATED_ENTITY).otherwise(ANSWERED)
    )
    results = F.when(F.col("valid"), F.coalesce("_results", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return split.join(found, F.col("request_id").cast("string").eqNullSafe(F.col("_request")), "left").select(
        *split.columns, state.alias("outcome"), results.alias("n_results")
    )


# Ids that are written into a lookup's filter; more are joined.
LISTED_IDS = 1_000


def documents_by_id(collection, ids, key):
    """Rows of a collection whose id occurs in ``ids``: one pass instead of a lookup per id.

    Up to ``LISTED_IDS`` ids become a filter of the scan, which skips the row groups of a stored collection whose
    Bloom filters and ranges hold none of them; more are joined. The rows are the same.
    """
    wanted = durable(ids.select(key).distinct(), "ids")
    listed = [row[key] for row in wanted.filter(F.col(key).isNotNull()).limit(LISTED_IDS + 1).collect()]
    collection = within(collection, wanted) if key == "entity_id" else within(collection)
    if len(listed) <= LISTED_IDS:
        any_of = reduce(lambda a, b: a | b, [F.col(key).isin(listed[i : i + 10]) for i in range(0, len(listed), 10)], F.lit(False))
        return collection.filter(any_of)
    return collection.join(small(wanted), key, "left_semi").select(*collection.columns)


def supporting_documents(support, feedback):
    """Distinct feedback documents behind the supporting passages, with their texts.

    The few wanted documents are joined to the collection, never the other way round.
    """
    wanted = durable(support.select("request_id", "entity_id", "feedback_id").distinct(), "wanted")
    texts = within(feedback, wanted).select("feedback_id", "text")
    return small(wanted).join(texts, "feedback_id")


def collected_texts(documents):
    """Texts of each request and entity as an array, in the order of their ids."""
    ordered = F.array_sort(F.collect_list(F.struct("feedback_id", "text")))
    return documents.groupBy("request_id", "entity_id").agg(F.transform(ordered, lambda d: d["text"]).alias("reviews"))


def enrich(ranking, entities, documents, key="entity_id"):
    """Ranking with all attributes of the entity and the texts of its supporting feedback."""
    best = small(ranking.select("request_id", key, "score", "place"))
    texts = collected_texts(documents)
    empty = F.array().cast("array<string>")
    return best.join(within(entities, best, key), key).join(texts, ["request_id", key], "left").withColumn(
        "reviews", F.coalesce(F.col("reviews"), empty)
    )


def display(enriched, results=fixed.RESULTS_DISPLAYED):
    """The first results of each request: number and class in one field, reviews as one text."""
    return enriched.filter(F.col("place") <= results).withColumns(
        {
            "course_num_class": F.concat_ws("-", "course_no", "course_class"),
            "review_text": F.array_join("reviews", fixed.REVIEW_RULE),
        }
    )


def evidence(enriched, whole_record=False):
    """Best result of each request as prompt context: ``request_id, info, review``.

    ``info`` is the entity's document, or the whole record as text, which the chat turns use.
    """
    best = enriched.filter(F.col("place") == 1)
    info = F.to_json(F.struct(*[c for c in best.columns if c != "request_id"])) if whole_record else F.col("info")
    return best.select("request_id", info.alias("info"), F.array_join("reviews", "\n").alias("review"))


