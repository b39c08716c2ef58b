"""From hits to ranked entities: threshold, fallback, mean rank per sub-query, fusion over sub-queries.

Input is what ``nearest_passages`` returns: ``request_id, query_idx, n_queries, passage_id,
entity_id, distance``. Everything up to the ranks is partitioned by sub-query, where a group holds
at most the k nearest hits; only the last sum moves rows, already reduced to one per entity.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from passarank.fixed_values import DEFAULT_THRESHOLD, ENTITIES_RETURNED, EXAMPLES_PER_QUERY
from passarank.functions.scores import DISTANCE_DIGITS

QUERY = ["request_id", "query_idx"]
SCORE_DIGITS = 12
STEPS = 10**DISTANCE_DIGITS


def split_by_threshold(hits, threshold=DEFAULT_THRESHOLD):
    """Add ``over``: the hit lies beyond the threshold and is only a fallback. Equal is not over;
    no threshold, or zero, lets every hit pass."""
    over = F.col("distance") > F.lit(float(threshold)) if threshold else F.lit(False)
    return hits.withColumn("over", over)


def kept_hits(hits, threshold=DEFAULT_THRESHOLD, topk=ENTITIES_RETURNED):
    """The hits that count: all within the threshold, then fallbacks while entities are missing.

    Fallbacks are taken in the order (distance, entity, passage). One is taken as long as fewer than
    ``topk`` entities have been seen before it, be its own entity new or not. The at most k hits of a
    sub-query are put in order once, those within the threshold first; what counts is then a beginning of
    that list, up to the place where the ``topk``-th different entity first appears. ``place`` numbers an
    entity's hits of the same kind, ``seq`` all hits of a sub-query in the order in which they are looked
    at. Entity ids are not null.
    """
    if topk is None:
        raise ValueError("topk must be a number")
    queue_entity = F.when(F.col("over"), F.col("entity_id")).otherwise("")
    rest = [c for c in hits.columns if c not in {*QUERY, "distance", "passage_id"}]
    hit = F.struct("over", "distance", queue_entity.alias("queue"), "passage_id", F.struct(*rest).alias("rest"))
    in_order = split_by_threshold(hits, threshold).groupBy(*QUERY).agg(F.sort_array(F.collect_list(hit)).alias("_hits"))
    seen = F.transform("_hits", lambda h: h["rest"]["entity_id"])
    within = F.size(F.filter("_hits", lambda h: ~h["over"]))
    full = F.array_position("_seen", F.get(F.array_distinct("_seen"), topk - 1)) if topk > 0 else F.lit(0)
    cut = F.greatest(within, F.coalesce(full.cast("int"), F.size("_hits")))
    taken = in_order.withColumn("_seen", seen).select(*QUERY, F.slice("_hits", 1, cut).alias("_hits"))
    per_entity = Window.partitionBy(*QUERY, "entity_id", "over").orderBy("seq")
    values = {**{c: f"_hit.rest.{c}" for c in rest}, "distance": "_hit.distance", "passage_id": "_hit.passage_id", **{c: c for c in QUERY}}
    return (
        taken.select(*QUERY, F.posexplode("_hits").alias("_at", "_hit"))
        .select(*(F.col(values[c]).alias(c) for c in hits.columns), "_hit.over", (F.col("_at") + 1).alias("seq"))
        .withColumn("place", F.row_number().over(per_entity))
    )


def entity_means(kept):
    """Mean distance per sub-query and entity, with the entity's first hit for tie order.

    Distances are summed as whole numbers of rounding steps: the mean is then the same in whatever
    order rows arrive, and equal means are equal to the last bit, as ties in the ranking need.
    """
    steps = F.round(F.col("distance") * STEPS).cast("long")
    return kept.groupBy(*QUERY, "entity_id").agg(
        (F.sum(steps) / (F.count("*") * F.lit(float(STEPS)))).alias("mean_distance"),
        F.min("seq").alias("first_hit"),
        F.max("n_queries").alias("n_queries"),
    )


def reciprocal_ranks(means):
    """Rank entities per sub-query by mean distance, ties sharing the lowest rank; score is 1/rank."""
    best_first = Window.partitionBy(*QUERY).orderBy("mean_distance")
    return means.withColumn("rank", F.rank().over(best_first)).withColumn("score", F.lit(1.0) / F.col("rank"))


def fuse(ranked):
    """Score per request and entity: sum over its sub-queries divided by their number, absent ones as 0.

    ``first_seen`` packs sub-query and hit number, 32 bits each, into one number.
    """
    first_seen = F.shiftleft(F.col("query_idx").cast("long"), 32) + F.col("first_hit")
    return ranked.groupBy("request_id", "entity_id").agg(
        F.round(F.sum("score") / F.max("n_queries"), SCORE_DIGITS).alias("score"),
        F.min(first_seen).alias("first_seen"),
    )


def top_entities(fused, topk=ENTITIES_RETURNED):
    """The best entities per request, ties in the order in which they were first seen; ``place`` from 1."""
    best_first = Window.partitionBy("request_id").orderBy(F.desc("score"), "first_seen")
    return fused.withColumn("place", F.row_number().over(best_first)).filter(F.col("place") <= topk).drop("first_seen")


def rank_entities(kept, topk=ENTITIES_RETURNED):
    """Kept hits to the best entities per request: ``request_id, entity_id, score, place``."""
    return kept.transform(entity_means).transform(reciprocal_ranks).transform(fuse).transform(lambda df: top_entities(df, topk))


def supporting_examples(kept, examples=EXAMPLES_PER_QUERY):
    """The passages that speak for an entity, one per row in the order ``query_idx, over, place``.

    Of the hits within the threshold the first few per sub-query and entity; of the fallbacks all.
    """
    return kept.filter(F.col("over") | (F.col("place") <= examples))


def supporting_map(examples):
    """The same as one ``entity -> [passage, …]`` map per request (small by then: cut entities first)."""
    ordered = F.array_sort(F.collect_list(F.struct("query_idx", "over", "place", "passage_id")))
    lists = examples.groupBy("request_id", "entity_id").agg(F.transform(ordered, lambda e: e["passage_id"]).alias("ids"))
    return lists.groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("entity_id", "ids"))).alias("supporting"))
