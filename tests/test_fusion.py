"""The window form of thresholding, fallback and fusion against a plain loop."""

import random

import pytest

from passarank.operators import fusion as U


def loop(hits, threshold, topk, examples):
    """One request at a time, one hit after the other."""
    answers = {}
    for request in sorted({h["request_id"] for h in hits}):
        scores, seen, support = {}, [], {}
        own = [h for h in hits if h["request_id"] == request]
        n_queries = own[0]["n_queries"]
        for q in sorted({h["query_idx"] for h in own}):
            ordered = sorted((h for h in own if h["query_idx"] == q), key=lambda h: (h["distance"], h["passage_id"]))
            near, shown, late = {}, {}, []
            for h in ordered:
                if threshold and h["distance"] > threshold:
                    late.append((h["distance"], h["entity_id"], h["passage_id"]))
                    continue
                near.setdefault(h["entity_id"], []).append(h["distance"])
                listed = shown.setdefault(h["entity_id"], [])
                if len(listed) < examples:
                    listed.append(h["passage_id"])
            for distance, entity, passage in sorted(late):
                if len(near) >= topk:
                    break
                near.setdefault(entity, []).append(distance)
                shown.setdefault(entity, []).append(passage)
            means = {e: sum(round(d * 10**6) for d in ds) / (len(ds) * 1e6) for e, ds in near.items()}
            for entity, mean in means.items():
                rank = 1 + sum(other < mean for other in means.values())
                if entity not in scores:
                    seen.append(entity)
                scores.setdefault(entity, []).append(1 / rank)
            for entity, listed in shown.items():
                support.setdefault(entity, []).extend(listed)
        total = {e: round(sum(s) / n_queries, 12) for e, s in scores.items()}
        best = sorted(seen, key=lambda e: -total[e])[:topk]
        answers[request] = ([(e, total[e]) for e in best], support)
    return answers


def random_hits(seed, requests=6, queries=3, per_query=24, entities=12, grid=20):
    """Few distinct distances, so that ties are common; entity ids of one and two digits."""
    rng = random.Random(seed)
    rows = []
    for r in range(requests):
        for q in range(queries):
            for p in rng.sample(range(400), per_query):
                rows.append((f"r{r}", q, queries, str(p), str(p % entities), rng.randint(1, grid) / grid))
    return rows


SCHEMA = "request_id string, query_idx int, n_queries int, passage_id string, entity_id string, distance double"


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("threshold", [None, 0.05, 0.3, 0.6, 1.0])
def test_equals_loop(spark, seed, threshold):
    rows = random_hits(seed)
    hits = spark.createDataFrame(rows, SCHEMA)
    expected = loop([dict(zip(hits.columns, r)) for r in rows], threshold, 4, 2)
    kept = U.kept_hits(hits, threshold, 4).cache()
    ranked = {}
    for row in U.rank_entities(kept, 4).orderBy("request_id", "place").collect():
        ranked.setdefault(row["request_id"], []).append((row["entity_id"], row["score"]))
    support = {row["request_id"]: dict(row["supporting"]) for row in U.supporting_map(U.supporting_examples(kept, 2)).collect()}
    assert ranked == {r: e[0] for r, e in expected.items()}
    assert support == {r: e[1] for r, e in expected.items()}


def kept_ids(spark, rows, threshold, topk):
    hits = spark.createDataFrame([("r", 0, 1, *r) for r in rows], SCHEMA)
    return sorted(r["passage_id"] for r in U.kept_hits(hits, threshold, topk).collect())


def test_distance_equal_to_threshold_passes(spark):
    assert kept_ids(spark, [("a", "x", 0.5), ("b", "y", 0.500001)], 0.5, 1) == ["a"]


def test_fallback_compares_ids_as_text(spark):
    """Equal distances: entity "10" comes before "9"."""
    assert kept_ids(spark, [("a", "9", 0.9), ("b", "10", 0.9)], 0.5, 1) == ["b"]


def test_fallback_of_known_entity_counts_until_full(spark):
    rows = [("a", "x", 0.1), ("b", "x", 0.7), ("c", "y", 0.8), ("d", "x", 0.9), ("e", "z", 0.95)]
    assert kept_ids(spark, rows, 0.5, 2) == ["a", "b", "c"]


def test_topk_is_required(spark):
    with pytest.raises(ValueError):
        U.kept_hits(spark.createDataFrame([], SCHEMA), 0.5, None)


def test_no_hits_no_rows(spark):
    assert U.rank_entities(U.kept_hits(spark.createDataFrame([], SCHEMA))).count() == 0


def test_entity_of_one_query_only_is_divided_by_all(spark):
    rows = [("r", 0, 2, "a", "x", 0.1), ("r", 1, 2, "b", "y", 0.1), ("r", 1, 2, "c", "x", 0.2)]
    scores = {r["entity_id"]: r["score"] for r in U.rank_entities(U.kept_hits(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert scores == {"x": (1 + 1 / 2) / 2, "y": 1 / 2}


def test_thresholds_share_one_move_of_the_hits(spark, tmp_path):
    from tests.conftest import plan

    from suite import retrieval

    vectors = [(i, i % 3, [float(i % 5), float(i % 7) - 2.0, 1.0]) for i in range(40)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"s{i % 4}") for i in range(30)], "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = retrieval.threshold_fallback(spark, str(tmp_path))
    kept.collect()
    assert plan(kept).split("Initial Plan")[0].count("ReusedExchange") == 2
