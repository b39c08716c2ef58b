"""Collects queries and their SQL twins by function name."""

# Columns that are 32-bit numbers in Spark and 64-bit ones in the twin as written.
NARROW = {
    "cosine_knn": "pos", "knn_default_hits": "pos", "knn_candidate_filter": "pos", "entity_mean_rank": "rank",
    "rank_fusion_topk": "place", "supporting_examples": "place", "two_stage_recommend": "place",
    "recommend_from_text": "place", "recommend_enriched": "place n_reviews", "recommend_display": "place",
    "answer_from_index": "place", "sentence_split": "pos", "line_split": "pos", "sentence_passages": "pos",
    "passage_concat": "pos", "embed_passages": "n_nonzero n_values", "embed_queries": "n_nonzero n_values", "embed_once": "n_nonzero n_values",
    "page_rows": "row_no n_cells", "page_fields": "row_no", "page_paragraphs": "review_no",
    "append_entities": "n_chars", "split_parse": "query_idx n_queries",
}


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, sql=None):
        def add(function):
            name = function.__name__
            self.queries[name] = function
            if sql:
                casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in NARROW.get(name, "").split())
                self.sql[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
            return function

        return add
