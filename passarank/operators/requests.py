"""Requests into sub-queries."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from passarank.fixed_values import EVALUATION_KEY, TOPIC_KEY
from passarank.functions import prompts as P

TOPIC, EVALUATION = "topic", "evaluation"


def split_requests(requests, text="text", example="hosted"):
    """Add the prompt and the chat messages that ask a model to split each request."""
    return requests.withColumn("prompt", P.split_prompt(F.col(text), example)).withColumn(
        "messages", P.chat_messages(F.col("prompt"))
    )


def parse_split(outputs, text="output", topic_key=TOPIC_KEY, evaluation_key=EVALUATION_KEY):
    """Read the two lists out of each model output.

    ``state`` is ``ok``, ``unreadable`` (bad JSON or a missing list) or ``empty`` (a list without an item, so that
    one of the two searches has nothing to look for); only ``ok`` is ``valid``.
    """
    lists = T.ArrayType(T.StringType())
    schema = T.StructType().add(topic_key, lists).add(evaluation_key, lists)
    parsed = outputs.withColumn("_split", F.from_json(F.col(text), schema))
    return parsed.select(
        *outputs.columns,
        F.col("_split").getField(topic_key).alias(TOPIC),
        F.col("_split").getField(evaluation_key).alias(EVALUATION),
    ).withColumns({"state": _state(), "valid": _state() == "ok"})


def _state():
    missing = F.col(TOPIC).isNull() | F.col(EVALUATION).isNull()
    empty = (F.size(TOPIC) == 0) | (F.size(EVALUATION) == 0)
    return F.when(missing, "unreadable").when(empty, "empty").otherwise("ok")


def sub_queries(split, request="request_id"):
    """One row per sub-query: ``(request_id, aspect, query_idx, n_queries, text)``.

    ``n_queries`` is the number of sub-queries of the request in the same aspect; it comes from
    the array at hand, so no count over the requests is needed.
    """

    def exploded(aspect):
        queries = F.col(aspect)
        return split.filter(F.col("valid")).select(
            F.col(request).cast("string").alias("request_id"),
            F.lit(aspect).alias("aspect"),
            F.size(queries).alias("n_queries"),
            F.posexplode(queries).alias("query_idx", "text"),
        )

    return exploded(TOPIC).unionByName(exploded(EVALUATION)).select("request_id", "aspect", "query_idx", "n_queries", "text")
