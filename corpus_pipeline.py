"""The corpus pipeline: stages from documents to shards, each written as Parquet and read again."""

from pyspark.sql import functions as F

from passarank.llm import decontaminate, langid, mixing, neardup, sharding
from passarank.llm.common import table
from passarank.plans.sizing import durable

# Below this score a text has next to nothing in common with any language of the corpus.
LEAST_LANGUAGE_SCORE = 0.2
SHARDS = 40


def language(spark, docs, folder):
    """Documents of a language that the corpus teaches stay; ``und`` (null texts and such without a letter) and scores near zero go.

    All stages take whole texts of any length and repeated rows as they come, give no rows for an empty table, and
    keep input columns of any name as they are; the last adds its own two in place of ``shard`` and ``slot``.
    """
    profiles = langid.learn(docs.filter(~langid.held_out()))
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    judged = langid.predict(boxed, profiles, keep=["row"])
    kept = judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select("row.*")


def near_duplicates(spark, docs, folder):
    """One document of each class of near duplicates stays, the one of the smallest id; rows equal in id and text are one."""
    return neardup.without_near_duplicates(docs)


def benchmark(spark, docs, folder):
    """Documents that hold a benchmark item go; null texts would stay."""
    return decontaminate.without_leaks(docs, table(spark, folder, "benchmark"), short_items=True)


def mix(spark, docs, folder):
    """Every document as often as the mix takes it.

    Texts without a word are not taken; null sources are a source of their own; repeated rows count each.
    """
    return mixing.mixed(docs, position=None)


def shards(spark, docs, folder):
    """All rows, repeated ones and null ids included, in random order in shards of equal row counts, with shard and slot."""
    return sharding.shuffled_shards(docs, SHARDS)


STAGES = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mix", mix),
    ("shards", shards),
]
# Near duplicates and edit matching are beyond SQL; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark, folder):
    """The stages one after another over the documents of the folder."""
    docs = table(spark, folder, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if number < len(STAGES) - 1:
            docs = durable(docs, name.replace(" ", "-"))
    return docs
