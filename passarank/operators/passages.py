"""Passages out of entity and feedback texts. All of it is narrow: no shuffle."""

from pyspark.sql import functions as F

from passarank.fixed_values import ALLOWED_CHARACTERS, TITLE_SUFFIX
from passarank.functions import text as X
from passarank.plans.explode import exploded


def nested_texts(nested, field="text"):
    """The texts inside an array of records, as an array of strings."""
    return F.transform(F.col(nested), lambda record: record[field])


def entity_document(intro, prerequisite, syllabus):
    """One text per entity: intro, prerequisite and syllabus by line, absent parts left out."""
    return F.concat_ws("\n", intro, prerequisite, syllabus)


def entity_passages(title, intro, syllabus, suffix=TITLE_SUFFIX):
    """Title sentence, intro sentences and syllabus lines without their numbers, in this order."""
    weeks = F.transform(X.lines(syllabus), X.strip_ordinal)
    return X.concat_lists(X.title_sentence(title, suffix), X.sentences(intro), weeks)


def explode_passages(df, entity, texts, parent=None, keep_empty=False, sep="#"):
    """One normalised passage per item of an array column: ``(passage_id, entity_id, pos, text)``.

    ``parent`` names a column to carry along, the id of the document that the items come from. A
    passage id joins the id of the parent (of the entity if there is none) and the item's position,
    so it needs no global count.
    """
    carried = [parent] if parent else []
    items = exploded(df, [F.col(entity).cast("string").alias("entity_id"), *carried], texts, "pos", "text")
    if not keep_empty:
        # Tested on the raw text: a test of the cleaned one would clean every text twice.
        items = items.filter(F.col("text").rlike(f"[{ALLOWED_CHARACTERS}]"))
    return items.select(
        F.concat_ws(sep, F.col(parent or "entity_id"), F.col("pos")).alias("passage_id"),
        "entity_id",
        *carried,
        "pos",
        X.normalize(F.col("text")).alias("text"),
    )


def feedback_table(nested, key="id", reviews="reviews"):
    """Flat feedback out of nested entities; an entity without any disappears."""
    return nested.select(
        F.col(key).cast("string").alias("entity_id"), F.explode(reviews).alias("review")
    ).select(F.col("review.id").cast("string").alias("feedback_id"), "entity_id", F.col("review.text").alias("text"))


def feedback_passages(feedback):
    """Sentences of feedback documents; each keeps the id of its document."""
    return explode_passages(feedback, "entity_id", X.sentences(F.col("text")), parent="feedback_id")


def as_metadata(df, names):
    """Every named column cast to text; NULL stays NULL."""
    return df.select(*[F.col(n).cast("string").alias(n) for n in names])
