"""The operators put together: from landed pages to stored courses, from those to vector collections,
from requests to answers."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from passarank.fixed_values import COURSE_CELLS
from passarank.functions import prompts as P
from passarank.operators import extract as E
from passarank.operators import passages as G
from passarank.operators import recommend as R
from passarank.operators.embed import HashingEncoder, embed, embed_once
from passarank.operators.requests import parse_split, sub_queries
from passarank.plans.prefix import numbered
from passarank.plans.sizing import durable, is_narrow
from passarank.schemas import COURSE, VECTOR
from passarank.sources import collections

COURSE_FIELDS = [name for name in COURSE.names if name != "id"]
ENTITY, PASSAGE, FEEDBACK, FEEDBACK_PASSAGE = "course", "course_sentence", "review", "review_sentence"


def _strings(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("embedding", VECTOR)])


COLLECTIONS = {
    ENTITY: _strings("entity_id", "text", *COURSE_FIELDS),
    PASSAGE: _strings("passage_id", "entity_id", "text"),
    FEEDBACK: _strings("feedback_id", "entity_id", "text"),
    FEEDBACK_PASSAGE: _strings("passage_id", "entity_id", "feedback_id", "text"),
}


def courses_from_pages(list_pages, detail_pages, template, patterns, positions=COURSE_CELLS, last_id=0, **slots):
    """Course records out of list pages and of the detail pages landed under the templated address.

    Records are numbered in page order, after ``last_id``.
    """
    listed = E.detail_urls(E.course_rows(list_pages, positions), template, **slots)
    details = E.course_details(detail_pages.select("url", "html"), patterns)
    joined = listed.join(details, "url", "left")
    return numbered(joined, ["page_id", "row_no"], "id", first=last_id + 1).select(*COURSE.names)


def _courses(nested):
    first_parts = nested.filter(F.coalesce(F.col("part"), F.lit(0)) == 0)
    return first_parts.select(F.col("id").cast("string").alias("entity_id"), *[F.col(n).cast("string").alias(n) for n in COURSE_FIELDS])


def _with_document(courses):
    return courses.withColumn("text", G.entity_document(F.col("course_intro"), F.col("prerequisite"), F.col("syllabus")))


def _course_passages(courses):
    return G.explode_passages(courses, "entity_id", G.entity_passages(F.col("course_name"), F.col("course_intro"), F.col("syllabus")))


def text_frames(nested):
    """The four collections of a nested export, as frames without vectors.

    Store ``nested`` first if it is costly to read, as ``build_index`` does: every frame reads it.
    """
    courses, feedback = _courses(nested), G.feedback_table(nested)
    frames = {
        ENTITY: _with_document(courses),
        PASSAGE: _course_passages(courses),
        FEEDBACK: feedback,
        FEEDBACK_PASSAGE: G.feedback_passages(feedback),
    }
    return {name: df.select(*COLLECTIONS[name].names[:-1]) for name, df in frames.items()}


def index_frames(nested, encoder=HashingEncoder, vectors=None):
    """``text_frames`` with vectors. With a folder ``vectors`` every different text is encoded once, and not at all if
    the folder has its vector (``embed_once``)."""
    frames = text_frames(nested)
    if vectors is None:
        return {name: embed(df, "text", encoder) for name, df in frames.items()}
    return {name: embed_once(df, "text", encoder, store=vectors) for name, df in frames.items()}


def build_index(nested, path, encoder=HashingEncoder, vectors=None, read=None):
    """Rebuild the four collections under ``path``.

    An export is parsed twice, for the courses and for the reviews; their sentences are made out of the stored collections.
    What is more than a scan is stored first. With a folder ``vectors`` a rebuild encodes only the texts that are new since the last one.
    ``read`` is called as soon as ``nested`` is not read any more, so that an export which is only a step on the way can go.
    """
    if vectors is not None:
        for name, df in index_frames(durable(nested, "nested"), encoder, vectors).items():
            collections.rebuild(df, f"{path}/{name}")
        if read:
            read()
        return
    # Lines are sound or not as a whole: a scan must parse all their columns, whichever are used.
    nested = nested.filter(F.size(F.array(F.struct(*nested.columns))) == 1) if is_narrow(nested) else durable(nested, "nested")
    buckets = collections.folder_count(nested)

    def stored(name, df, add=lambda dealt: dealt, dealt=False):
        # Texts are dealt out before they are encoded, so that no vector is moved; documents are put together afterwards, too.
        encoded = lambda rows: embed(add(rows), "text", encoder)
        number = collections.rebuild(df, f"{path}/{name}", buckets=buckets, add=encoded, dealt=dealt)
        return collections.read_collection(nested.sparkSession, f"{path}/{name}", COLLECTIONS[name], version=number)

    courses = stored(ENTITY, _courses(nested), _with_document)
    feedback = stored(FEEDBACK, G.feedback_table(nested))
    if read:
        read()
    stored(PASSAGE, _course_passages(courses).select(*COLLECTIONS[PASSAGE].names[:-1]), dealt=True)
    stored(FEEDBACK_PASSAGE, G.feedback_passages(feedback).select(*COLLECTIONS[FEEDBACK_PASSAGE].names[:-1]), dealt=True)


def open_index(spark, path):
    """The four collections; they keep their folder column, by which later steps leave folders out."""
    return {name: collections.read_collection(spark, f"{path}/{name}", schema, with_bucket=True) for name, schema in COLLECTIONS.items()}


def answer(index, outputs, encoder=HashingEncoder, raw=False, **options):
    """Answer requests whose split texts are in ``outputs`` (``request_id, output``).

    One row per request and recommended course: place, score, the course's fields, its document as
    ``info`` and its supporting reviews. ``raw`` cleans model output first. Requests can stay without an answer;
    ``answer_all`` says which and why.
    """
    return answer_all(index, outputs, encoder, raw, **options)[0]


def answer_all(index, outputs, encoder=HashingEncoder, raw=False, **options):
    """The answers and, one row per request, what became of it: ``outputs`` with ``outcome`` and ``n_results``.

    See ``recommend.outcomes`` for the outcomes. Both come from one search.
    """
    split = durable(_split(outputs, raw), "split")
    topic = index[PASSAGE].select("passage_id", "entity_id", "embedding")
    feedback = index[FEEDBACK_PASSAGE].drop("text")
    queries = durable(embed(sub_queries(split), "text", encoder), "queries").drop("text")
    first, ranking, support = R.recommend_stages(queries, topic, feedback, **options)
    entities = index[ENTITY].withColumnRenamed("text", "info").drop("embedding")
    answers = R.enrich(ranking, entities, R.supporting_documents(support, index[FEEDBACK].drop("embedding")))
    return answers, R.outcomes(split, first, ranking).select(*outputs.columns, "outcome", "n_results")


def _split(outputs, raw):
    if raw:
        outputs = outputs.withColumn("output", P.clean_output(F.col("output")))
    return parse_split(outputs)


def unanswerable(outputs, raw=False):
    """The requests that no search can answer, with the ``state`` that says why; known before any search."""
    split = _split(outputs, raw)
    return split.filter(~F.col("valid")).select(*outputs.columns, "state")
