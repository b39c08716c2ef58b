"""Records out of landed pages, and the checks that follow extraction."""

from functools import reduce

from pyspark.sql import functions as F

from passarank.fixed_values import ATTACHMENT_MARKER, ATTENDANCE_SCALE, COURSE_CELLS, GRADE_SCALE
from passarank.functions import html as H
from passarank.functions import text as X
from passarank.functions.scores import encode_label, round_half_even
from passarank.plans.explode import exploded, once
from passarank.schemas import STAT_FIELDS


def with_elements(df, source, tag, out):
    """Add an array column with the inner sources of all ``<tag>`` elements of a source column, nested ones
    included, in page order: ``functions.html.elements`` step by step."""
    found = df
    for name, step in H.element_stages(source, tag):
        found = found.withColumn(name, step(F.col))
    return once(found.drop(out), out, F.col("_found")).select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)


def page_rows(pages, row_tag="tr", cell_tag="td", html="html"):
    """One row per repeated element: its position on the page, its source and its cells."""
    others = [c for c in pages.columns if c != html]
    rows = with_elements(pages, html, row_tag, "_rows")
    return with_elements(exploded(rows, others, F.col("_rows"), "row_no", "source"), "source", cell_tag, "cells")


def with_paths(df, source, **paths):
    """Add an array column per name with the inner sources of the elements at a path of children, in page order.

    A path is written as for ``functions.html.steps``; one that leads nowhere gives an empty array, a null
    source null. The source is cut once for all paths, and steps are columns one after another, so that
    long paths stay a flat plan.
    """
    found = once(df, "_tree", H.tree(F.col(source)))
    for name, path in paths.items():
        found = found.withColumn("_places", H.whole(F.col("_tree")))
        for step in H.steps(path):
            found = found.withColumn("_places", step(F.col("_tree"), F.col("_places")))
        found = found.withColumn(name, H.inner_at(F.col("_tree"), F.col("_places")))
    return found.drop("_tree", "_places")


def map_cells(rows, positions):
    """Add a text column per name from the cell at its zero-based position."""
    return rows.select(
        *[c for c in rows.columns if c not in ("source", "cells")],
        *[H.cell(F.col("cells"), at).alias(name) for name, at in positions.items()],
    )


def course_rows(pages, positions=COURSE_CELLS):
    """Course records of list pages; rows without an instructor are dropped."""
    fields = map_cells(page_rows(pages), positions)
    return (
        fields.withColumn("credit", X.leading_int(F.col("credit")))
        .withColumn("timeslot", X.timeslot(F.col("room")))
        .withColumn("room", X.room(F.col("room")))
        .transform(lambda df: required(df, "instructor"))
    )


def required(df, *names):
    """Rows in which every named text is present and not empty."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(n) != "" for n in names]))


def detail_urls(courses, template, out="url", **extra):
    """Add the address of each record's detail page, filled into a template."""
    slots = {name: F.col(name) for name in courses.columns}
    slots.update({name: F.lit(value) for name, value in extra.items()})
    return courses.withColumn(out, X.fill(template, **slots))


def course_details(pages, patterns, marker=ATTACHMENT_MARKER, html="html"):
    """Intro, prerequisite and syllabus of detail pages.

    ``patterns`` gives one pattern each for ``intro``, ``prerequisite_1``, ``prerequisite_2`` and
    ``syllabus``. Pages that hold the attachment marker have only the intro.
    """
    source = F.col(html)

    def text_of(name):
        return H.element_text(H.first_match(source, patterns[name]))

    weeks = F.transform(H.elements(H.first_match(source, patterns["syllabus"]), "tr"), lambda row: H.elements(row, "td"))
    syllabus = X.numbered_lines(weeks, lambda cells: H.cell(cells, 0), lambda cells: H.cell(cells, 1))
    return pages.select(
        *[c for c in pages.columns if c != html],
        text_of("intro").alias("course_intro"),
        H.unless_marked(source, marker, X.two_cells(text_of("prerequisite_1"), text_of("prerequisite_2"))).alias("prerequisite"),
        H.unless_marked(source, marker, syllabus).alias("syllabus"),
    )


def review_rows(pages, block, text, badge, html="html"):
    """One row per review block of a page: its text and its last badge.

    ``block`` and ``badge`` are patterns that match repeatedly, ``text`` one that matches once per block.
    """
    others = [c for c in pages.columns if c != html]
    blocks = F.regexp_extract_all(F.col(html), F.lit(block), F.lit(1))
    return exploded(pages, others, blocks, "review_no", "source").select(
        *others,
        "review_no",
        H.element_text(H.first_match(F.col("source"), text)).alias("text"),
        H.last_badge(F.regexp_extract_all(F.col("source"), F.lit(badge), F.lit(1))).alias("badge"),
    )


def review_rows_at(pages, blocks, text, badges, html="html"):
    """``review_rows`` by place: ``blocks`` is the path of the blocks on the page, ``text`` and ``badges`` lead
    from a block to its text and to its badges, the last of which counts."""
    others = [c for c in pages.columns if c != html]
    found = with_paths(pages.withColumnRenamed(html, "_html"), "_html", _blocks=blocks)
    found = exploded(found, others, F.col("_blocks"), "review_no", "_source")
    found = with_paths(found, "_source", _texts=text, _badges=badges)
    return found.select(
        *others, "review_no", H.element_text(F.get("_texts", F.lit(0))).alias("text"), H.last_badge(F.col("_badges")).alias("badge")
    )


def mean_grade(reviews, key, label, scale=GRADE_SCALE, strict=False, out="grade"):
    """Mean of the encoded labels per key, one decimal; keys without reviews give no row."""
    return (
        reviews.select(key, encode_label(F.col(label), scale, strict).alias("_number"))
        .groupBy(key)
        .agg(F.avg("_number").alias("_mean"))
        .select(key, round_half_even(F.col("_mean")).alias(out))
    )


def review_stats(pages, reviews, key, scalars, attendance, html="html", strict=False, scale=GRADE_SCALE):
    """One stat record per page: scalars found by pattern, attendance by label, and the mean grade by ``scale``."""
    facts = pages.select(
        key,
        *[H.number_at(F.col(html), pattern).alias(name) for name, pattern in scalars.items()],
        encode_label(X.strip(H.element_text(H.first_match(F.col(html), attendance))), ATTENDANCE_SCALE, strict)
        .cast("double")
        .alias("attendance"),
    )
    return facts.join(mean_grade(reviews, key, "badge", scale, strict), key).select(key, *STAT_FIELDS)


def pivot_stats(facts, key, name, value, names):
    """Long facts as one record per key, the mean of each named value in its own column."""
    wide = facts.groupBy(key).pivot(name, list(names)).agg(F.avg(value))
    return wide.select(key, *names)


def valid_scores(stats, fields=STAT_FIELDS, low=1.0, high=5.0):
    """Records whose scores all lie on the scale."""
    return stats.filter(reduce(lambda a, b: a & b, [F.col(f).between(low, high) for f in fields]))


def resume_from(df, order, key, marker):
    """The rows from the first one with the marker on.

    The starting point is one minimum over the table, read as a scalar and pushed into the
    scan, so nothing is sorted. No row with the marker, no rows.
    """
    start = df.filter(F.col(key) == marker).agg(F.min(order)).scalar()
    return df.filter(F.col(order) >= start)


def without_result(entities, results, key):
    """The entities that have no result."""
    return entities.join(results.select(key).distinct(), key, "left_anti")
