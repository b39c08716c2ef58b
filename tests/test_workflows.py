"""From hand-written pages to an answer."""

import json
import os
import shutil

from pyspark.sql import functions as F
from tests.test_extract import PATTERNS, row

from passarank import workflows as W
from passarank.operators import dialog, recommend
from passarank.plans.sizing import scratch_path
from passarank.schemas import COURSE
from passarank.sources import nested, tables

TEMPLATE = "https://plans.example.org/?d={dept}&no={course_no}&cls={course_class}"


def pages(spark):
    """Two list pages and the detail pages landed for them; one of those is missing."""
    topics = {"CS1": "deep learning networks", "CS2": "database systems", "CS3": "operating systems"}
    listed = [(1, row("", "CS1", "01", "전공", "CS", "AI(x)", "Kim", "3", "월(2) A 1") + row("", "CS0", "01", "전공", "CS", "None", "", "3", "")),
              (2, row("", "CS2", "01", "전공", "CS", "DB[y]", "Lee", "3", "") + row("", "CS3", "02", "전공", "CS", "OS", "Park", "2", ""))]
    details = [(f"https://plans.example.org/?d=100&no={no}&cls=01",
                f"<div id=intro>All about {text}. And more {text}!</div><p id=a>none</p><p id=b>-</p><tbody>{row('1', text)}</tbody>")
               for no, text in topics.items()]
    return (spark.createDataFrame(listed, "page_id long, html string"), spark.createDataFrame(details, "url string, html string"))


def test_pages_to_answer(spark):
    path, table = scratch_path(spark, "courses"), scratch_path(spark, "t").rsplit("-", 1)[1]
    tables.create_if_absent(spark, f"courses_{table}", COURSE, path)
    tables.append(W.courses_from_pages(*pages(spark), TEMPLATE, PATTERNS, dept=100), path)
    courses = tables.scan(spark, path, COURSE)
    assert [(r["id"], r["course_no"], r["credit"], r["room"], r["syllabus"]) for r in courses.orderBy("id").collect()] == [
        (1, "CS1", 3, "A 1", "1: deep learning networks\n"), (2, "CS2", 3, "", "1: database systems\n"), (3, "CS3", 2, "", None)]
    assert spark.table(f"courses_{table}").count() == 3
    spark.sql(f"DROP TABLE courses_{table}")
    last = tables.last_id(spark, path, COURSE)
    again = W.courses_from_pages(*pages(spark), TEMPLATE, PATTERNS, last_id=last, dept=100)
    assert sorted(r["id"] for r in again.collect()) == [4, 5, 6]

    reviews = spark.createDataFrame(
        [(1, 1, "Hard but rewarding. Great teacher!"), (2, 1, "Great teacher."), (3, 2, "Boring lectures."), (4, 3, "fine")],
        "id long, course_id long, text string")
    stats = spark.createDataFrame([(1, 1, 4.5)], "id long, course_id long, satisfaction double")
    export, index = scratch_path(spark, "export"), scratch_path(spark, "index")
    nested.write_export(nested.nest(courses, reviews, stats), export)
    W.build_index(nested.read_export(spark, export), index)
    W.build_index(nested.read_export(spark, export), index)

    split = {"주제관련": ["deep learning networks", "networks"], "평가관련": ["great teacher"]}
    outputs = spark.createDataFrame(
        [("r1", f"[/INST] {json.dumps(split, ensure_ascii=False)}</s>"), ("r2", "[/INST] sorry</s>")], "request_id string, output string")
    opened = W.open_index(spark, index)
    answers = W.answer(opened, outputs, raw=True).cache()
    best = answers.filter("place = 1").collect()
    assert [(r["request_id"], r["course_no"], r["instructor"], r["credit"]) for r in best] == [("r1", "CS1", "Kim", "3")]
    assert best[0]["reviews"] == ["Hard but rewarding. Great teacher!", "Great teacher."]
    assert best[0]["info"].startswith("All about deep learning networks. And more") and best[0]["room"] == "A 1"
    assert {r["request_id"] for r in answers.collect()} == {"r1"}

    shown = recommend.display(answers, results=1).collect()
    assert shown[0]["course_num_class"] == "CS1-01"
    assert shown[0]["review_text"] == "Hard but rewarding. Great teacher!\n___\nGreat teacher."
    prompt = dialog.summary_prompts(
        spark.createDataFrame([("r1", "AI please")], "request_id string, text string"), recommend.evidence(answers)).first()
    assert "강의평: Hard but rewarding. Great teacher!\nGreat teacher." in prompt["prompt"] and "조건: AI please" in prompt["prompt"]
    record = json.loads(recommend.evidence(answers, whole_record=True).first()["info"])
    assert record["course_name"] == "AI(x)" and record["entity_id"] == "1"


def test_entity_of_first_stage_without_feedback_is_left_out(spark):
    queries = spark.createDataFrame(
        [("r", a, 0, 1, [1.0, 0.0]) for a in ("topic", "evaluation")],
        "request_id string, aspect string, query_idx int, n_queries int, embedding array<float>")
    topics = spark.createDataFrame([("p1", "x", [1.0, 0.0]), ("p2", "y", [0.9, 0.1])], "passage_id string, entity_id string, embedding array<float>")
    feedback = topics.filter("entity_id = 'y'").withColumn("feedback_id", F.lit("f"))
    ranking, support = recommend.recommend(queries, topics, feedback)
    assert [(r["entity_id"], r["score"], r["place"]) for r in ranking.collect()] == [("y", 0.5 * 0.65 + 1.0 * 0.35, 1)]
    assert [(r["entity_id"], r["passage_id"], r["feedback_id"]) for r in support.collect()] == [("y", "p2", "f")]


def test_an_export_may_go_before_its_sentences_are_made(spark):
    """The callback comes when courses and reviews are stored; lines that are damaged in a column that reviews do not need stay out."""
    lines = spark.range(30).select(
        F.to_json(F.struct("id", F.lit("AI (x)").alias("course_name"),
                           F.lit("One. Two!").alias("course_intro"), F.array(F.struct(F.col("id"), F.col("id").alias("course_id"), F.lit("Good. Long!").alias("text"))).alias("reviews"))).alias("value"))
    export, index, at = scratch_path(spark, "export"), scratch_path(spark, "index"), []
    damaged = spark.createDataFrame([('{"id": 99, "credit": "no number", "reviews": [{"id": 99, "course_id": 99, "text": "Bad."}]}',)], "value string")
    lines.unionByName(damaged).write.text(export)

    def read():
        at.append(sorted(os.listdir(index)))
        shutil.rmtree(export)

    W.build_index(nested.read_export(spark, export), index, read=read)
    assert at == [["course", "review"]]
    opened = W.open_index(spark, index)
    assert {name: df.count() for name, df in opened.items()} == {"course": 30, "course_sentence": 90, "review": 30, "review_sentence": 60}
    assert all(df.filter("embedding is null").count() == 0 for df in opened.values())
