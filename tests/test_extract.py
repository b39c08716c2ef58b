"""Extraction on pages written by hand."""

import html as plain_html

from pyspark.sql import functions as F

from passarank.functions import html as H
from passarank.operators import extract as E
from suite import extraction


def row(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


LIST_PAGE = (
    row("", "CS101", "01", "전공", "컴퓨터학과", "자료구조 &amp; 실습", "Kim", "3(4)", "월(2) 정보관 202\n수(2) 정보관 301")
    + row("", "CS102", "02", "교양", "컴퓨터학과", "AI", "", "3", "")
    + row("", "CS103", "03", "교양", "컴퓨터학과", "OS", "Lee", "2(2)", "")
)


def test_course_rows(spark):
    pages = spark.createDataFrame([(1, LIST_PAGE)], "page_id long, html string")
    rows = [r.asDict() for r in E.course_rows(pages).orderBy("row_no").collect()]
    assert [(r["course_no"], r["course_name"], r["credit"], r["timeslot"], r["room"]) for r in rows] == [
        ("CS101", "자료구조 & 실습", 3, "월(2) 수(2)", "정보관 202"),
        ("CS103", "OS", 2, "", ""),
    ]
    urls = E.detail_urls(E.course_rows(pages), "https://plans.example.org/{course_no}/{course_class}?d={dept}", dept=100)
    assert urls.orderBy("row_no").first()["url"] == "https://plans.example.org/CS101/01?d=100"


PATTERNS = {
    "intro": r"(?s)<div id=intro>(.*?)</div>",
    "prerequisite_1": r"(?s)<p id=a>(.*?)</p>",
    "prerequisite_2": r"(?s)<p id=b>(.*?)</p>",
    "syllabus": r"(?s)<tbody>(.*?)</tbody>",
}


def test_course_details(spark):
    weeks = "".join(row(f" {i} ", f" topic {i}") for i in range(1, 19))
    page = f"<div id=intro>about</div><p id=a>one</p><p id=b>two</p><tbody>{weeks}</tbody>"
    pages = spark.createDataFrame([(1, page), (2, page + "▶ 첨부파일")], "page_id long, html string")
    full, marked = [r.asDict() for r in E.course_details(pages, PATTERNS).orderBy("page_id").collect()]
    assert full["course_intro"] == "about" and full["prerequisite"] == "one\ntwo"
    assert full["syllabus"] == "".join(f"{i}: topic {i}\n" for i in range(1, 17))
    assert marked == {"page_id": 2, "course_intro": "about", "prerequisite": None, "syllabus": None}


def test_reviews_and_stats(spark):
    def review(text, *badges):
        return f"<li><div>{text}</div>" + "".join(f"<span>{b}</span>" for b in badges) + "</li>"

    facts = "".join(f"<i class={n}>{v}</i>" for n, v in
                    [("satisfaction", 4.5), ("workload", 3), ("difficulty", 2.5), ("delivery", 5), ("achievement", 1)])
    page = facts + "<em>매번함</em>" + review("great", "A", "'기대 이상'") + review("so so", "'보통'")
    empty = facts + "<em>어쩌다</em>"
    pages = spark.createDataFrame([(1, page), (2, empty)], "course_id long, html string")
    reviews = E.review_rows(pages, "(?s)<li>(.*?)</li>", "<div>(.*?)</div>", "<span>(.*?)</span>")
    assert [(r["review_no"], r["text"], r["badge"]) for r in reviews.orderBy("review_no").collect()] == [
        (0, "great", "기대 이상"), (1, "so so", "보통")]
    scalars = {n: rf"<i class={n}>(.*?)</i>" for n in ("satisfaction", "workload", "difficulty", "delivery", "achievement")}
    stats = E.review_stats(pages, reviews, "course_id", scalars, "<em>(.*?)</em>")
    assert [tuple(r) for r in stats.collect()] == [(1, 4.5, 3.0, 2.5, 5.0, 1.0, 4.0, 5.0)]
    assert E.valid_scores(stats).count() == 1
    assert E.valid_scores(stats.withColumn("grade", F.lit(5.5))).count() == 0


def test_resume_from(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c")], "id long, k string")
    ids = lambda marker: sorted(r["id"] for r in E.resume_from(df, "id", "k", marker).collect())
    assert ids("b") == [2, 3, 4, 5] and ids("c") == [5] and ids("z") == []


def test_without_result(spark):
    entities = spark.range(6).withColumnRenamed("id", "k")
    results = spark.createDataFrame([(1,), (1,), (4,)], "k long")
    assert sorted(r["k"] for r in E.without_result(entities, results, "k").collect()) == [0, 2, 3, 5]


def test_page_text_beyond_ascii(spark):
    from passarank.functions import html as H
    from passarank.functions import text as X

    source = "<TR><TD>a&middot;&copy;&#8217;&#x41;&amp;lt;&none;&#1114112;&#0; & </TD ><td class='x'>월(2)&nbsp;관</td></TR>"
    df = spark.createDataFrame([(source, "\u3000월(2)\u00a0관\u3000401\x1c", None)], "s string, line string, missing string")
    cells = H.elements(F.element_at(H.elements(F.col("s"), "tr"), 1), "td")
    row = df.select(
        H.cell(cells, 0).alias("a"), H.cell(cells, 1).alias("b"), X.timeslot(F.col("line")).alias("t"), X.room(F.col("line")).alias("r"),
        X.strip(F.col("line")).alias("s"), X.title_prefix(F.col("line")).alias("p"), H.element_text(F.col("missing")).alias("none"),
    ).first()
    assert tuple(row) == ("a·©’A&lt;&none;\ufffd\ufffd & ", "월(2)\u00a0관", "월(2)", "관 401", "월(2)\u00a0관\u3000401", "월", None)


def test_pages_of_a_small_file_are_dealt_out(spark, tmp_path):
    """Parts and events are small, the pages made of them are not."""
    parts = spark.range(40).selectExpr("id AS p_partkey", "'part' AS p_name", "'b' AS p_brand", "'t' AS p_type", "7 AS p_size")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    events = spark.range(400).selectExpr("id AS event_id", "id % 90 AS user_id", "'click' AS event_type")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    cores = spark.sparkContext.defaultParallelism
    rows = extraction.nested_page_rows(spark, str(tmp_path))
    assert rows.select(F.spark_partition_id()).distinct().count() >= cores / 2 and rows.count() == 120
    blocks = extraction.review_blocks(spark, str(tmp_path))
    assert blocks.select(F.spark_partition_id()).distinct().count() > cores
    assert blocks.count() == 400


def test_other_tags_do_not_cut_a_page(spark):
    page = "<table>" + "<tr a='</tr>'>" + "<b>x</b><!-- <tr> -->" * 3000 + "</tr>" + "<i>y</i>" * 3000
    pieces, scripts = spark.range(1).select(H._split_at(F.lit(page), "tr"), H._split_at(F.lit("<p>a<script><tr></script>"), "script")).first()
    assert len(pieces) == 5 and "".join(pieces) == page
    assert scripts == ["<p>", "a", "<script><tr></script>"]


def test_common_references(spark):
    texts = ["&#39;a&#39", "&#039;&#38;lt;", "&ampx&lt;&gt&", "& &#; &;&#160;|", "&#39x &quot;&apos;&nosuch;"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", H.unescape(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in sorted(rows)] == [plain_html.unescape(t) for t in texts]
