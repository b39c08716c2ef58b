"""Elements by depth, paths of children and character references against plain versions."""

import html as plain_html
import random
import re

import pytest
from pyspark.sql import functions as F

from passarank.functions import html as H
from passarank.operators import extract as E
from tests.conftest import plan

PIECE = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:script|style)(?=[\s/>])[^>]*>.*?(?:</(?:script|style)\s*>|\Z)|</?[a-z](?:[^>"']|"[^"]*"|'[^']*')*>|</?[a-z][^>]*>|[^<]+|<""",
    re.I | re.S,
)


def plain_elements(source, tag):
    """By a stack: closing tags without an open one are skipped, what stays open ends with the source."""
    pieces, open_, spans = PIECE.findall(source), [], []
    for at, piece in enumerate(pieces):
        if re.match(rf"<{tag}[\s/>]", piece, re.I):
            spans.append([at, at if piece.endswith("/>") else len(pieces)])
            if not piece.endswith("/>"):
                open_.append(spans[-1])
        elif re.match(rf"</{tag}[\s/>]", piece, re.I) and open_:
            open_.pop()[1] = at
    return ["".join(pieces[first + 1 : last]) for first, last in spans]


def sources():
    rng = random.Random(5)
    parts = ["<tr>", "</tr>", "<TR a='>'>", "<td title=\"</tr>\">", "</td>", "</TR >", "text & more", "<!-- <tr> -->", "<tr/>", "<br>", "<"]
    parts += ["<script>'<tr>'</script>", "<trx>", "a<b", "<td", ">", "<style>td {}</style>", "\n"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(400)] + ["", "<tr>" * 50 + "</tr>" * 30, "<tr>x</tr>" * 2000]


def test_elements_equal_those_of_a_stack(spark):
    texts = sources()
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, h string").union(spark.createDataFrame([(-1, None)], "n int, h string"))
    nested = H.elements(F.col("h"), "tr")
    staged = E.with_elements(frame.withColumn("_pieces", F.lit(1)).drop("_pieces"), "h", "tr", "staged")
    rows = {r["n"]: r for r in staged.select("n", nested.alias("tr"), "staged", H.elements(F.col("h"), "td").alias("td")).collect()}
    assert rows[-1]["tr"] is None and rows[-1]["staged"] is None
    for number, text in enumerate(texts):
        assert rows[number]["tr"] == rows[number]["staged"] == plain_elements(text, "tr")
        assert rows[number]["td"] == plain_elements(text, "td")


def test_texts_leave_out_tags_comments_and_scripts(spark):
    texts = {"a<b title='>'>c</b><!-- d --><script>e</script>&lt;f&gt;": "ac<f>", "1 < 2": "1 < 2", "": "", "<style>x": ""}
    rows = spark.createDataFrame([(t,) for t in texts], "h string").select("h", H.element_text(F.col("h")).alias("text")).collect()
    assert {r["h"]: r["text"] for r in rows} == texts


def test_references_equal_the_standard_ones(spark):
    texts = ["&amp;lt;", "&hearts; &copy 2020 &notit; &notin;", "&#x2019;&#8217 &#128; &#0; &#xD800; &#x110000;", "&unknown; & &&lt;", "&NotEqualTilde;&AMP", "x&"]
    rows = spark.createDataFrame([(t,) for t in texts], "h string").select("h", H.unescape(F.col("h")).alias("text")).collect()
    assert {r["h"]: r["text"] for r in rows} == {t: plain_html.unescape(t) for t in texts}


PAGE = (
    '<html><body><p>x</p><div id="root"><div><p>1<br>2</p><img src="a"><div class="big page">A</div>'
    "<div>B<span>s</span><span>t</span></div></div></div></body></html>"
)


def test_paths_lead_to_children(spark):
    paths = {
        "html/body/div/div/div[2]/span": ["s", "t"], "#root > div > div:nth-child(4)": ["B<span>s</span><span>t</span>"],
        "#root/div/div.page": ["A"], "#root/div/div:nth-child(1)": [], "#root/div/*": ["1<br>2", "", "A", "B<span>s</span><span>t</span>"],
        "nope/x": [], "#root/div/p": ["1<br>2"], "*/*/p": ["x"],
    }
    frame = spark.createDataFrame([(1, PAGE), (2, None)], "n int, h string")
    found = E.with_paths(frame, "h", **{f"p{i}": path for i, path in enumerate(paths)})
    first, missing = found.orderBy("n").collect()
    assert [first[f"p{i}"] for i in range(len(paths))] == list(paths.values())
    assert missing["p0"] is None and found.columns[:2] == ["n", "h"]
    with pytest.raises(ValueError):
        E.with_paths(frame, "h", p="div[x]")


def test_rows_are_cut_once(spark):
    """No filter holds a copy of the cutting expression."""
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    rows = E.required(E.map_cells(E.page_rows(pages, "div", "span"), {"link": 0}), "link")
    filters = [line for line in plan(rows).splitlines() if "Filter" in line]
    assert filters and not any("regexp_extract_all" in line for line in filters)
    assert [r["link"] for r in rows.collect()] == ["s", "s", "s"]
