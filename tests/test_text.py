"""Column functions on hand-written edge cases."""

import re

from pyspark.sql import functions as F

from passarank import fixed_values as fixed
from passarank.functions import html as H
from passarank.functions import prompts as P
from passarank.functions import text as X


def column(spark, values, function, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_normalize(spark):
    texts = ["  딥러닝, AI-101!\n좋아요ㅋㅋ ", "été", "", "---", None, "a b　c", "漢字 x"]
    cleaned = [None if t is None else re.sub(r"\s+", " ", re.sub("[^ㄱ-ㅎㅏ-ㅣ가-힣a-zA-Z0-9]", " ", t)).strip() for t in texts]
    assert column(spark, texts, X.normalize) == cleaned
    assert column(spark, ["été, 2 漢字"], lambda c: X.normalize(c, any_language=True)) == ["été 2 漢字"]


def test_title_prefix(spark):
    titles = ["자료구조(실습) 1", "C언어[실습](x)", "(실습) 컴퓨터", " 운영 체제", "", "   ", None]
    assert column(spark, titles, X.title_prefix) == ["자료구조", "C언어", "", "운영", None, None, None]


def test_strip_ordinal(spark):
    assert column(spark, ["1: a", "12:b", "a 1: b", "3 : c", ""], X.strip_ordinal) == ["a", "b", "a 1: b", "3 : c", ""]


def test_sentences_and_lines(spark):
    assert column(spark, ["A b. C? D!\nE.", "no end", "", "v1.2 ok. "], X.sentences) == [
        ["A b.", "C?", "D!", "E."], ["no end"], [""], ["v1.2 ok.", ""]]
    assert column(spark, ["a\nb\n", "a", ""], X.lines) == [["a", "b", ""], ["a"], [""]]


def test_time_and_room(spark):
    texts = ["", "월(2) 정보관 202", "월(2) 정보관 202\n수(2) 정보관 301", "월(2)", "월(2) A\n\n수(3) B", None]
    assert column(spark, texts, X.timeslot) == ["", "월(2)", "월(2) 수(2)", "월(2)", "월(2) 수(3)", None]
    assert column(spark, texts, X.room) == ["", "정보관 202", "정보관 202", "", "A", None]


def test_leading_int(spark):
    assert column(spark, ["3( 3)", "x", "", None], X.leading_int) == [3, None, None, None]


def test_numbered_lines_stop_at_sixteen(spark):
    rows = [[[f" {i} ", f"week {i}\n"] for i in range(1, n + 1)] for n in (0, 2, 17)]
    text = column(spark, rows, lambda c: X.numbered_lines(c, lambda r: r[0], lambda r: r[1]), "array<array<string>>")
    assert text[0] == "" and text[1] == "1: week 1\n2: week 2\n"
    assert text[2].count("\n") == 16 and text[2].endswith("16: week 16\n")


def test_fill(spark):
    assert column(spark, ["{x} 100%", None], lambda c: X.fill("a {v} b {v}", v=c)) == ["a {x} 100% b {x} 100%", "a  b "]


def test_html(spark):
    page = ["<tr><td>a &amp;lt; <b>b</b></td><td class='x'>2</td></tr><track><tr a='1'></tr>"]
    assert column(spark, page, lambda c: F.size(H.elements(c, "tr"))) == [2]
    cells = lambda c: H.elements(H.elements(c, "tr")[0], "td")
    assert column(spark, page, lambda c: H.cell(cells(c), 0)) == ["a &lt; b"]
    assert column(spark, page, lambda c: H.cell(cells(c), 1)) == ["2"]
    assert column(spark, page, lambda c: H.cell(cells(c), 2)) == [None]
    assert column(spark, ["x 4.5 y", "x no y", "none"], lambda c: H.number_at(c, "x (.*) y")) == [4.5, None, None]
    assert column(spark, [["'a'", "'b'"], []], H.last_badge, "array<string>") == ["b", None]


def test_split_prompt(spark):
    for variant, example in fixed.SPLIT_EXAMPLE_QUERIES.items():
        expected = fixed.SPLIT_TEMPLATE.format(example_query=example, example_answer=fixed.SPLIT_EXAMPLE_ANSWER, query="질문 {x}")
        assert column(spark, [" \n질문 {x}\t"], lambda c: P.split_prompt(c, variant)) == [expected]


def test_clean_output(spark):
    start, end = "[/INST]", "</s>"
    texts = ['q [/INST] ok {"a": [ "b"]} more</s>', 'q [/INST] {"a": 1} tail', '{"a": 1}</s>', "[/INST] nothing</s>",
             "[/INST] {open</s>", "", "x", '[/INST]} {"a"</s>', "</s>[/INST] {}"]

    def sliced(t):
        t = t[t.find(start) + len(start) : t.find(end)]
        return t[t.find("{") : t.find("}") + 1].replace(' "', '"')

    assert column(spark, texts, P.clean_output) == [sliced(t) for t in texts]


def test_history_turn_and_answer_prompt(spark):
    assert column(spark, ["hi"], lambda c: P.history_turn(c, F.lit("yo"))) == ["\n\nHuman: hi\nAI: yo"]
    prompt = column(spark, ["hi"], lambda c: P.answer_prompt(F.lit("i"), F.lit("r"), F.lit("h"), P.summary_input(c)))
    asked = fixed.SUMMARY_TEMPLATE.format(query="hi")
    assert prompt == [fixed.ANSWER_TEMPLATE.format(info="i", review="r", history="h", input=asked)]
