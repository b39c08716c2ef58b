import pytest
from pyspark.sql import functions as F

from passarank.fixed_values import ATTENDANCE_SCALE, GRADE_SCALE
from passarank.functions.scores import cosine_distance, encode_label, round_half_even
from passarank.operators.extract import mean_grade


def test_rounding_equals_python(spark):
    means = sorted({total / n for n in range(1, 81) for total in range(n, 5 * n + 1)} | {100 + i / 20 for i in range(40)} | {0.0, 0.25, 0.35, 0.45, 0.75, 4.25, 2.45, 250.05, 0.05, 0.15, 0.01, 1e-9, -0.35, -1.3, 300.25, 1e12, 2.0**49 + 0.25})
    df = spark.createDataFrame([(m,) for m in means], "m double").select("m", round_half_even(F.col("m")).alias("r"))
    assert [(r["m"], r["r"]) for r in df.collect() if r["r"] != round(r["m"], 1)] == []


def test_labels(spark):
    df = spark.createDataFrame([(k,) for k in [*GRADE_SCALE, "없음", None]], "v string")
    assert [r[0] for r in df.select(encode_label(F.col("v"), GRADE_SCALE)).collect()] == [*GRADE_SCALE.values(), None, None]
    assert sorted(ATTENDANCE_SCALE.values()) == [1, 2, 3, 4, 5]
    with pytest.raises(Exception, match="unknown label: 없음"):
        df.filter("v = '없음'").select(encode_label(F.col("v"), GRADE_SCALE, strict=True)).collect()


def test_mean_grade(spark):
    rows = [(1, "기대 이상")] * 13 + [(1, "보통")] * 7 + [(2, "보통")] * 3 + [(2, "기대 이상")] * 5
    df = spark.createDataFrame(rows, "course_id long, badge string")
    grades = {r["course_id"]: r["grade"] for r in mean_grade(df, "course_id", "badge").collect()}
    assert grades == {1: round((13 * 5 + 7 * 3) / 20, 1), 2: 4.2}


def test_cosine_distance(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine_distance(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 2.0, 1.0]
