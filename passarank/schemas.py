"""Explicit schemas of the stored relations and of the records in flight; nothing is inferred."""

from pyspark.sql import types as T

# Names and kinds of the stored fields.
COURSE = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("course_name", T.StringType(), False),
        T.StructField("course_no", T.StringType(), False),
        T.StructField("course_class", T.StringType(), False),
        T.StructField("department", T.StringType(), False),
        T.StructField("credit", T.IntegerType(), False),
        T.StructField("course_type", T.StringType(), False),
        T.StructField("instructor", T.StringType(), False),
        T.StructField("timeslot", T.StringType()),
        T.StructField("room", T.StringType()),
        T.StructField("course_intro", T.StringType()),
        T.StructField("prerequisite", T.StringType()),
        T.StructField("syllabus", T.StringType()),
    ]
)
REVIEW = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("course_id", T.LongType(), False),
        T.StructField("text", T.StringType(), False),
    ]
)
REVIEW_STAT = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("course_id", T.LongType(), False),
        T.StructField("satisfaction", T.DoubleType(), False),
        T.StructField("workload", T.DoubleType(), False),
        T.StructField("difficulty", T.DoubleType(), False),
        T.StructField("delivery", T.DoubleType(), False),
        T.StructField("achievement", T.DoubleType(), False),
        T.StructField("grade", T.DoubleType(), False),
        T.StructField("attendance", T.DoubleType(), False),
    ]
)
# One line of the nested export. ``part`` numbers the lines of a parent in the layout with several;
# a line without it is the parent's only one, part 0.
NESTED_COURSE = T.StructType(
    COURSE.fields
    + [
        T.StructField("part", T.IntegerType()),
        T.StructField("review_stat", REVIEW_STAT),
        T.StructField("reviews", T.ArrayType(REVIEW)),
    ]
)

VECTOR = T.ArrayType(T.FloatType())
PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("html", T.StringType(), False),
    ]
)
STAT_FIELDS = ("satisfaction", "workload", "difficulty", "delivery", "achievement", "grade", "attendance")
