from passarank.operators import requests as Q


def test_parse_and_explode(spark):
    outputs = [
        ("a", '{"주제관련": ["x", "y"], "평가관련": ["z"]}'),
        ("b", '{"주제관련": ["x"]}'),
        ("c", "no json"),
        ("d", '{"주제관련": [], "평가관련": []}'),
        ("e", None),
    ]
    parsed = Q.parse_split(spark.createDataFrame(outputs, "request_id string, output string"))
    assert {r["request_id"] for r in parsed.filter("not valid").collect()} == {"b", "c", "d", "e"}
    assert {r["request_id"]: r["state"] for r in parsed.collect()} == {
        "a": "ok", "b": "unreadable", "c": "unreadable", "d": "empty", "e": "unreadable"}
    assert sorted(tuple(r) for r in Q.sub_queries(parsed).collect()) == [
        ("a", "evaluation", 0, 1, "z"), ("a", "topic", 0, 2, "x"), ("a", "topic", 1, 2, "y")]
