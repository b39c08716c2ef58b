"""Running totals and histories cut into blocks against the plain definition."""

import random

import pytest
from pyspark.sql import functions as F

from passarank.operators.dialog import histories, history_fold, reset_sessions
from passarank.plans.prefix import dense_ids, running_total
from tests.conftest import plan


def events(n=3000, seed=1):
    """A third of all rows belong to one user, some to none."""
    rng = random.Random(seed)
    users = [7 if rng.random() < 0.34 else rng.choice([None, *range(40)]) for _ in range(n)]
    return [(i, users[i], rng.randint(0, 500), rng.random() < 0.2) for i in rng.sample(range(n), n)]


def test_reset_sessions_in_blocks(spark):
    rows = events()
    df = spark.createDataFrame(rows, "id long, user int, ts int, reset boolean").repartition(4)
    expected, totals = {}, {}
    for i, user, ts, reset in sorted(rows, key=lambda r: (r[2], r[0])):
        totals[user] = totals.get(user, 0) + reset
        expected[i] = totals[user]
    blocked = running_total(df, F.col("reset").cast("int"), "n", ["ts", "id"], ["user"], rows_per_task=100)
    assert {r["id"]: r["n"] for r in blocked.collect()} == expected
    window = reset_sessions(df, "user", ["ts", "id"], F.col("reset"))
    assert {r["id"]: r["session_no"] for r in window.collect()} == expected


def test_dense_ids_in_blocks(spark):
    rows = events()
    df = spark.createDataFrame(rows, "id long, user int, ts int, reset boolean").repartition(4)
    order = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    for ranges in (30, None):
        found = dense_ids(df, ["ts", "id"], ranges=ranges)
        assert {r["id"]: r["row_id"] for r in found.collect()} == {i: str(n) for n, i in enumerate(order)}
        assert "SinglePartition" not in plan(found) and "Window" not in plan(found)
    assert dense_ids(df.limit(0), ["ts", "id"]).count() == 0


def test_history(spark):
    rng = random.Random(3)
    turns = [(s, t, f"q{s}.{t}", f"a{s}.{t}") for s, n in ((1, 300), (2, 1), (3, 20)) for t in sorted(rng.sample(range(-5, 900), n))]
    expected, text = {}, {}
    for s, t, q, a in turns:
        expected[s, t] = text.get(s, "")
        text[s] = expected[s, t] + f"\n\nHuman: {q}\nAI: {a}"
    df = spark.createDataFrame(rng.sample(turns, len(turns)), "session_id long, turn long, human string, ai string")
    folded = {(r["session_id"], r["turn"]): r["history"] for r in history_fold(df, block=16).collect()}
    assert folded == expected


def test_histories_after_resets(spark):
    rows = events(900)
    df = spark.createDataFrame(rows, "id long, user int, ts int, reset boolean").filter("user is not null")
    df = df.withColumns({"human": F.concat(F.lit("q"), "id"), "ai": F.concat(F.lit("a"), "id")}).repartition(3)
    expected, told, numbers = {}, {}, {}
    for i, user, _, reset in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[2], r[0])):
        if reset:
            told[user], numbers[user] = "", numbers.get(user, 0) + 1
        expected[i] = (numbers.get(user, 0), told.get(user, ""))
        told[user] = told.get(user, "") + f"\n\nHuman: q{i}\nAI: a{i}"
    found = histories(df, "user", ["ts", "id"], F.col("reset"), block=4).collect()
    assert {r["id"]: (r["session_no"], r["history"]) for r in found} == expected


@pytest.mark.parametrize("first", [-37, 0, 10**12])
def test_history_of_a_very_long_session(spark, first):
    """Far more blocks than a window takes; sparse turn numbers, missing answers and sessions of one turn."""
    rng = random.Random(first)
    rows = [("long", first + n, f"q{n}", None if n % 7 == 0 else f"a{n}") for n in range(900) if rng.random() < 0.8]
    rows += [("short", first + 5, "q", "a"), ("late", first + 10**5, "q", "a"), ("late", first + 10**5 + 9, "x", "y")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id string, turn long, human string, ai string").repartition(5)
    found = history_fold(df, block=4, blocks_per_window=4)
    expected, texts = {}, {}
    for session, turn, human, ai in sorted(rows):
        expected[session, turn] = texts.get(session, "")
        if ai is not None:
            texts[session] = texts.get(session, "") + f"\n\nHuman: {human}\nAI: {ai}"
    assert {(r["session_id"], r["turn"]): r["history"] for r in found.collect()} == expected


def test_history_tree_holds_no_session_in_one_window(spark):
    df = spark.range(400).selectExpr("'s' AS session_id", "id AS turn", "'q' AS human", "'a' AS ai")
    for limit, held in ((4, False), (200, True)):
        found = history_fold(df, block=4, blocks_per_window=limit)._jdf.queryExecution().analyzed().toString()
        specs = [part.split(")")[0] for part in found.split("windowspecdefinition(")[1:]]
        assert specs and any("_block" in s.split(",")[1] and "ASC" in s.split(",")[1] for s in specs) == held
