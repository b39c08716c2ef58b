"""Periodic runs, exact clustering and first occurrences against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from passarank.llm import fmindex, kernels, queries, repeats, runs, shallot, wordspans
from tests.conftest import plan

SMALLEST = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, id long, text_ string, start int"
ODD = "doc_id long, text string, row int, windows int, key string, marks string, start string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- words


def test_spans_are_the_words_between_ascii_blanks():
    import pyarrow as pa

    texts = ["", None, "one two x y\x1cz  three\t\x0b\x0c\r\nfour", " lead", "trail ", "\n", "äö 中文 é", "a", "joined", "b c"]
    for column in (pa.array(texts), pa.array(["skip me"] + texts + ["too"]).slice(1, len(texts))):
        spans = wordspans.Spans(column)
        hashes = spans.hashes()
        named = {}
        for number, text in enumerate(texts):
            mine = range(spans.borders[number], spans.borders[number + 1])
            assert [spans.stretch(i, i).decode() for i in mine] == words_of(text)
            for i, word in zip(mine, words_of(text)):
                assert named.setdefault(word, hashes[i]) == hashes[i]
        assert len(set(named.values())) == len(named)
    long = ["a " * 1000, "b " * 10, "", "c " * 3000]
    assert list(wordspans.slices(pa.array(long), 2100)) == [(0, 3), (3, 4)]
    assert list(wordspans.slices(pa.array([], pa.string()))) == []
    assert list(wordspans.slices(pa.array(["", None]))) == [(0, 2)]


# ---------------------------------------------------------------- op11


def plain_runs(words, least=6, periods=4):
    found, n = [], len(words)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, periods * q):
                stretch = words[i : i + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def strings(rng):
    """Random, periodic, nested periodic, Fibonacci and Thue-Morse words."""
    kind, letters = rng.randint(0, 4), rng.randint(1, 3)
    if kind == 0:
        return [rng.randint(0, letters) for _ in range(rng.randint(0, 60))]
    if kind == 1:
        out = []
        while len(out) < rng.randint(1, 150):
            part = [rng.randint(0, letters) for _ in range(rng.randint(1, 24))]
            out += [part[i % len(part)] for i in range(rng.randint(1, len(part) * 9))]
        return out
    if kind == 2:
        a, b = [0], [0, 1]
        for _ in range(rng.randint(1, 7)):
            a, b = b, b + a
        return b * rng.randint(1, 6)
    if kind == 3:
        part = [rng.randint(0, 1)]
        for _ in range(4):
            part = part * rng.randint(1, 5) + [rng.randint(0, 2)] * rng.randint(0, 2)
        return part[:300] * 2
    return [bin(i).count("1") % 2 for i in range(rng.randint(0, 150))] * rng.randint(1, 5)


def test_runs_equal_plain_ones():
    rng, seen = random.Random(7), 0
    for _ in range(250):
        texts = [strings(rng) for _ in range(rng.randint(1, 4))]
        borders = np.cumsum([0] + [len(t) for t in texts])
        flat = np.array([w for t in texts for w in t], np.uint64)
        start, length, period = runs.runs(kernels.mix64(flat + np.uint64(3)), borders)
        got = collections.defaultdict(list)
        for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()):
            text = int(np.searchsorted(borders, s, side="right")) - 1
            got[text].append((s - int(borders[text]), n, q))
        for number, words in enumerate(texts):
            expected = plain_runs(words)
            seen += len(expected)
            assert got[number] == expected
    assert seen > 1000


def test_runs_of_few_periods_are_refused():
    with pytest.raises(ValueError):
        runs.runs(np.zeros(3, np.uint64), np.array([0, 3]), least_periods=3)


def plain_report(doc_id, text, share=10):
    words = words_of(text)
    n = len(words)
    checksum = zlib.crc32(str(doc_id).encode()) if doc_id is not None else None
    if checksum is not None and checksum % share == 0 and n:
        g = checksum // share
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    return (
        doc_id, len(found), *(best or (None,) * 3), math.floor(1000 * best[1] / best[2]) if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_reports_of_odd_rows_equal_plain_ones(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{x}" for x in strings(rng)) for _ in range(120)] + [None, "", " \t\n", "ha " * 400, "ä ö ä ö ä ö ä ö", "a a a a"]
    rows = [(i, t, 0, "x", 1) for i, t in enumerate(texts)] + [(None, "no no no no no no", 0, None, 2), (3, texts[3], 0, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = runs.periodic_runs(docs, rewrite=10).collect()
    columns = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    expected = [plain_report(i, t) for i, t, *_ in rows]
    assert collections.Counter(tuple(r[c] for c in columns) for r in got) == collections.Counter(expected)
    for row in got:
        assert sha(row["collapsed"]) == row["collapsed_sha256"]
        assert sha("".join(f"{r['start']},{r['length']},{r['period']}\n" for r in row["runs"])) == row["runs_sha256"]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and r[1] for i, r in enumerate(expected))
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_reports_of_the_whole_table_equal_plain_ones(spark):
    got = queries.op11_periodic_runs(spark, SMALLEST).collect()
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet").collect()
    short = {d["doc_id"]: d["text"] for d in docs if len(words_of(d["text"])) <= 1500}
    assert len(got) == len(docs) and len(short) > 150
    assert {tuple(r[c] for c in columns) for r in got if r["doc_id"] in short} == {plain_report(i, t) for i, t in short.items()}


# ---------------------------------------------------------------- op12


def plain_clusters(rows, count=8, rounds=10, dimensions=64):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    x = np.array([v for _, v in kept], np.int64)
    centres = np.array([v for _, v in order[:count]], np.int64)
    for turn in range(rounds + 1):
        distance = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
        near = distance.argmin(axis=1)
        if turn < rounds:
            for j in range(len(centres)):
                if (near == j).any():
                    centres[j] = x[near == j].sum(axis=0) // (near == j).sum()
    own = distance.min(axis=1)
    digest = [sha(",".join(map(str, c.tolist()))) for c in centres]
    return [(kept[i][0], int(near[i]), int(own[i]), int(own[near == near[i]].sum()), int(own.sum()), digest[near[i]]) for i in range(len(kept))]


COLUMNS = ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def check_clusters(spark, rows, **settings):
    floats = [(i, v and [None if x is None else float(x) for x in v], 0, 0) for i, v in rows]
    frame = spark.createDataFrame(floats, "vec_id long, embedding array<float>, block int, near int").repartition(3)
    found, _ = shallot.clusters(frame, **settings)
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in found.collect()) == collections.Counter(plain_clusters(rows, **settings))


def test_clusters_of_odd_vectors_equal_plain_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    rows += [(3, rows[3][1]), (None, [0.5, 0, 0, 0]), (70, None), (71, []), (72, [1.0, None, 0, 0]), (73, [float("nan"), 0, 0, 0])]
    rows += [(74, [float("-inf"), 0, 0, 0]), (75, [0.0] * 5), (76, [0.0] * 4), (77, [-0.3] * 4), (3, [0.1, 0.2, 0.3, 0.4])]
    check_clusters(spark, rows, dimensions=4)
    check_clusters(spark, [(i, [1.0, 2.0, -3.0, 0.0]) for i in range(9)], dimensions=4, rounds=2)
    check_clusters(spark, rows[:3], dimensions=4, rounds=2)


def test_clusters_without_vectors_and_beyond_the_long_type(spark):
    frame = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    found, centres = shallot.clusters(frame)
    assert found.count() == 0 and found.columns == COLUMNS and len(centres) == 0
    with pytest.raises(Exception, match="leave the long type"):
        shallot.clusters(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>"))


def test_bounds_skip_distances_and_keep_the_nearest(monkeypatch):
    rng, measured, all_ = np.random.default_rng(3), [0], 0
    squared = shallot.squared
    monkeypatch.setattr(shallot, "squared", lambda a, b: measured.__setitem__(0, measured[0] + len(a)) or squared(a, b))
    for trial in range(120):
        count, size = int(rng.integers(1, 9)), int(rng.integers(8, 300))
        spread = int(rng.choice([2, 4, 40, 1000]))
        x = rng.integers(-spread, spread + 1, (size, int(rng.integers(1, 10)))).astype(np.int64)
        if trial % 3 == 0:
            x = x + rng.integers(0, 4, (size, 1)) * spread * 3
        points, before, state = x[rng.permutation(size)[:count]].copy(), None, None
        for _ in range(8):
            state = shallot.assign(x, state, shallot.Centroids(points, before))
            distance = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
            all_ += size * count
            assert (distance.argmin(axis=1) == state[0]).all()
            after = points.copy()
            for j in range(count):
                if (state[0] == j).any():
                    after[j] = x[state[0] == j].sum(axis=0) // (state[0] == j).sum()
            before, points = points, after
    assert measured[0] < 0.45 * all_


def test_rounds_shuffle_no_vectors(spark):
    frame = spark.range(40).select(F.col("id").alias("block"), F.lit(b"x").alias("vectors"))
    state = frame.select("block", *[F.lit(b"").alias(n) for n in ("near", "second", "upper", "lower")])
    joined = shallot._joined(shallot.bucketed(frame.repartition(4, "block"), "block", 4), shallot.bucketed(state, "block", 4))
    assert "Exchange" not in plan(joined) and joined.count() == 40
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("passarank_")]


# ---------------------------------------------------------------- op13


def test_index_gives_matching_statistics():
    rng = np.random.default_rng(1)
    for _ in range(60):
        size, letters, depth = int(rng.integers(1, 120)), int(rng.integers(1, 5)), int(rng.integers(1, 7))
        text = rng.integers(0, letters + 1, size + 1)
        text[0], size = 0, size + 1
        index = fmindex.Index(text, letters + 1, depth)
        ends = np.array([e for e in range(depth, size) if text[e - depth + 1 : e + 1].all()], np.int64)
        if not ends.size:
            continue
        length, low, high = index.statistics(text, ends, depth)
        for end, found in zip(ends.tolist(), length.tolist()):
            def places(k):
                return [i for i in range(size - k + 1) if (text[i : i + k] == text[end - k + 1 : end + 1]).all()]

            assert found == max([k for k in range(depth + 1) if k == 0 or len(places(k)) > 1])
        full = np.flatnonzero(length == depth)
        if full.size:
            first = index.earliest(low[full], high[full])
            for i, place in zip(full.tolist(), first.tolist()):
                want = text[ends[i] - depth + 1 : ends[i] + 1]
                assert place == next(p for p in range(size) if p + depth <= size and (text[p : p + depth] == want).all())


def plain_first_occurrences(rows, window):
    """``rows`` in the order of documents."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = words_of(text)
        covered = set()
        for i in range(len(words) - window + 1):
            held = tuple(words[i : i + window])
            if held in seen:
                covered.update(range(i, i + window))
            seen.add(held)
        kept = [w for i, w in enumerate(words) if i not in covered]
        out.append((doc_id, len(words), len(covered), sha(" ".join(kept))))
    return out


def corpus(seed, count=150, letters=6):
    """Short texts with shared passages, copies, near copies and repeats inside a text."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, letters)}"
    passages = [[word() for _ in range(rng.randint(5, 40))] for _ in range(6)]
    texts = []
    for _ in range(count):
        out = []
        for _ in range(rng.randint(0, 6)):
            out += rng.choice(passages) if rng.random() < 0.4 else [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))]
        texts.append(out)
        if rng.random() < 0.2 and texts:
            copy = list(rng.choice(texts))
            if copy and rng.random() < 0.5:
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(copy)
    return [" ".join(t) for t in texts] + [None, "", " ".join(["line of five common words"] * 60)]


@pytest.mark.parametrize("settings", [{}, {"crowded": 3}, {"shard_words": 200}, {"crowded": 1, "gram": 3}, {"window": 8}])
def test_first_occurrences_equal_plain_ones(spark, settings):
    rows = [(i * 7 % 1000, t) for i, t in enumerate(corpus(len(settings) + settings.get("crowded", 0)))]
    docs = spark.createDataFrame([(*r, 1, 2, "k", "m", "s") for r in rows], ODD).repartition(5)
    found = repeats.without_repeats(docs, **settings)
    got = {tuple(r)[:4] for r in found.collect()}
    expected = plain_first_occurrences(sorted(rows), settings.get("window", 20))
    assert got == set(expected) and sum(r[2] for r in expected) > 1000


def test_first_occurrences_of_odd_rows(spark):
    copy = " ".join(f"c{i}" for i in range(40))
    rows = [(5, copy), (5, copy), (None, copy), (None, copy), (9, None), (9, ""), (-3, copy + " more"), (7, "short text")]
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    got = sorted((r["id"] is None, r["id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in found)
    assert got == sorted(
        [(False, -3, 41, 0, copy + " more"), (False, 5, 40, 40, ""), (False, 5, 40, 40, ""), (True, 0, 40, 40, ""), (True, 0, 40, 40, "")]
        + [(False, 9, 0, 0, ""), (False, 9, 0, 0, ""), (False, 7, 2, 0, "short text")]
    )
    same = repeats.without_repeats(spark.createDataFrame(rows[:2], "doc_id long, text string").repartition(2)).collect()
    assert sorted(r["n_removed"] for r in same) == [0, 40]
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=5)


def test_first_occurrences_of_the_whole_table_equal_plain_ones(spark):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet").orderBy("doc_id").collect()
    got = queries.op13_first_occurrences(spark, SMALLEST).collect()
    assert {tuple(r) for r in got} == set(plain_first_occurrences([(d["doc_id"], d["text"]) for d in docs], 20))
