"""Language ID, near duplicates, leaks, licenses and toxicity against plain versions."""

import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passarank.llm import decontaminate, kernels, langid, licenses, neardup, toxicity

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, folder=SMALL):
    return spark.read.parquet(f"{folder}/documents.parquet")


def words_of(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


# ---------------------------------------------------------------- kernels


def test_words_and_shingles_agree_with_plain_ones():
    texts = ["", None, "One two, two; TWO three_four", "a b c d e f g a b c d e", "äöü 中文 ١٢٣ x1", "..."]
    hashes, borders = kernels.Words().hashes(texts)
    named = {}
    for number, text in enumerate(texts):
        mine = hashes[borders[number] : borders[number + 1]].tolist()
        assert len(mine) == len(words_of(text))
        for word, value in zip(words_of(text), mine):
            assert named.setdefault(word, value) == value
    assert len(set(named.values())) == len(named)
    values, edges = kernels.shingles(hashes, borders, 5)
    plain = [max(1, len(words_of(t)) - 4) if words_of(t) else 0 for t in texts]
    assert np.diff(edges).tolist() == plain
    owner, found, counts = kernels.counted(values, edges)
    expected = collections.Counter(zip(np.repeat(np.arange(len(texts)), np.diff(edges)).tolist(), values.tolist()))
    assert dict(zip(zip(owner.tolist(), found.tolist()), counts.tolist())) == expected


def test_pieces_of_a_long_text_give_the_same_words():
    text = " ".join(f"word{i % 977}" for i in range(200_000))
    whole, _ = kernels.Words().hashes([text[:1000]])
    hashes, borders = kernels.Words().hashes([text, "x"])
    assert borders.tolist() == [0, 200_000, 200_001]
    assert hashes[:100].tolist() == whole[:100].tolist()
    assert len(set(hashes[:200_000].tolist())) == 977


# ---------------------------------------------------------------- language ID


def plain_profile(texts, size):
    counts = collections.Counter()
    for text in texts:
        letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        for word in letters:
            padded = f" {word} "
            counts.update(word)
            counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
            counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:size]


def unpacked(gram):
    return "".join(chr(c) for c in (gram >> 42, gram >> 21 & (1 << 21) - 1, gram & (1 << 21) - 1) if c)


def test_profiles_and_distances_equal_plain_ones(spark):
    rows = [r for r in documents(spark).limit(120).collect()]
    by_lang = collections.defaultdict(list)
    for row in rows[:80]:
        by_lang[row["lang"]].append(row["text"])
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], None) for r in rows[:80]], SCHEMA).repartition(5)
    profiles = langid.learn(docs, profile=100)
    plain = {lang: plain_profile(texts, 100) for lang, texts in by_lang.items()}
    assert {lang: [unpacked(g) for g in p] for lang, p in profiles.items()} == plain
    tested = spark.createDataFrame([(r["doc_id"], r["text"], None, None) for r in rows], SCHEMA)
    found = {r["doc_id"]: r for r in langid.predict(tested, profiles, keep=["doc_id"], profile=100).collect()}
    for row in rows:
        own = plain_profile([row["text"]], 100)
        off = {
            lang: sum(abs(theirs.index(g) - i) if g in theirs else 100 for i, g in enumerate(own)) / len(own)
            for lang, theirs in plain.items()
        }
        best = min(sorted(off), key=off.get)
        assert found[row["doc_id"]]["lang_pred"] == best
        assert found[row["doc_id"]]["score"] == pytest.approx(1 - off[best] / 100)


def test_language_edge_cases(spark):
    learned = {"xx": langid.learn(spark.createDataFrame([(1, "abc abd", "xx", "s")], SCHEMA))["xx"]}
    rows = [(1, None), (2, ""), (3, "123 !!"), (None, "abc"), (None, "abc"), (5, "abc " * 300_000), (6, "Ж")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = langid.predict(docs, learned, keep=["doc_id"]).collect()
    assert len(found) == len(rows)
    assert [(r["lang_pred"], r["score"]) for r in found if r["doc_id"] in (1, 2, 3)] == [("und", 0.0)] * 3
    assert all(r["lang_pred"] == "xx" for r in found if r["doc_id"] in (None, 5))
    assert {r["score"] for r in found if r["doc_id"] == 6} == {0.0}
    assert langid.predict(docs, {}, keep=["doc_id"]).filter("lang_pred = 'und'").count() == len(rows)
    assert langid.learn(docs.limit(0).withColumn("lang", F.lit("a"))) == {}


def test_language_held_out_accuracy(spark):
    docs = documents(spark)
    profiles = langid.learn(docs.filter(~langid.held_out()))
    judged = langid.predict(docs.filter(langid.held_out()), profiles, keep=["lang"])
    assert judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


# ---------------------------------------------------------------- near duplicates


def plain_similarity(a, b):
    def weights(text):
        words = words_of(text)
        found = collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
        total = sum(found.values())
        return {k: v / total for k, v in found.items()}

    x, y = weights(a), weights(b)
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys())


def plain_classes(rows):
    """Classes of (id, text) by all pairs that share a shingle."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = collections.defaultdict(set)
    for i, (_, text) in enumerate(rows):
        words = words_of(text)
        for k in range(max(1, len(words) - 4) if words else 0):
            holders[tuple(words[k : k + 5])].add(i)
    pairs = {p for h in holders.values() for p in itertools.combinations(sorted(h), 2)}
    for i, j in pairs:
        if root(i) != root(j) and plain_similarity(rows[i][1], rows[j][1]) >= 0.8:
            parent[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[root(i)] = min(name, least.get(root(i), name))
    return {name: least[root(i)] for i, (name, _) in enumerate(rows)}


def variants(seed=3):
    """A text and edited copies of it and of each other, near the threshold, and other texts."""
    chance = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows, texts = [], [base]
    for _ in range(120):
        words = list(chance.choice(texts[-30:]))
        for _ in range(chance.randrange(1, 9)):
            words[chance.randrange(len(words))] = f"e{chance.randrange(10**6)}"
        texts.append(words)
    texts += [[f"o{chance.randrange(50)}" for _ in range(chance.randrange(1, 40))] for _ in range(60)]
    texts += texts[:40]
    chance.shuffle(texts)
    for i, words in enumerate(texts):
        rows.append((i, " ".join(words)))
    return rows


def test_classes_equal_brute_force_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    found = {r["id"]: r["class_id"] for r in neardup.near_duplicates(documents(spark)).collect()}
    assert found == plain_classes(rows)


def test_classes_equal_brute_force_near_the_threshold(spark):
    rows = variants()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {r["id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert found == plain_classes(rows)


def test_similarity_of_weighted_sets():
    chance = random.Random(1)
    for _ in range(20):
        a, b = (" ".join(chance.choice("abcdefgh") for _ in range(30)) for _ in range(2))
        b = b + " " + a[:40]
        held = neardup.Weighted(2)
        mine = [held(k, FakeScalar(t)) for k, t in (("a", a), ("b", b))]

        def weights(text):
            words = text.split()
            found = collections.Counter(zip(words, words[1:]))
            return {k: v / sum(found.values()) for k, v in found.items()}

        x, y = weights(a), weights(b)
        expected = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
        assert neardup.similarity(*mine[0][:2], *mine[1][:2]) == pytest.approx(expected)
        assert neardup.alike(*mine) == pytest.approx(expected)


class FakeScalar:
    def __init__(self, value):
        self.value = value

    def as_py(self):
        return self.value


def test_tiles_with_an_empty_side():
    schema = pa.schema([("key", pa.binary()), ("root", pa.binary()), ("text", pa.string())])
    text = " ".join(f"w{i}" for i in range(50))
    one = pa.table([[b"a", b"b"], [b"a", b"b"], [text, "other words altogether"]], schema=schema)
    two = pa.table([[b"c"], [b"c"], [text + " more"]], schema=schema)
    link = neardup._tile_linker(5, 0.8)
    assert link(one, two).to_pylist() == [{"a": b"a", "b": b"c"}]
    assert link(schema.empty_table(), two).num_rows == link(one, schema.empty_table()).num_rows == 0


def test_sketch_estimates_similarity():
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" for i in range(80, 480))
    hashes, borders = kernels.Words().hashes([a, b])
    owner, values, counts = kernels.counted(*kernels.shingles(hashes, borders, 5))
    winner = neardup.registers(owner, values, counts, 2, 2000)
    assert (winner[0] == winner[1]).mean() == pytest.approx(316 / 476, abs=0.05)


def test_near_duplicate_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, None), (1, None), (2, ""), (3, ""), (4, "!!"), (5, "short text"), (6, "Short  TEXT."), (7, "short"),
        (8, text), (9, text + " more"), (9, text + " more"), (None, text), (None, None), (10, "x " * 400_000),
    ]
    docs = spark.createDataFrame([(i, t, k % 3, "e") for k, (i, t) in enumerate(rows)], "doc_id long, text string, key long, band string")
    found = neardup.near_duplicates(docs).select("id", "class_id").collect()
    assert sorted(found, key=repr) == sorted(
        [(1, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8), (9, 8), (9, 8), (None, 8), (None, None), (10, 10)], key=repr
    )
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 1, 2, 3, 4, 5, 7, 8, None, 10], key=repr)
    again = spark.createDataFrame([(1, text)] * 5, "doc_id long, text string")
    assert neardup.without_near_duplicates(again).count() == 1
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- leaks


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    chance = random.Random(5)
    items = [(i, " ".join("".join(chance.choice("abcdef") for _ in range(chance.randrange(2, 7))) for _ in range(chance.randrange(7, 16)))) for i in range(12)]
    docs = []
    for i in range(80):
        noise = ["".join(chance.choice("abcdef") for _ in range(chance.randrange(2, 7))) for _ in range(30)]
        chars = list(chance.choice(items)[1])
        for _ in range(chance.randrange(0, 8)):
            at = chance.randrange(len(chars))
            chars[at : at + chance.randrange(0, 2)] = chance.choice(["", "x", "yz"])
        docs.append((i, " ".join(noise[:15]) + "  \n" + "".join(chars).upper() + " " + " ".join(noise[15:])))
    found = decontaminate.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=200
    ).collect()
    expected = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        distance = edit_distance_inside(item, decontaminate.plain(text))
        if distance <= decontaminate.allowed(len(item), decontaminate.BUDGET) and len(item) >= decontaminate.LEAST_CHARS:
            expected[d, i] = distance
    assert len(expected) > 20 and {(r["id"], r["item_id"]): r["distance"] for r in found} == expected
    for r in found:
        stretch = decontaminate.plain(dict(docs)[r["id"]])[r["start"] : r["stop"]]
        assert edit_distance_inside(stretch, dict(items)[r["item_id"]]) <= r["distance"]


def test_leaks_of_documents_hold_every_verbatim_item(spark):
    docs, items = documents(spark), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    found = {(r["id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()}
    plain = decontaminate.plain
    texts = [(r["item_id"], plain(r["text"])) for r in items.collect()]
    verbatim = {(d["doc_id"], i) for d in docs.collect() for i, t in texts if t in plain(d["text"])}
    assert verbatim <= found
    left = decontaminate.without_leaks(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in found})


def test_leak_edge_cases(spark):
    item = "a passage that is certainly long enough to be looked for"
    items = spark.createDataFrame([(1, item), (1, item), (2, item), (3, None), (4, ""), (5, "short")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, f"x {item}"), (4, "no " * 200_000 + item), (5, "short")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, item string")
    found = decontaminate.find_leaks(docs, items)
    assert sorted(((r["id"], r["item_id"]) for r in found.collect()), key=repr) == sorted(
        [(3, 1), (3, 1), (3, 2), (3, 2), (None, 1), (None, 2), (4, 1), (4, 2)], key=repr
    )
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(docs, items).collect()) == [1, 2, 5]
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0


def test_short_items_are_found_as_whole_words(spark, tmp_path):
    import corpus_pipeline
    from passarank.llm import queries

    long = "a passage that is certainly long enough to be looked for"
    rows = [(1, "A  Short\nitem."), (2, "a short items"), (3, "ja short item"), (4, "a shirt item"), (5, "a short items, a short item"), (6, long[:-1] + "x")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "a short item"), (2, long), (3, " "), (4, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = decontaminate.find_leaks(docs, spark.read.parquet(str(tmp_path / "benchmark.parquet")), short_items=True).collect()
    assert sorted((r["id"], r["item_id"], r["distance"]) for r in found) == [(1, 1, 0), (5, 1, 0), (6, 2, 1)]
    assert {r["id"]: (r["start"], r["stop"]) for r in found if r["item_id"] == 1} == {1: (0, 12), 5: (15, 27)}
    assert queries.QUERIES["op10_benchmark_leaks"](spark, str(tmp_path)).count() == 3
    left = corpus_pipeline.benchmark(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4]


# ---------------------------------------------------------------- licenses


def test_winnowing_keeps_the_least_of_each_window():
    chance = random.Random(2)
    for _ in range(50):
        hashes = np.array([chance.randrange(30) for _ in range(chance.randrange(1, 40))], np.uint64)
        window = chance.randrange(1, 6)
        places = set(licenses.winnow(hashes, window).tolist())
        plain = set()
        for start in range(max(1, len(hashes) - window + 1)):
            part = hashes[start : start + window].tolist()
            plain.add(start + max(k for k, v in enumerate(part) if v == min(part)))
        assert places == plain


def test_alignment_of_edited_templates(spark):
    template = " ".join(f"t{i}" for i in range(60))
    words = template.split()
    edited = words[:10] + ["new", "words"] + words[12:30] + words[33:]  # 2 replaced, 3 left out: 55 of 60
    docs = spark.createDataFrame(
        [(1, "a b c " + template + " d"), (2, "a b " + " ".join(edited) + " c d"), (3, " ".join(words[:30])),
         (4, template + " between " + template), (5, None), (6, ""), (None, template), (7, "z " * 300_000 + template)],
        "doc_id long, text string",
    )
    found = licenses.scan(docs, {"T": template, "none": "", "other": "u v w x y z"}).collect()
    spans = sorted(((r["id"], r["matched_words"], r["start_word"], r["stop_word"]) for r in found), key=repr)
    assert spans == sorted(
        [(1, 60, 3, 63), (2, 55, 2, 59), (4, 60, 0, 60), (4, 60, 61, 121), (None, 60, 0, 60), (7, 60, 300_000, 300_060)], key=repr
    )
    assert {r["license"] for r in found} == {"T"} and licenses.scan(docs.limit(0)).count() == 0
    one_by_one = licenses.scan(docs, {"T": template, "other": "u v w x y z"}, block_words=1)
    assert one_by_one.count() == len(found)


@pytest.mark.parametrize("times", [1, 2, 20])
@pytest.mark.parametrize("between", ["", " x", " and more words follow here"])
def test_adjacent_short_notices_are_all_found(spark, times, between):
    names = ["MIT", "CC-BY-NC-4.0", "Apache-2.0", "GPL-3.0"]
    docs = spark.createDataFrame([(i, "before " + (licenses.TEMPLATES[n] + between + " ") * times) for i, n in enumerate(names)], "doc_id long, text string")
    found = collections.defaultdict(list)
    for r in licenses.scan(docs, {n: licenses.TEMPLATES[n] for n in names}).collect():
        assert r["license"] == names[r["id"]] and r["coverage"] == 1.0
        found[r["id"]].append((r["start_word"], r["stop_word"]))
    for i, name in enumerate(names):
        size, step = len(words_of(licenses.TEMPLATES[name])), len(words_of(licenses.TEMPLATES[name] + between))
        assert sorted(found[i]) == [(1 + k * step, 1 + k * step + size) for k in range(times)]


def test_license_lines_of_documents(spark):
    found = licenses.scan(documents(spark)).collect()
    lines = {"Apache-2.0": "apache license", "MIT": "mit license", "GPL-3.0": "gnu general public license", "CC-BY-NC-4.0": "cc by nc 4 0"}
    plain = {(r["doc_id"], name) for r in documents(spark).collect() for name, line in lines.items() if line in " ".join(words_of(r["text"]))}
    assert plain and {(r["id"], r["license"]) for r in found} == plain


# ---------------------------------------------------------------- toxicity


def test_fit_shares_weights_over_ordered_thresholds():
    chance = np.random.default_rng(4)
    rows = np.repeat(np.arange(3000), 3)
    features = chance.integers(0, 20, rows.size)
    data = np.ones(rows.size)
    truth = np.linspace(-2, 2, 20)
    score = np.bincount(rows, truth[features])
    noise = chance.logistic(size=3000)
    grades = (score[:, None] + noise[:, None] > np.array([-1.0, 1.0, 3.0])).sum(axis=1)
    model = toxicity.Ordinal.fit(rows, features, data, grades, 20)
    assert (np.diff(model.thresholds) > 0).all()
    shift = (model.weights - truth).mean()
    assert model.weights - shift == pytest.approx(truth, abs=0.35)
    assert model.thresholds - 3 * shift == pytest.approx([-1.0, 1.0, 3.0], abs=0.4)
    expected = model.above(np.bincount(rows, model.weights[features])).sum(axis=1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.6


def test_gradient_points_downhill():
    chance = np.random.default_rng(0)
    rows, features = np.repeat(np.arange(200), 4), chance.integers(0, 10, 800)
    grades = chance.integers(0, 3, 200)

    def loss(model):
        above = np.column_stack([np.ones(200), model.above(np.bincount(rows, model.weights[features], minlength=200)), np.zeros(200)])
        return -np.log(above[np.arange(200), grades] - above[np.arange(200), grades + 1]).sum()

    few, many = (toxicity.Ordinal.fit(rows, features, np.ones(800), grades, 10, steps=n) for n in (2, 400))
    assert loss(many) < loss(few)
    for k in range(10):  # no single weight improves on the fit
        for step in (-0.05, 0.05):
            moved = many.weights.copy()
            moved[k] += step
            assert loss(toxicity.Ordinal(moved, many.thresholds)) > loss(many)


def test_toxic_documents_are_told_apart(spark):
    chance = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        words = [f"word{chance.randrange(300)}" for _ in range(chance.randrange(5, 80))]
        toxic = i % 5 == 0
        for _ in range(chance.randrange(1, 6) if toxic else 0):
            words.insert(chance.randrange(len(words)), chance.choice(["vile", "nasty", "grimlich", "grimbar"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (None, "vile nasty vile"), (902, "vile " * 300_000), (903, "grimzzz grimyyy grimxxx grimwww")]
    labels += [(None, 1), (5, None), (5, 1)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, toxic string")
    model = toxicity.learn(docs, spark.createDataFrame([x for x in labels if x[0] is None or x[0] % 3], "doc_id long, toxic int"))
    found = toxicity.severities(docs, model).collect()
    assert len(found) == len(rows)
    by_id = {r["id"]: r for r in found}
    tested = [r for r in found if r["id"] is not None and r["id"] < 900 and r["id"] % 3 == 0]
    assert all(r["toxic"] == (r["id"] % 5 == 0) for r in tested)
    assert by_id[900]["severity"] == by_id[901]["severity"] == 0.0
    assert by_id[None]["toxic"] and by_id[902]["toxic"] and by_id[903]["toxic"]
    assert all(0 <= r["severity"] <= 2 for r in found) and len({r["grade"] for r in tested}) == 3


def test_toxicity_without_a_model(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels) is None and toxicity.learn(docs, labels.limit(0)) is None
    assert [r["severity"] for r in toxicity.severities(docs, None).collect()] == [0.0, 0.0]
    assert toxicity.severities(docs.limit(0), None).count() == 0


def toxic_table(spark, number, chance):
    """Texts of very different lengths; the number of bad words of a toxic one grows with its length."""
    rows = []
    for i in range(number):
        words = [f"word{chance.randrange(300)}" for _ in range(int(2 ** chance.uniform(3, 9)))]
        for at in range(len(words)):
            if i % 3 == 0 and (at == 0 or chance.random() < 0.03):
                words[at] = chance.choice(["vile", "nasty", "grim", "foul"])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return rows, docs, spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int")


def test_severity_equals_plain_counts(spark):
    """Features, their choice and the scores, one text and one word at a time."""
    rows, docs, labels = toxic_table(spark, 240, random.Random(8))
    model = toxicity.learn(docs, labels, max_features=40)
    extract, held = toxicity.Features(), {}
    counted = {}
    for i, text, _ in rows:
        counted[i] = collections.Counter()
        for word in text.split():
            if word not in held:
                _, features, counts = extract([word])
                held[word] = dict(zip(features.tolist(), counts.tolist()))
            counted[i].update(held[word])
    flagged = sum(k for *_, k in rows)
    ratio = {}
    for feature in set().union(*counted.values()):
        of, hit = sum(feature in counted[i] for i, *_ in rows), sum(feature in counted[i] for i, _, k in rows if k)
        if hit * len(rows) <= of * flagged:
            continue
        cells = [(hit, of * flagged), (of - hit, of * (len(rows) - flagged))]
        cells += [(flagged - hit, (len(rows) - of) * flagged), (len(rows) - flagged - of + hit, (len(rows) - of) * (len(rows) - flagged))]
        ratio[feature] = 2 * sum(n * math.log(n / (e / len(rows))) for n, e in cells if n and e)
    best = sorted((f for f in ratio if ratio[f] >= toxicity.LEAST_RATIO), key=lambda f: (-round(ratio[f], 9), f))[:40]
    assert model[0].tolist() == sorted(best)
    weight = dict(zip(model[0].tolist(), model[1].weights.tolist()))
    for r in toxicity.severities(docs, model).collect():
        own = counted[r["id"]]
        score = sum(weight[f] * (1 + math.log(n)) for f, n in own.items() if f in weight)
        limits = model[1].thresholds[int(math.log2(sum(own.values())))]
        chances = [1 / (1 + math.exp(t - score)) for t in limits]
        assert r["severity"] == pytest.approx(sum(chances)) and r["toxic_score"] == pytest.approx(chances[0])


def test_grades_do_not_follow_length(spark):
    rows, docs, labels = toxic_table(spark, 900, random.Random(9))
    found = {r["id"]: r for r in toxicity.severities(docs, toxicity.learn(docs, labels)).collect()}
    assert np.mean([found[i]["toxic"] == bool(k) for i, _, k in rows]) > 0.99
    toxic = [(len(text), found[i]["severity"]) for i, text, k in rows if k]
    ranks = np.argsort(np.argsort(np.array(toxic), axis=0), axis=0)
    assert abs(np.corrcoef(ranks.T)[0, 1]) < 0.35
    assert {found[i]["grade"] for i, _, k in rows if k} >= {1, 2}


def test_strong_is_above_the_median_of_its_length():
    rows, features = np.array([0, 1, 2, 2, 3, 3, 4, 5, 6, 7]), np.array([0, 0, 0, 1, 0, 1, 0, 0, 2, 2])
    toxic, band = [1, 1, 1, 1, 1, 1, 0, 0], np.array([3, 3, 3, 3, 5, 5, 3, 5])
    grades = toxicity.severity_grades(rows, features, np.ones(10), band, toxic, 3)
    assert grades.tolist()[2:4] == [2, 2] and grades.tolist()[:2] == [1, 1] and grades.tolist()[6:] == [0, 0]
    assert toxicity.severity_grades(rows, features, np.ones(10), band, [0] * 8, 3).tolist() == [0] * 8


def test_several_texts_of_an_id_teach_once(spark):
    rows, docs, labels = toxic_table(spark, 200, random.Random(10))
    other = docs.unionByName(docs)
    once, twice = toxicity.learn(docs, labels), toxicity.learn(other, labels)
    assert once[0].tolist() == twice[0].tolist() and np.allclose(once[1].weights, twice[1].weights)
