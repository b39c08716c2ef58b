import numpy as np
from pyspark.sql import functions as F

from passarank.operators.embed import HashingEncoder, embed, embedder


class Lengths:
    """An encoder of the user's own; a new one per task."""

    def __call__(self, texts):
        assert len(texts) <= 2
        return [[float(len(t)), 1.0] for t in texts]


def test_own_encoder(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(7)], "i int, text string").repartition(2)
    assert {r["i"]: r["embedding"] for r in embed(df, "text", Lengths, batch=2).collect()} == {i: [float(i), 1.0] for i in range(7)}


def test_default_encoder(spark):
    texts = ["딥러닝 AI ai", "", "!!", None, "a b c"]
    vectors = HashingEncoder(16)(texts)
    assert np.allclose(np.linalg.norm(vectors, axis=1), [1, 0, 0, 0, 1])
    assert (HashingEncoder(16)(["AI, ai 딥러닝"]) == vectors[:1]).all()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    both = embed(df, "text").select("i", "embedding", embedder()(F.col("text")).alias("other")).collect()
    assert all(r["embedding"] == r["other"] for r in both)


def test_no_rows(spark):
    assert embed(spark.createDataFrame([], "text string")).count() == 0


def test_every_text_is_encoded_once(spark, tmp_path):
    """A counting encoder: it leaves a file per call that names the texts."""
    import json
    import uuid

    from passarank.operators.embed import HashingEncoder, embed, embed_once

    seen = tmp_path / "seen"
    seen.mkdir()
    folder = str(seen)

    class Counting(HashingEncoder):
        def __call__(self, texts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                json.dump(list(texts), file)
            return super().__call__(texts)

    def encoded():
        files = sorted(seen.iterdir())
        texts = [t for f in files for t in json.loads(f.read_text())]
        for f in files:
            f.unlink()
        return sorted(texts, key=repr)

    rows = [(i, f"text {i % 7}", "x") for i in range(500)] + [(900, None, "y"), (901, "", "y"), (902, None, "y")]
    df = spark.createDataFrame(rows, "n int, text string, _digest_ string").repartition(4)
    whole = {r["n"]: r["embedding"] for r in embed(df).collect()}
    found = embed_once(df, encoder=Counting)
    assert found.columns == [*df.columns, "embedding"]
    assert {r["n"]: r["embedding"] for r in found.collect()} == whole and found.count() == len(rows)
    assert encoded() == sorted(["", None, *[f"text {i}" for i in range(7)]], key=repr)
    store = str(tmp_path / "vectors")
    embed_once(df.filter("n < 3"), encoder=Counting, store=store)
    assert encoded() == ["text 0", "text 1", "text 2"]
    again = embed_once(df, encoder=Counting, store=store)
    assert {r["n"]: r["embedding"] for r in again.collect()} == whole
    assert len(encoded()) == 6
    assert {r["n"]: r["embedding"] for r in embed_once(df, encoder=Counting, store=store).collect()} == whole and encoded() == []
    assert embed_once(df.limit(0), encoder=Counting, store=store).count() == 0


def test_words_of_any_script_are_those_of_the_pattern():
    """Texts without Hangul are cut as bytes, the others by the pattern: the same words."""
    import hashlib
    import re

    import numpy as np

    from passarank.fixed_values import ALLOWED_CHARACTERS
    from passarank.operators.embed import HashingEncoder

    texts = [None, "", " ", "Ab İK é Straße A1-b2\u0085x\x00y", "ÀAé1ſK x", "ㆎa 힣B 힤c ㅤd", "가나 ABC 12", "😀ab\tC\x0bd"]
    expected = np.zeros((len(texts), 64))
    for row, text in enumerate(texts):
        for word in re.findall(f"[{ALLOWED_CHARACTERS}]+", text or ""):
            expected[row, int(hashlib.md5(word.lower().encode()).hexdigest()[:8], 16) % 64] += 1
    length = np.sqrt((expected**2).sum(axis=1, keepdims=True))
    assert np.array_equal(HashingEncoder()(texts), expected / np.where(length > 0, length, 1.0))
    assert HashingEncoder().words("Ab é c1") == [b"ab", b"c1"]


def test_new_texts_are_stored_once_on_their_way(spark, monkeypatch):
    """Of a call's texts only the new ones are stored; vectors are read where they lie unless most belong to other calls."""
    from passarank.operators import embed as E
    from passarank.plans.sizing import scratch_path

    names, durable = [], E.durable
    monkeypatch.setattr(E, "durable", lambda df, name: names.append(name) or durable(df, name))
    store, rows = scratch_path(spark, "vectors"), [(i, f"text {i % 40}") for i in range(100)]
    df = spark.createDataFrame(rows, "n int, text string")
    first = {r["n"]: r["embedding"] for r in E.embed_once(df, store=store).collect()}
    assert names == ["fresh"]
    few = {r["n"]: r["embedding"] for r in E.embed_once(df.filter("n < 3"), store=store).collect()}
    assert names == ["fresh", "fresh", "asked", "vectors"]
    assert len(first) == 100 and few == {n: first[n] for n in range(3)}


def test_long_texts_are_encoded_few_at_a_time(spark):
    """However long the texts, an encoder gets about 2 MB of them at once; every row keeps its vector."""
    import numpy as np

    from passarank.operators.embed import embed

    class Sizes:
        def __call__(self, texts):
            return np.array([[len(t or ""), len(texts), sum(len(t or "") for t in texts)] for t in texts], np.float32)

    rows = [(i, None if i == 3 else "a" * (3 << 20) if i == 40 else "b" * (300_000 + i)) for i in range(60)]
    df = spark.createDataFrame(rows, "n int, text string").coalesce(1)
    found = {r["n"]: r["embedding"] for r in embed(df, encoder=Sizes, batch=50).collect()}
    assert {n: v[0] for n, v in found.items()} == {n: len(t or "") for n, t in rows}
    assert found.pop(40)[1:] == [1, 3 << 20] and all(1 <= v[1] <= 50 and v[2] <= 2 << 20 for v in found.values())
    short = embed(spark.createDataFrame([(i, "c") for i in range(60)], "n int, text string").coalesce(1), encoder=Sizes, batch=50).collect()
    assert sorted({r["embedding"][1] for r in short}) == [10, 50]
    assert embed(df.limit(0), encoder=Sizes).count() == 0
