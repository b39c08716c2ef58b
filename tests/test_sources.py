"""Writers and readers on small tables."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from tests.conftest import plan

from passarank.operators import passages as P
from passarank.operators import recommend as R
from passarank.plans.sizing import durable, scratch_path
from passarank.schemas import COURSE, REVIEW
from passarank.sources import collections, nested, pages, snapshots, tables


def courses(spark):
    rows = [(i, f"과목{i}(x)", "N1", "01", "CS", 3, "전공", "Kim", None, None, "Intro one. Intro two!", None, "1: a\n2: b\n") for i in (1, 2, 3)]
    return spark.createDataFrame(rows, COURSE)


def reviews(spark):
    """One course has most of the reviews, one has none."""
    rows = [(i, 1, f"좋아요 {i}. 또 봐요!") for i in range(25)] + [(100, 3, "보통. ")]
    return spark.createDataFrame(rows, REVIEW)


def stats(spark):
    return spark.createDataFrame([(9, 1, 4.5)], "id long, course_id long, satisfaction double")


def test_nested_export(spark):
    documents = nested.as_json(nested.nest(courses(spark), reviews(spark), stats(spark)))
    read = {r["id"]: json.loads(r["json"]) for r in documents.collect()}
    assert [x["id"] for x in read[1]["reviews"]] == list(range(25))
    assert read[1]["review_stat"] == {"id": 9, "course_id": 1, "satisfaction": 4.5}
    assert read[2]["reviews"] == [] and "review_stat" not in read[2]
    assert read[2]["timeslot"] is None and read[2]["course_name"] == "과목2(x)" and "part" not in read[1]
    assert "과목" in documents.filter("id = 1").first()["json"]


def test_hot_parent_takes_several_lines_and_loses_nothing(spark):
    whole = nested.nest(courses(spark), reviews(spark), stats(spark), per_line=10)
    assert {(r["id"], r["part"]) for r in whole.collect()} == {(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)}
    path = scratch_path(spark, "export")
    nested.write_export(whole, path)
    back = nested.read_export(spark, path)
    assert {(r["id"], r["part"]) for r in back.collect()} == {(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)}
    feedback = P.feedback_table(back)
    assert {(r["feedback_id"], r["entity_id"], r["text"]) for r in feedback.collect()} == {
        (str(r["id"]), str(r["course_id"]), r["text"]) for r in reviews(spark).collect()}


def test_parts_have_no_gap_and_every_parent_is_indexed(spark):
    from passarank import workflows as W

    many = spark.range(120).select("id", (F.col("id") % 40).alias("course_id"), F.lit("text here").alias("text"))
    parents = spark.range(41).select("id", *[F.lit("x").cast(f.dataType).alias(f.name) if f.dataType.simpleString() == "string"
                                             else F.lit(1).cast(f.dataType).alias(f.name) for f in COURSE.fields[1:]])
    whole = nested.nest(parents, many, stats(spark), per_line=2)
    numbers = {}
    for r in whole.collect():
        numbers.setdefault(r["id"], []).append(r["part"])
    assert {i: sorted(p) for i, p in numbers.items()} == {i: [0, 1] if i < 40 else [0] for i in range(41)}
    path = scratch_path(spark, "export")
    nested.write_export(whole, path)
    frames = W.index_frames(nested.read_export(spark, path))
    assert frames[W.ENTITY].count() == 41 and frames[W.FEEDBACK].count() == 120


def test_documents_of_a_hot_source_take_lines_of_bounded_size(spark, tmp_path, monkeypatch):
    from suite import flows, text

    many = nested.LINE_CHILDREN * 2 + 500
    docs = spark.range(many + 600).select(
        F.col("id").alias("doc_id"), F.lit("Some text.").alias("text"),
        F.when(F.col("id") < many, "src1").when(F.col("id") < many + 300, "src2").alias("source"),
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(1, 4).select(
        F.col("id").alias("p_partkey"), F.lit(30).alias("p_size"), *[F.lit("x").alias(c) for c in ("p_name", "p_brand", "p_type")]
    ).write.parquet(str(tmp_path / "part.parquet"))
    folder, written = str(tmp_path), []
    monkeypatch.setattr(flows, "write_export", lambda lines, path: (written.append(lines), nested.write_export(lines, path)))
    index = flows.stored_index(spark, folder)
    for lines in (written[0], text.nested_parts(spark, folder)):
        sizes = {(r["id"], r["part"]): r["n"] for r in lines.select("id", "part", F.size("reviews").alias("n")).collect()}
        assert sizes == {(1, 0): 1000, (1, 1): 1000, (1, 2): 500, (2, 0): 300, (3, 0): 0}
    assert index["review"].count() == text.nonempty_feedback(spark, folder).count() == text.nested_texts(spark, folder).count() == many + 300
    assert index["course"].count() == 3


def test_bucket_count_is_read_back(spark):
    path = scratch_path(spark, "reviews")
    many = spark.range(200).select("id", (F.col("id") % 40).alias("course_id"), F.lit("old").alias("text"))
    tables.store_children(many, path, "course_id", buckets=7)
    everyone = many.select("course_id").distinct()
    tables.replace_stored_children(spark, path, REVIEW, everyone, many.filter("id < 150"), "course_id")
    assert tables.scan_children(spark, path, REVIEW, "course_id").count() == 150


def test_indented_export(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"id": 1, "course_name": "a", "reviews": []}, {"id": 2}], indent=4))
    assert sorted(r["id"] for r in nested.read_export(spark, str(tmp_path / "e.json"), indented=True).collect()) == [1, 2]


def test_passages(spark):
    made = P.explode_passages(courses(spark).filter("id = 1"), "id",
                              P.entity_passages(F.col("course_name"), F.col("course_intro"), F.col("syllabus")))
    assert [(r["passage_id"], r["text"]) for r in made.orderBy("pos").collect()] == [
        ("1#0", "과목1을 가르치는 수업"), ("1#1", "Intro one"), ("1#2", "Intro two"), ("1#3", "a"), ("1#4", "b")]
    kept = P.explode_passages(courses(spark).filter("id = 1"), "id",
                              P.entity_passages(F.col("course_name"), F.col("prerequisite"), F.col("syllabus")), keep_empty=True)
    assert [r["text"] for r in kept.orderBy("pos").collect()] == ["과목1을 가르치는 수업", "a", "b", ""]
    feedback = P.feedback_table(nested.nest(courses(spark), reviews(spark), stats(spark)))
    sentences = P.feedback_passages(feedback.filter("feedback_id = '3'")).orderBy("pos").collect()
    assert [(r["passage_id"], r["feedback_id"], r["entity_id"], r["text"]) for r in sentences] == [
        ("3#0", "3", "1", "좋아요 3"), ("3#1", "3", "1", "또 봐요")]
    assert "Exchange" not in plan(P.feedback_passages(durable(feedback)))


def test_replace_children(spark):
    new = spark.createDataFrame([(500, 3, "new")], REVIEW)
    parents = spark.createDataFrame([(1,), (3,)], "course_id long")
    replaced = tables.replace_children(reviews(spark), parents, new, "course_id")
    assert [tuple(r) for r in replaced.collect()] == [(500, 3, "new")]
    untouched = tables.replace_children(reviews(spark), parents.filter("course_id = 1"), new.limit(0), "course_id")
    assert [r["id"] for r in untouched.collect()] == [100]


def test_replace_in_place_touches_only_its_buckets(spark):
    path = scratch_path(spark, "reviews")
    many = spark.range(200).select("id", (F.col("id") % 40).alias("course_id"), F.lit("old").alias("text"))
    tables.store_children(many, path, "course_id", buckets=16)
    before = set(tables.scan_children(spark, path, REVIEW, "course_id").inputFiles())
    parents = spark.createDataFrame([(0,), (1,), (99,)], "course_id long")
    new = spark.createDataFrame([(900, 1, "new"), (901, 99, "new")], REVIEW)
    tables.replace_stored_children(spark, path, REVIEW, parents, new, "course_id")
    rows = {tuple(r) for r in tables.scan_children(spark, path, REVIEW, "course_id").collect()}
    assert rows == {(i, i % 40, "old") for i in range(200) if i % 40 > 1} | {(900, 1, "new"), (901, 99, "new")}
    assert 0 < len(before - set(tables.scan_children(spark, path, REVIEW, "course_id").inputFiles())) <= 3 < len(before)
    everyone = many.select("course_id").unionByName(parents).distinct()
    tables.replace_stored_children(spark, path, REVIEW, everyone, new.limit(0), "course_id")
    assert tables.scan_children(spark, path, REVIEW, "course_id").count() == 0


def test_page_files(spark, tmp_path):
    for name, html in (("a.html", "<p>1\n2</p>\n"), ("b.html", "")):
        (tmp_path / name).write_text(html)
    rows = {r["page_id"]: r["html"] for r in pages.read_page_files(spark, str(tmp_path)).collect()}
    assert rows == {"a.html": "<p>1\n2</p>\n"}


def test_collection_splits_hot_bucket_and_keeps_all(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("passage_id"), F.expr("if(id % 3 = 0, 'hot', cast(id % 50 as string))").alias("entity_id"))
    path = scratch_path(spark, "collection")
    collections.rebuild(df, path, buckets=4)
    back = collections.read_collection(spark, path, df.schema)
    assert back.exceptAll(df).count() == 0 and back.count() == 5000
    wanted = spark.createDataFrame([("hot",), ("7",), ("nowhere",)], "entity_id string")
    pruned = collections.within(collections.read_collection(spark, path, df.schema, with_bucket=True), wanted)
    assert pruned.columns == df.columns
    assert pruned.filter("entity_id in ('hot', '7')").count() == df.filter("entity_id in ('hot', '7')").count()
    assert "PartitionFilters: [bucket_of_4" in plan(pruned) or "PartitionFilters: [isnotnull(bucket_of_4" in plan(pruned)


def test_scan_prunes_and_pushes_down(spark):
    path = scratch_path(spark, "reviews")
    tables.store(reviews(spark), path)
    explained = plan(tables.scan(spark, path, REVIEW).filter("course_id = 3").select("id"))
    assert "PushedFilters: [IsNotNull(course_id), EqualTo(course_id,3)]" in explained
    assert "ReadSchema: struct<id:bigint,course_id:bigint>" in explained


def test_a_failed_replacement_leaves_the_old_version(spark):
    path = scratch_path(spark, "reviews")
    many = spark.range(200).select("id", (F.col("id") % 40).alias("course_id"), F.lit("old").alias("text"))
    tables.store_children(many, path, "course_id", buckets=8)
    parents = many.select("course_id").distinct()
    broken = many.withColumn("text", F.when(F.col("id") == 150, F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        tables.replace_stored_children(spark, path, REVIEW, parents, broken, "course_id")
    assert {r["text"] for r in tables.scan_children(spark, path, REVIEW, "course_id").collect()} == {"old"}
    assert tables.scan_children(spark, path, REVIEW, "course_id").count() == 200
    assert tables.replace_stored_children(spark, path, REVIEW, parents, many.withColumn("text", F.lit("new")), "course_id") == 2
    assert {r["text"] for r in tables.scan_children(spark, path, REVIEW, "course_id").collect()} == {"new"}
    assert {r["text"] for r in tables.scan_children(spark, path, REVIEW, "course_id", version=1).collect()} == {"old"}


def test_readers_keep_their_version_and_unfinished_manifests_do_not_count(spark):
    path, df = scratch_path(spark, "collection"), spark.range(50).select(F.col("id").cast("string").alias("entity_id"))
    collections.rebuild(df, path)
    opened = collections.read_collection(spark, path, df.schema)
    collections.rebuild(df.limit(10), path)
    assert opened.count() == 50 and collections.read_collection(spark, path, df.schema).count() == 10
    with open(f"{path}/{snapshots.MANIFESTS}/{3:08d}", "w") as torn:
        torn.write('{"": "version')
    assert snapshots.snapshot(spark, path).number == 2
    with pytest.raises(Exception, match="exist"):
        snapshots.publish(spark, path, 2, {})
    collections.rebuild(df.limit(7), path)
    assert snapshots.snapshot(spark, path).number == 4
    assert len(snapshots.remove_unused(spark, path, keep=1)) == 2
    assert collections.read_collection(spark, path, df.schema).count() == 7 and snapshots.snapshot(spark, path).number == 4
    children = scratch_path(spark, "reviews")
    tables.store_children(reviews(spark), children, "course_id", buckets=4)
    tables.replace_stored_children(spark, children, REVIEW, reviews(spark).filter("course_id = 1"), reviews(spark).limit(0), "course_id")
    left = tables.scan_children(spark, children, REVIEW, "course_id").collect()
    snapshots.remove_unused(spark, children, keep=1)
    assert tables.scan_children(spark, children, REVIEW, "course_id").collect() == left


def test_lookups_skip_row_groups(spark):
    df = spark.range(40_000).select(
        F.format_string("e%06d", F.expr("id div 10")).alias("entity_id"), F.md5(F.col("id").cast("string")).alias("feedback_id"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("text")
    )
    path = scratch_path(spark, "collection")
    collections.rebuild(df, path, buckets=1, group_bytes=1 << 16)
    stored = collections.read_collection(spark, path, df.schema)
    assert stored.count() == 40_000
    for key, value in (("entity_id", "e000123"), ("feedback_id", hashlib.md5(b"777").hexdigest())):
        ids = spark.createDataFrame([(value,), ("nowhere",)], f"{key} string")
        found = R.documents_by_id(stored, ids, key)
        rows = found.collect()
        assert {r[key] for r in rows} == {value} and len(rows) == df.filter(F.col(key) == value).count()
        assert read_rows(found) < 20_000


def test_lines_of_bounded_bytes_for_a_hot_parent(spark):
    sizes = {i: (37 * i) % 900 + 1 for i in range(3000)} | {50: 25_000, 51: 0}
    children = spark.createDataFrame([(i, 1 if i % 50 else 2, "x" * n) for i, n in sizes.items()], REVIEW).repartition(4)
    lines = nested.nest(courses(spark), children, stats(spark), line_bytes=5000)
    rows = lines.select("id", "part", F.col("reviews.id").alias("ids")).collect()
    for parent in (1, 2, 3):
        mine = sorted((r["part"], r["ids"]) for r in rows if r["id"] == parent)
        assert [part for part, _ in mine] == list(range(len(mine)))
        assert [i for _, ids in mine for i in ids] == [i for i in sizes if parent == (1 if i % 50 else 2)]
        assert all(sum(sizes[i] for i in ids[:-1]) < 5000 for _, ids in mine)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows share a task
    try:
        hot = lines.filter("id = 1").select(F.spark_partition_id().alias("task")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert hot > 1


def test_repeated_child_ids_stay_together(spark):
    children = spark.createDataFrame([(i % 5, 1, f"t{i}") for i in range(10)], REVIEW)
    for layout in ({"per_line": 2}, {"line_bytes": 4}):
        lines = nested.nest(courses(spark), children, stats(spark), **layout).filter("id = 1").orderBy("part").collect()
        assert [r["part"] for r in lines] == list(range(len(lines)))
        assert sorted(c["text"] for r in lines for c in r["reviews"]) == [f"t{i}" for i in range(10)]


def read_rows(df):
    """Rows that the scans of an executed frame gave out."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    plans = [leaves.apply(i) for i in range(leaves.size())]
    found = []
    for one in plans:
        if one.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            inner = one.executedPlan().collectLeaves()
            found += [inner.apply(i) for i in range(inner.size())]
        else:
            found.append(one)
    return sum(p.metrics().apply("numOutputRows").value() for p in found if p.metrics().contains("numOutputRows"))


def test_columns_added_behind_the_deal_are_not_moved(spark):
    """Rows are dealt out without the columns that ``add`` makes, and stored with them."""
    from passarank.operators.embed import embed
    from passarank.plans.sizing import scratch_path
    from passarank.sources import collections

    df, seen = spark.createDataFrame([(str(i), f"e{i % 5}", f"text {i}") for i in range(60)], "passage_id string, entity_id string, text string"), []
    path = scratch_path(spark, "collection")
    collections.rebuild(df, path, buckets=3, add=lambda dealt: seen.append(dealt.columns) or embed(dealt))
    assert len(seen) == 1 and "embedding" not in seen[0]
    whole = embed(df)
    assert sorted(map(str, collections.read_collection(spark, path, whole.schema).collect())) == sorted(map(str, whole.collect()))


def test_both_writes_of_a_rebuilt_collection_hold_vectors(spark, tmp_path, monkeypatch):
    """The rebuild that is replaced does the same work as the one that replaces it."""
    from suite import common, storage

    rows = [(i, f"One {i}. Two of {i}! ", "en", f"src{i % 3}", 15) for i in range(20)] + [(20, None, "en", None, 0), (20, "Again.", "en", "src1", 6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    paths = []
    monkeypatch.setattr(storage, "scratch_path", lambda spark, name: paths.append(scratch_path(spark, name)) or paths[-1])
    found = storage.collection_rebuild(spark, str(tmp_path))
    whole = common.embedded(common.sentence_passages(spark, str(tmp_path)).select(*found.columns))
    expected = sorted(map(str, whole.collect()))
    assert len(expected) == 41
    for version in (1, 2):
        assert sorted(map(str, collections.read_collection(spark, paths[0], whole.schema, version=version).collect())) == expected


def test_ids_added_behind_the_deal_have_bloom_filters(spark):
    path = scratch_path(spark, "collection")
    df = spark.range(40_000).select(F.md5(F.col("id").cast("string")).alias("entity_id"))  # a column of few values gets none
    collections.rebuild(df, path, buckets=1, add=lambda dealt: dealt.withColumn("other_id", F.md5("entity_id")))
    file = collections.read_collection(spark, path, df.schema).inputFiles()[0]
    make = spark._jvm.org.apache.hadoop.fs.Path(file)
    parquet = spark._jvm.org.apache.parquet.hadoop
    footer = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(make, spark._jsparkSession.sessionState().newHadoopConf()))
    columns = footer.getFooter().getBlocks().get(0).getColumns()
    filtered = {columns.get(i).getPath().toDotString() for i in range(columns.size()) if columns.get(i).getBloomFilterOffset() > 0}
    footer.close()
    assert filtered == {"entity_id", "other_id"}


def _many(spark):
    """Parents with many, few and no children; ids that repeat or are missing, a key that is missing, a parent that comes twice."""
    rows = [(i * 7 % 997, 1 if i % 9 else 2, f"text {i}") for i in range(997)] + [(5, 1, "again"), (None, 1, "no id"), (None, 4, "no id"), (3000, None, "no key")]
    parents = courses(spark).unionByName(courses(spark).filter("id = 2")).unionByName(courses(spark).filter("id = 1").withColumn("id", F.lit(4).cast("long")))
    return parents, spark.createDataFrame(rows, "id long, course_id long, text string").repartition(3)


@pytest.mark.parametrize("per_line", [1, 10, 64, 1000])
def test_lines_known_by_their_first_ids_are_those_of_the_places(spark, monkeypatch, per_line):
    parents, children = _many(spark)
    lines = sorted(map(str, nested.nest(parents, children, stats(spark), per_line=per_line).collect()))
    monkeypatch.setattr(nested, "BROADCAST_BYTES", -1)  # the places are joined to the children instead
    assert sorted(map(str, nested.nest(parents, children, stats(spark), per_line=per_line).collect())) == lines


def test_texts_of_an_export_move_once(spark):
    """Children move to their line, and neither to learn it nor to meet their parent."""
    _, children = _many(spark)
    lines = nested.nest(durable(courses(spark)), durable(children.filter("id is not null")), durable(stats(spark)), per_line=100)
    waiting, moved = [lines._jdf.queryExecution().executedPlan().executedPlan()], []
    while waiting:
        node = waiting.pop()
        waiting += [node.children().apply(i) for i in range(node.children().size())]
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            names = [node.output().apply(i).name() for i in range(node.output().size())]
            moved += [name for name in names if name in ("text", "buf", "reviews", "_children")]
    assert moved == ["buf"]


def test_shuffle_files_go_with_the_job_that_stores_rows(spark):
    import glob
    import time

    from passarank.plans import sizing

    def files():
        folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return sum(len(glob.glob(f"{d}/*/shuffle_*.data")) for d in list(folder))

    before, path = files(), scratch_path(spark, "collection")
    durable(spark.range(1000).repartition(7, "id"))
    collections.rebuild(spark.range(1000).select(F.col("id").cast("string").alias("entity_id")), path, buckets=3)
    until = time.time() + 20  # they go in the background
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(sizing.CLEANUP) == "false"


def test_sentences_stay_in_the_buckets_of_their_documents(spark):
    """What is made of a stored collection is not moved, and has the folders it would have had."""
    path, buckets = scratch_path(spark, "collection"), 5
    df = spark.range(300).select(F.col("id").cast("string").alias("feedback_id"), F.concat(F.lit("e"), F.col("id") % 20).alias("entity_id"), F.concat(F.lit("One. Two! "), "id").alias("text"))
    number = collections.rebuild(df, f"{path}/review", buckets=buckets)
    stored = collections.read_collection(spark, f"{path}/review", df.schema, version=number)
    sentences = P.feedback_passages(stored)
    collections.rebuild(sentences, f"{path}/dealt", buckets=buckets, dealt=True)
    collections.rebuild(P.feedback_passages(df), f"{path}/moved", buckets=buckets)
    rows = [sorted(map(str, collections.read_collection(spark, f"{path}/{name}", sentences.schema, with_bucket=True).collect())) for name in ("dealt", "moved")]
    assert rows[0] == rows[1] and len(rows[0]) == 900


@pytest.mark.parametrize("query", ["answer_outcomes", "answer_from_index"])
def test_answers_keep_the_index_and_no_copies_of_its_texts(spark, tmp_path, query):
    """What an answer leaves on disk: the four collections and small tables, but neither export nor parsed lines."""
    import glob
    import os

    from suite import flows

    rows = [(i, f"Graphs {i} are here. Maps of {i}!", "en", f"src{i % 3}", 30) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    parts = [(i, f"map ring {i}", "Brand#1", "SMALL", i, 1.0) for i in range(6)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0, "Graphs 1 are here.\nMaps of 2!"), (1, "Maps of 1!")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base = f"{spark.conf.get('spark.checkpoint.dir')}/passarank/{spark.sparkContext.applicationId}"
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    found = flows.register.queries[query](spark, str(tmp_path)).collect()
    assert {r["request_id"] for r in found} <= {0, 1, "0", "1"} and found
    left = {name.rsplit("-", 1)[0]: name for name in set(os.listdir(base)) - before}
    assert "index" in left and not {"export", "nested"} & set(left)
    assert sorted(os.listdir(f"{base}/{left['index']}")) == ["course", "course_sentence", "review", "review_sentence"]
    assert all("zstd" in name for name in glob.glob(f"{base}/{left['index']}/**/*.parquet", recursive=True))
