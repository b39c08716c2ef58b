"""Registered queries of the numbered operators; SQL twins where SQL can express them."""

from pyspark.sql import functions as F

from passarank.llm import decontaminate, langid, licenses, mixing, neardup, neighbours, repeats, runs, sharding, shallot, toxicity, urlfilter, warc
from passarank.llm.common import table

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


@query()
def op9_minhash_near_duplicates(spark, folder):
    """Every document with its class of near duplicates."""
    classes = neardup.near_duplicates(table(spark, folder, "documents"))
    return classes.select(F.col("id").alias("doc_id"), "class_id")


@query()
def op10_benchmark_leaks(spark, folder):
    """Every benchmark item that occurs in a document, with the least number of edits and the stretch."""
    leaks = decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"), short_items=True)
    return leaks.select(F.col("id").alias("doc_id"), "item_id", "distance", "start", "stop")


@query()
def op4_language_profiles(spark, folder):
    """The language of every document, learned from the documents that are not held out."""
    docs = table(spark, folder, "documents")
    profiles = langid.learn(docs.filter(~langid.held_out()))
    return langid.predict(docs.withColumn("held_out", langid.held_out()), profiles, keep=["doc_id", "held_out"])


@query()
def op3_shuffled_shards(spark, folder):
    """Every document's shard and slot, from the written shards."""
    shards = sharding.shuffled_shards(table(spark, folder, "documents").select("doc_id", "text"), 40)
    return shards.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


MIX_SQL = r"""
WITH sizes AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
        CAST('0x' || substr(md5(concat_ws('|', '20', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 15) AS BIGINT) AS place
    FROM documents
), by_source AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth
    FROM sizes GROUP BY source
), limits AS (
    SELECT *, list_value(3, 1, 2)[nth % 3 + 1] AS weight, source_size * 2 AS cap FROM by_source
), levels AS (
    SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE
            - CAST(coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
        / CAST(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
    FROM limits
), free AS (
    SELECT arg_min(level, (cap::DOUBLE / weight, nth)) AS level FROM levels WHERE cap::DOUBLE / weight > level
), targets AS (
    SELECT source, source_size,
        CASE WHEN cap::DOUBLE / weight <= levels.level OR free.level IS NULL THEN cap::DOUBLE ELSE free.level * weight END AS target
    FROM levels CROSS JOIN free
), turns AS (
    SELECT b.nth, CAST(ceil(CAST(round(target) AS BIGINT) / 2048.0::DOUBLE) AS BIGINT) AS turns FROM targets t JOIN by_source b ON b.source IS NOT DISTINCT FROM t.source
), borders AS (
    SELECT nth, turns, total, (upto - turns) / total::DOUBLE AS low, upto / total::DOUBLE AS high FROM (
        SELECT *, CAST(sum(turns) OVER () AS BIGINT) AS total, CAST(sum(turns) OVER (ORDER BY nth) AS BIGINT) AS upto FROM turns
    ) WHERE turns > 0
), points AS (
    SELECT slot, (((slot // 65536) * LEAP::DOUBLE) % 1.0::DOUBLE + (slot % 65536) * GOLDEN::DOUBLE) % 1.0::DOUBLE AS point
    FROM (SELECT unnest(range(3 * max(total))) AS slot FROM borders)
), slots AS (
    SELECT nth, slot, row_number() OVER (PARTITION BY nth ORDER BY slot) - 1 AS turn FROM points JOIN borders ON point >= low AND point < high
), taken AS (
    SELECT nth, turn, slot FROM slots JOIN borders USING (nth) WHERE turn < turns
), laid AS (
    SELECT doc_id, size, t.source_size, target, b.nth, round(target)::BIGINT AS goal,
        2 * CAST(sum(size) OVER (PARTITION BY sizes.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS middle
    FROM sizes JOIN targets t ON sizes.source IS NOT DISTINCT FROM t.source JOIN by_source b ON b.source IS NOT DISTINCT FROM t.source
), asked AS (
    SELECT *, CASE WHEN size > 0 AND middle < goal * 2 THEN middle // 4096 END AS turn_first,
        CASE WHEN size > 0 AND middle + 2 * source_size < goal * 2 THEN (middle + 2 * source_size) // 4096 END AS turn_second
    FROM laid
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, f.slot AS first_position, s.slot AS second_position,
    CAST(size * (CAST(f.slot IS NOT NULL AS INT) + CAST(s.slot IS NOT NULL AS INT)) AS BIGINT) AS taken
FROM asked a LEFT JOIN taken f ON f.nth = a.nth AND f.turn = turn_first LEFT JOIN taken s ON s.nth = a.nth AND s.turn = turn_second
""".replace("LEAP", repr((5**0.5 - 1) / 2 * 65536 % 1.0)).replace("GOLDEN", repr((5**0.5 - 1) / 2))


@query(MIX_SQL)
def op5_mixed_sources(spark, folder):
    """How many words of every document the mix takes, and at which positions."""
    plan = mixing.schedule(table(spark, folder, "documents"))
    times = F.size(F.array_compact(F.array("first", "second")))
    return plan.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"),
        F.col("first").alias("first_position"), F.col("second").alias("second_position"),
    )


@query()
def op7_cross_polytope_neighbours(spark, folder):
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query()
def op1_warc_round_trip(spark, folder):
    """Every page from its record in the archives that were written from the pages."""
    place, index = warc.write_archive(table(spark, folder, "pages"))
    return warc.read_records(index, place).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op2_toxicity_severity(spark, folder):
    """The expected severity of every document, learned from the labelled ones."""
    docs = table(spark, folder, "documents")
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    return toxicity.severities(docs, model).withColumnRenamed("id", "doc_id")


@query()
def op6_url_verdicts(spark, folder):
    """The verdict on every page's address."""
    found = urlfilter.verdicts(table(spark, folder, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "tokens", "score")


@query()
def op8_license_spans(spark, folder):
    """Every license notice in the documents, with its coverage and stretch."""
    return licenses.scan(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query()
def op11_periodic_runs(spark, folder):
    """Every document's runs of repeated word sequences, some documents made periodic before."""
    return runs.periodic_runs(table(spark, folder, "documents"), rewrite=10, whole=False).withColumnRenamed("id", "doc_id")


def _clusters_sql(count=8, rounds=10, seed=3, dimensions=64, scale=1024):
    """Plain rounds of assignment and update, one after another."""
    parts = [
        f"""
kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS parts
    FROM embeddings
    WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dimensions}
), components AS MATERIALIZED (
    SELECT row_no, unnest(parts) AS value, unnest(range({dimensions})) AS place FROM kept
), chosen AS (
    SELECT row_no, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, parts) - 1 AS cluster FROM kept
), centroids_0 AS MATERIALIZED (
    SELECT cluster, place, value FROM chosen JOIN components USING (row_no) WHERE cluster < {count}
)"""
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""
near_{r} AS MATERIALIZED (
    SELECT row_no, cluster, distance FROM (
        SELECT row_no, cluster, CAST(sum((v.value - c.value) * (v.value - c.value)) AS BIGINT) AS distance
        FROM components v JOIN centroids_{r} c ON v.place = c.place GROUP BY row_no, cluster
    ) QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY distance, cluster) = 1
)"""
        )
        if r < rounds:
            parts.append(
                f"""
centroids_{r + 1} AS MATERIALIZED (
    SELECT c.cluster, c.place, CASE WHEN n IS NULL THEN c.value ELSE (total - ((total % n) + n) % n) // n END AS value
    FROM centroids_{r} c LEFT JOIN (
        SELECT cluster, place, CAST(sum(value) AS BIGINT) AS total, count(*) AS n FROM near_{r} JOIN components USING (row_no) GROUP BY cluster, place
    ) m ON m.cluster = c.cluster AND m.place = c.place
)"""
            )
    return (
        "WITH " + ",".join(parts) + f"""
SELECT vec_id, CAST(f.cluster AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near_{rounds} f JOIN kept USING (row_no) JOIN (
    SELECT cluster, sha256(string_agg(CAST(value AS BIGINT), ',' ORDER BY place)) AS centroid_sha256 FROM centroids_{rounds} GROUP BY cluster
) d ON d.cluster = f.cluster
"""
    )


@query(_clusters_sql())
def op12_shallot_clusters(spark, folder):
    """Every usable vector's cluster after ten rounds, with exact distances and sums."""
    return shallot.clusters(table(spark, folder, "embeddings"))[0].withColumnRenamed("id", "vec_id")


REPEATS_SQL = r"""
WITH split AS (
    SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS doc, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words
    FROM documents
), windows AS (
    SELECT doc, start, hash(list_slice(words, start, start + 19)) AS name, list_slice(words, start, start + 19) AS held
    FROM (SELECT doc, words, unnest(range(1, len(words) - 18)) AS start FROM split)
), later AS (
    SELECT doc, start FROM (
        SELECT doc, start, row_number() OVER (PARTITION BY name, held ORDER BY doc, start) AS nth FROM windows
    ) WHERE nth > 1
), covered AS (
    SELECT DISTINCT doc, start + unnest(range(20)) AS place FROM later
), kept AS (
    SELECT doc, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n_kept
    FROM (SELECT doc, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split) ANTI JOIN covered USING (doc, place)
    GROUP BY doc
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc)
"""


@query(REPEATS_SQL)
def op13_first_occurrences(spark, folder):
    """Every document without the words of 20-word windows that occur earlier."""
    return repeats.without_repeats(table(spark, folder, "documents"), whole=False).withColumnRenamed("id", "doc_id")
