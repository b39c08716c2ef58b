"""Severity of toxic documents by cumulative-link ordinal regression on sparse text features.

P(grade > j) = logistic(w · x − t_j): one weight per feature for all thresholds t_1 < t_2 < …. Features
are hashed words and word beginnings with damped counts; those take part that are more frequent in toxic
than in other labelled documents beyond chance. Thresholds above the first one depend on the length of
the text, so that a long text needs more for a high grade, but no more to be toxic at all. The score of a
document is its expected severity, the sum of P(grade > j) over the thresholds.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from passarank.llm import kernels
from passarank.plans.sizing import durable

FEATURE_BITS, BEGINNINGS = 22, (4, 5, 6)
# Features that take part at most, and the likelihood ratio (twice its logarithm) that they need.
MAX_FEATURES, LEAST_RATIO = 4096, 20.0
# Labelled rows that a fit uses at most: those with the smallest digests of their ids.
FIT_ROWS = 20_000
# Length bands, each with its own distance between the thresholds.
BANDS = 40
_SEED = np.uint64(0x2545F4914F6CDD1D)


class Features:
    """Hashed words and word beginnings of many texts as sparse rows."""

    def __init__(self, bits=FEATURE_BITS, beginnings=BEGINNINGS):
        self.words, self.bits, self.beginnings = kernels.Words(), bits, beginnings

    def __call__(self, texts):
        """(text number, feature, count) sorted by text and feature, each pair once."""
        owners, features = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        shift = np.uint64(64 - self.bits)
        for group in kernels.pieces(texts):
            codes, ends = kernels.code_points([part.lower() for _, part in group])
            starts, stops = self.words.spans(codes)
            owner = np.array([n for n, _ in group])[np.searchsorted(ends, starts, side="right")]
            lengths = stops - starts
            owners.append(owner)
            features.append((self.words.hash_spans(codes, starts, lengths) >> shift).astype(np.int64))
            for size in self.beginnings:
                long = lengths > size
                found = self.words.hash_spans(codes, starts[long], np.full(int(long.sum()), size))
                owners.append(owner[long])
                features.append((kernels.mix64(found ^ _SEED) >> shift).astype(np.int64))
        key = np.concatenate(owners) << self.bits | np.concatenate(features)
        key.sort()
        if not key.size:
            return key, key, key
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.concatenate([first, [key.size]]))
        return key[first] >> self.bits, key[first] & ((1 << self.bits) - 1), counts


def values(counts):
    """Damped counts: a word that comes back weighs less each time."""
    return 1.0 + np.log(counts)


def bands(rows, counts, number):
    """The length band of each of ``number`` texts: the binary logarithm of its count of features."""
    total = np.bincount(rows, counts, minlength=number)
    return np.minimum(np.log2(np.maximum(total, 1.0)).astype(np.int64), BANDS - 1)


def logistic(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Ordinal:
    """Shared weights and ordered thresholds, the same for all rows or a line of them per group of rows."""

    def __init__(self, weights, thresholds):
        self.weights, self.thresholds = weights, thresholds

    def above(self, scores, group=None):
        """P(grade > j) per row and threshold."""
        limits = self.thresholds[None, :] if group is None else self.thresholds[group]
        return logistic(scores[:, None] - limits)

    @classmethod
    def fit(cls, rows, features, data, grades, width, group=None, groups=1, steps=600, rate=0.1, decay=3e-6):
        """Maximum likelihood with a small quadratic penalty, by Adam over all rows.

        ``rows``, ``features`` and ``data`` are the sparse matrix, ``grades`` whole numbers from 0. The first
        threshold is one number for all rows; each group of rows has its own logarithms of the gaps up to the
        later ones, so they stay in order. Groups without a row above grade 0 keep the gaps of all.
        """
        grades = np.asarray(grades)
        top, count = int(grades.max()), len(grades)
        of = np.zeros(count, np.int64) if group is None else group
        share = np.clip([(grades > j).mean() for j in range(top)], 1e-6, 1 - 1e-6)
        start = -np.log(share / (1 - share))
        gaps = np.log(np.maximum(np.diff(start), 1e-2))
        point = np.concatenate([np.zeros(width), start[:1], np.tile(gaps, groups)])
        first, second = np.zeros(point.size), np.zeros(point.size)
        every = np.arange(count)

        def limits_of(point):
            steps_up = np.exp(point[width + 1 :]).reshape(groups, top - 1)
            return point[width] + np.cumsum(np.hstack([np.zeros((groups, 1)), steps_up]), axis=1)

        for step in range(1, steps + 1):
            ends = np.full((groups, 1), np.inf)
            score = np.bincount(rows, point[features] * data, minlength=count)
            # P(grade = g) is the difference of two cumulative curves that meet at g's thresholds.
            wall = np.hstack([-ends, limits_of(point), ends])[of]
            low, high = logistic(score - wall[every, grades]), logistic(score - wall[every, grades + 1])
            chance = np.maximum(low - high, 1e-12)
            slope_low, slope_high = low * (1 - low) / chance, high * (1 - high) / chance
            by_score = (slope_high - slope_low) / count
            slope = np.zeros(point.size)
            slope[:width] = np.bincount(features, by_score[rows] * data, minlength=width) + decay * point[:width]
            by_limit = np.zeros((groups, top + 2))
            np.add.at(by_limit, (of, grades), slope_low / count)
            np.add.at(by_limit, (of, grades + 1), -slope_high / count)
            later = np.cumsum(by_limit[:, -2:0:-1], axis=1)[:, ::-1]
            slope[width] = later[:, 0].sum()
            slope[width + 1 :] = later[:, 1:].ravel() * np.exp(point[width + 1 :])
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope**2
            point -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        limits = limits_of(point)
        return cls(point[:width], limits[0] if group is None else limits)


def severity_grades(rows, features, data, band, toxic, width):
    """Grades from yes-or-no labels: 0 clean, 1 toxic, 2 toxic and strong for its length.

    Rows fall into two folds by turns. A row's strength is the sum of the log odds of its features as the other
    fold has them, so no row vouches for itself. Strong is above the median of the toxic rows of the same
    length band, so that longer texts are not stronger for being long.
    """
    toxic = np.asarray(toxic, np.int64)
    fold, strength = np.arange(toxic.size) % 2, np.zeros(toxic.size)
    for own in (0, 1):
        teach = fold[rows] != own
        seen = [np.bincount(features[teach & (toxic[rows] == kind)], minlength=width) for kind in (0, 1)]
        number = [np.sum((fold != own) & (toxic == kind)) for kind in (0, 1)]
        odds = np.log((seen[1] + 0.5) / (number[1] + 1.0)) - np.log((seen[0] + 0.5) / (number[0] + 1.0))
        odds[seen[0] + seen[1] == 0] = 0.0
        scored = np.bincount(rows, data * odds[features], minlength=toxic.size)
        strength = np.where(fold == own, scored, strength)
    grades = toxic.copy()
    for one in np.unique(band[toxic == 1]):
        of_band = (toxic == 1) & (band == one)
        grades[of_band & (strength > np.median(strength[of_band]))] = 2
    return grades


def _frequencies(bits):
    """Arrow batches of (id, label, text) to (feature, flagged, rows): in how many rows each occurs."""

    def count(batches):
        extract, flagged, total = Features(bits), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        for batch in batches:
            label, texts = batch.column(1).to_numpy() > 0, batch.column(2).to_pylist()
            for start, stop in kernels.slices(texts):
                rows, features, _ = extract(texts[start:stop])
                np.add.at(total, features, 1)
                np.add.at(flagged, features[label[start:stop][rows]], 1)
        found = np.flatnonzero(total)
        for start in range(0, found.size, 1 << 16):
            part = found[start : start + (1 << 16)]
            columns = [part, flagged[part].astype(np.int64), total[part].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["feature", "flagged", "rows"])

    return count


def _held(features_held, rows, features, counts):
    """What is left of sparse rows in the chosen features, with the place of each."""
    at = np.minimum(np.searchsorted(features_held, features), features_held.size - 1)
    kept = features_held[at] == features
    return rows[kept], at[kept], counts[kept]


def _chosen_rows(features_held, bits):
    """Arrow batches of (id, label, text) to sparse rows over the chosen features."""

    def sparse(batches):
        extract = Features(bits)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for start, stop in kernels.slices(texts):
                number = stop - start
                rows, features, counts = extract(texts[start:stop])
                band = bands(rows, counts, number)
                rows, at, counts = _held(features_held, rows, features, counts)
                ends = np.searchsorted(rows, np.arange(number + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (at, counts)]
                part = batch.slice(start, number)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *lists, pa.array(band.astype(np.int32))],
                    ["id", "label", "features", "counts", "band"],
                )

    return sparse


def _likelihood_ratio(flagged, rows, all_flagged, all_rows):
    """Twice the logarithm of the likelihood ratio of a two-by-two table, as a column."""
    cells = []
    for seen, of in ((flagged, all_flagged), (rows - flagged, all_rows - all_flagged)):
        for observed, share in ((seen, rows / F.lit(all_rows)), (F.lit(of) - seen, F.lit(1.0) - rows / F.lit(all_rows))):
            expected = share * F.lit(float(of))
            cells.append(F.when((observed > 0) & (expected > 0), observed * F.log(observed / expected)).otherwise(0.0))
    return sum(cells[1:], cells[0]) * 2.0


def learn(
    docs, labels, id_col="doc_id", text_col="text", label_col="toxic", graded=False,
    fit_rows=FIT_ROWS, bits=FEATURE_BITS, max_features=MAX_FEATURES, least_ratio=LEAST_RATIO,
):
    """Fit on labelled documents; None if no feature or no two grades are told apart.

    Uses at most ``fit_rows`` labelled ids, those with the smallest digests. Feature counts are taken
    where the texts are; the driver gets the chosen features and the rows reduced to them. With
    ``graded`` the label is a grade from 0 up; otherwise it is 0 or 1 and ``severity_grades`` derives the grades.
    Null ids, labels and texts teach nothing; of several labels of an id the largest grade counts, of
    several texts of an id the one with the smallest digest.
    """
    grade = F.greatest(F.col(f"`{label_col}`").cast("int"), F.lit(0))
    known = labels.filter(F.col(f"`{label_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), grade.alias("label"))
    chosen = known.dropna().groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    chosen = durable(chosen, "labels")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).dropna()
    one_text = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    labelled = durable(texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(one_text), "labelled")
    sizes = labelled.agg(F.count("*").alias("rows"), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0)).alias("flagged")).first()
    counts = labelled.mapInArrow(_frequencies(bits), "feature bigint, flagged bigint, rows bigint")
    counts = counts.groupBy("feature").agg(F.sum("flagged").alias("flagged"), F.sum("rows").alias("rows"))
    ratio = _likelihood_ratio(F.col("flagged"), F.col("rows"), sizes["flagged"], max(sizes["rows"], 1))
    more = F.col("flagged") * sizes["rows"] > F.col("rows") * sizes["flagged"]
    best = counts.withColumn("ratio", ratio).filter(more & (F.col("ratio") >= least_ratio)).orderBy(F.desc("ratio"), "feature").limit(max_features)
    best = sorted(best.collect(), key=lambda r: r["feature"])
    if not best:
        return None
    features = np.array([r["feature"] for r in best], np.int64)

    id_type = labelled.schema["id"].dataType.simpleString()
    found = labelled.mapInArrow(
        _chosen_rows(features, bits), f"id {id_type}, label int, features array<int>, counts array<int>, band int"
    )
    read = found.orderBy(F.xxhash64("id"), "id").toArrow()
    label, band = (read.column(c).to_numpy().astype(np.int64) for c in ("label", "band"))
    lists = read.column("features").combine_chunks()
    rows = np.repeat(np.arange(read.num_rows), np.diff(lists.offsets.to_numpy()))
    at = lists.flatten().to_numpy().astype(np.int64)
    data = values(read.column("counts").combine_chunks().flatten().to_numpy().astype(np.float64))
    grades = label if graded else severity_grades(rows, at, data, band, label > 0, features.size)
    if len(np.unique(grades)) < 2:
        return None
    return features, Ordinal.fit(rows, at, data, grades, features.size, band, BANDS)


def _scorer(model, bits):
    features_held, fitted = model

    def score(batches):
        extract = Features(bits)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in kernels.slices(texts):
                rows, features, counts = extract(texts[start:stop])
                bare = ~np.isin(np.arange(stop - start), rows)  # texts without a word are clean
                band = bands(rows, counts, stop - start)
                rows, at, counts = _held(features_held, rows, features, counts)
                total = np.bincount(rows, fitted.weights[at] * values(counts), minlength=stop - start)
                above = fitted.above(total, band)
                severity = above.sum(axis=1)
                severity[bare], above[bare] = 0.0, 0.0
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(severity), pa.array((above >= 0.5).sum(axis=1).astype(np.int32)), pa.array(above[:, 0])],
                    ["id", "severity", "grade", "toxic_score"],
                )

    return score


def severities(docs, model, id_col="doc_id", text_col="text", bits=FEATURE_BITS):
    """One row per document: ``id``, ``severity`` (expected grade), ``grade`` (thresholds passed with even
    chance or better), ``toxic_score`` (chance of a grade above 0) and ``toxic`` (that chance is 0.5 or more).

    Whole texts are read. Null texts, texts without a word, and all texts without a model are clean: 0.
    """
    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    if model is None:
        zero = F.lit(0.0)
        scored = chosen.select("id", zero.alias("severity"), F.lit(0).alias("grade"), zero.alias("toxic_score"))
    else:
        id_type = chosen.schema["id"].dataType.simpleString()
        scored = chosen.mapInArrow(_scorer(model, bits), f"id {id_type}, severity double, grade int, toxic_score double")
    return scored.withColumn("toxic", F.col("toxic_score") >= 0.5)
