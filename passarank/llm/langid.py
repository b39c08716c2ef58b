"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams of one to three characters inside blank-padded
words, most frequent first. A document gets the language whose profile its own n-grams are least out
of place in: for each n-gram the difference of the two ranks, or the profile length if it is absent.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passarank.llm import kernels

PROFILE, MAX_LANGUAGES = 300, 1000
UNKNOWN = "und"
_BLANK = 0x20
_CHAR_BITS = 21  # a code point; three of them name an n-gram in one 63-bit number
_GROUP = 512  # texts that one counting pass numbers


class Grams:
    """N-grams of many texts, counted per text with numpy."""

    def __init__(self):
        self.table = kernels.classes(str.isalpha)

    def letters(self, parts):
        """Letters with one blank between words, and the number of the part each belongs to."""
        codes, ends = kernels.code_points([p.lower() for p in parts])
        alpha = kernels.is_class(codes, self.table, str.isalpha)
        after = np.concatenate([[False], alpha[:-1]])
        keep = np.flatnonzero(alpha | after)
        chars = np.where(alpha[keep], codes[keep], _BLANK).astype(np.int64)
        owner = np.searchsorted(ends, keep, side="right")
        return np.concatenate([[_BLANK], chars]), np.concatenate([[0], owner])

    def counts(self, parts, owners):
        """Distinct (owner, n-gram) with counts, sorted; n-grams as three packed code points.

        ``owners`` numbers the text of each part; a text may have several parts.
        """
        chars, part = self.letters(parts)
        if chars.size < 2:
            return (np.empty(0, np.int64),) * 3
        known = np.unique(chars)
        dense = np.searchsorted(known, chars) + 1
        owner = np.asarray(owners, np.int64)[part]
        bits = int(known.size + 1).bit_length()
        letter = chars != _BLANK
        one, two = dense << 2 * bits, dense[:-1] << 2 * bits | dense[1:] << bits
        three = two[:-1] | dense[2:]
        own = np.where(letter[:-1], owner[:-1], owner[1:])
        keys = np.concatenate([
            (owner << 3 * bits | one)[letter],
            own << 3 * bits | two,
            (owner[1:-1] << 3 * bits | three)[letter[1:-1]],
        ])
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.concatenate([first, [keys.size]]))
        keys = keys[first]
        wide, low = np.concatenate([[0], known]), (1 << bits) - 1
        grams = (
            wide[keys >> 2 * bits & low] << 2 * _CHAR_BITS | wide[keys >> bits & low] << _CHAR_BITS | wide[keys & low]
        )
        return keys >> 3 * bits, grams, counts


def _summed(owner, grams, counts):
    """Sum the counts of equal (owner, n-gram) and sort by both."""
    order = np.lexsort((grams, owner))
    owner, grams, counts = owner[order], grams[order], counts[order]
    if not owner.size:
        return owner, grams, counts
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])]))
    return owner[first], grams[first], np.add.reduceat(counts, first)


def _groups(texts):
    """Lists of (text number, part): few enough texts to be numbered in the keys."""
    for group in kernels.pieces(texts):
        for start in range(0, len(group), _GROUP):
            yield group[start : start + _GROUP]


def _counter(batches):
    """Arrow batches of (lang, text) to n-gram counts per language of each partition."""
    grams, names, held = Grams(), {}, [[], [], []]

    def merged():
        return _summed(*[np.concatenate(h) if h else np.empty(0, np.int64) for h in held])

    for batch in batches:
        langs = [names.setdefault(name, len(names)) for name in batch.column(0).to_pylist()]
        texts = batch.column(1).to_pylist()
        order = sorted(range(len(texts)), key=langs.__getitem__)
        for group in _groups([texts[i] for i in order]):
            found = grams.counts([p for _, p in group], [langs[order[n]] for n, _ in group])
            for part, new in zip(held, found):
                part.append(new)
            if sum(map(len, held[0])) > 1 << 20:
                held = [[part] for part in merged()]
    owner, keys, counts = merged()
    listed = pa.array(list(names), pa.string())
    for start in range(0, owner.size, 1 << 16):
        cut = slice(start, start + (1 << 16))
        yield pa.RecordBatch.from_arrays(
            [listed.take(pa.array(owner[cut])), pa.array(keys[cut]), pa.array(counts[cut])], ["lang", "gram", "n"]
        )


def learn(docs, lang_col="lang", text_col="text", profile=PROFILE, max_languages=MAX_LANGUAGES):
    """Profiles of the languages in ``docs``: {language: its n-grams, most frequent first}.

    Counts cover the whole text of every row with a language; null texts and languages teach nothing.
    Only the profiles, at most ``profile`` numbers per language, reach the driver; more than
    ``max_languages`` languages are an error. Equal counts are ordered by n-gram.
    """
    known = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).dropna()
    counts = known.mapInArrow(_counter, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("place", place).filter(F.col("place") <= profile)
    rows = best.limit(profile * (max_languages + 1)).collect()
    profiles = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    if len(profiles) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return profiles


def distances(owner, grams, counts, profiles, profile):
    """Out-of-place distance of each text to each language, as (texts, mean distance, per language).

    ``profiles`` is (sorted n-grams of all profiles, their ranks per language). Texts come in the
    order of ``owner``; the mean is over the text's own most frequent n-grams, from 0 to ``profile``.
    """
    known, ranks = profiles
    most = int(counts.max()) + 1
    order = np.argsort(owner * most + (most - 1 - counts), kind="stable")
    owner, grams = owner[order], grams[order]
    texts, first = np.unique(owner, return_index=True)
    place = np.arange(owner.size) - np.repeat(first, np.diff(np.concatenate([first, [owner.size]])))
    top = place < profile
    owner, grams, place = owner[top], grams[top], place[top]
    at = np.minimum(np.searchsorted(known, grams), known.size - 1)
    theirs = np.where((known[at] == grams)[:, None], ranks[at], -1)
    off = np.where(theirs >= 0, np.abs(theirs - place[:, None]), profile)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    sizes = np.diff(np.concatenate([first, [owner.size]]))
    return texts, np.add.reduceat(off, first, axis=0) / sizes[:, None]


def _predictor(profiles, profile):
    names = sorted(profiles)
    known = np.unique(np.array([g for name in names for g in profiles[name]], np.int64))
    ranks = np.full((known.size, len(names)), -1, np.int64)
    for column, name in enumerate(names):
        ranks[np.searchsorted(known, profiles[name]), column] = np.arange(len(profiles[name]))

    def predict(batches):
        grams = Grams()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            best = np.full(len(texts), len(names))
            score = np.zeros(len(texts))
            waiting = []  # counts of a text whose parts are not all read
            groups = list(_groups(texts)) if names else []
            for i, group in enumerate(groups):
                numbers = [n for n, _ in group]
                base = numbers[0]
                owner, keys, counts = grams.counts([p for _, p in group], [n - base for n in numbers])
                found = [owner + base, keys, counts]
                if waiting:
                    found = _summed(*[np.concatenate(pair) for pair in zip(waiting, found)])
                    waiting = []
                if i + 1 < len(groups) and groups[i + 1][0][0] == numbers[-1]:
                    open_text = found[0] == numbers[-1]
                    waiting = [part[open_text] for part in found]
                    found = [part[~open_text] for part in found]
                if found[0].size:
                    where, off = distances(*found, (known, ranks), profile)
                    best[where] = off.argmin(axis=1)
                    score[where] = 1.0 - off.min(axis=1) / profile
            listed = pa.array([*names, UNKNOWN], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], listed.take(pa.array(best)), pa.array(score)],
                [*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return predict


def predict(docs, profiles, text_col="text", keep=(), profile=PROFILE):
    """Language and score of every row: the columns ``keep``, ``lang_pred`` and ``score``.

    The score is 1 − mean distance ÷ profile length, from 0 (nothing in common) to 1. Ties go to the
    first language in code point order. A null text, one without a letter, or no profile at all gives
    ``und`` with score 0. Long texts are counted in pieces and judged whole. Rows may repeat.
    """
    if {"lang_pred", "score"} & set(keep):
        raise ValueError("lang_pred and score are names of results")
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType(chosen.schema.fields[:-1]).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    return chosen.mapInArrow(_predictor(profiles, profile), schema)


def held_out(id_col="doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(4)) == 2, F.lit(False))
