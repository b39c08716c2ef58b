"""Texts to vectors in Arrow batches, by an encoder the user supplies."""

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passarank.fixed_values import ALLOWED_CHARACTERS
from passarank.plans.sizing import durable, small
from passarank.schemas import VECTOR
from passarank.sources.snapshots import fresh_folder, publish, snapshot

DIMENSIONS = 64
# Bytes of text that an encoder gets at once; one longer text goes alone.
TEXT_BYTES = 2 << 20


# A text without letters of this range holds ASCII words only.
_HANGUL = re.compile("[ㄱ-힣]")
# What the bytes of such a text become: letters in lower case, digits, and blanks between words.
_ASCII_WORDS = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))


class _Slots(dict):
    """The slot of every word, worked out when it is first asked for."""

    def __init__(self, dimensions):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, word):
        self[word] = int(hashlib.md5(word).hexdigest()[:8], 16) % self.dimensions
        return self[word]


class HashingEncoder:
    """Deterministic stand-in for a sentence model: hashed word counts at unit length.

    Any object that maps a list of texts to an (n, dimensions) array can take its place.
    """

    def __init__(self, dimensions=DIMENSIONS):
        self.dimensions = dimensions
        self.word = re.compile(f"[{ALLOWED_CHARACTERS}]+")
        self.slots = _Slots(dimensions)

    def words(self, text):
        """The words of a text in lower case, as bytes."""
        if text.isascii() or not _HANGUL.search(text):
            return text.encode().translate(_ASCII_WORDS).split()
        return [w.lower().encode() for w in self.word.findall(text)]

    def __call__(self, texts):
        words = [self.words(text or "") for text in texts]
        rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        if len(self.slots) > 500_000:
            self.slots.clear()
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=len(rows))
        counts = np.bincount(rows * self.dimensions + slots, minlength=len(texts) * self.dimensions)
        counts = counts.reshape(len(texts), self.dimensions).astype(np.float64)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return counts / np.where(length > 0, length, 1.0)


def _parts(texts, rows):
    """Ranges of at most ``rows`` texts that hold about ``TEXT_BYTES``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + TEXT_BYTES, side="right")), start + 1)
        yield start, min(stop, start + rows)
        start = min(stop, start + rows)


def embed(df, text="text", encoder=HashingEncoder, out="embedding", batch=1024):
    """Add the vector of a text column.

    ``encoder`` is a factory called once per task (a model loads there, not on the driver);
    it then gets lists of at most ``batch`` texts and some 2 MB, so that long texts do not all lie in words at once.
    """
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(out, VECTOR)])

    def encode(batches):
        model = encoder()
        for whole in batches:
            for start, stop in _parts(whole.column(names.index(text)), batch):
                part = whole.slice(start, stop - start)
                vectors = np.asarray(model(part.column(names.index(text)).to_pylist()), dtype=np.float32)
                flat = pa.array(vectors.reshape(-1))
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * vectors.shape[1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, flat)], [*names, out])

    return df.mapInArrow(encode, schema)


def embed_once(df, text="text", encoder=HashingEncoder, out="embedding", store=None, batch=1024):
    """``embed`` that encodes every different text once.

    Vectors are kept by the SHA-256 of their text. ``store`` names a folder for them: a later call with the
    same folder, as when a collection is rebuilt, encodes only texts it has not seen there. The folder belongs to one
    encoder; each call adds a version, or none if nothing is new. A null text has a vector of its own, like an
    empty one. Repeated texts, however many, are merged before they are moved; vectors come back by a
    join, broadcast while they are measured to be small.
    """
    spark = df.sparkSession
    digest = F.unhex(F.coalesce(F.sha2(F.col(f"`{text}`").cast("binary"), 256), F.lit("")))
    different = df.groupBy(digest.alias("_digest")).agg(F.first(text, ignorenulls=True).alias("_text"))
    known = _stored_vectors(spark, store)
    # Grouped by digest, so of the two sides of this join only the digests known are moved.
    fresh = different if known is None else different.join(known.select("_digest"), "_digest", "left_anti")
    if store is None:
        vectors = durable(embed(fresh, "_text", encoder, "_vector", batch).drop("_text"), "vectors")
    else:
        fresh = durable(fresh, "fresh")
        new = fresh.count()
        if new:
            number, folder = fresh_folder(spark, store)
            embed(fresh, "_text", encoder, "_vector", batch).drop("_text").write.parquet(f"{store}/{folder}")
            earlier = snapshot(spark, store).folders if known is not None else {}
            publish(spark, store, number, earlier | {str(number): folder})
        vectors = _stored_vectors(spark, store)
        if known is not None and known.count() > new:
            # Mostly vectors of other calls: those that are not asked for stay where they are.
            asked = durable(df.select(digest.alias("_digest")).distinct(), "asked")
            vectors = durable(vectors.join(small(asked), "_digest", "left_semi"), "vectors")
    keyed = df.select("*", digest.alias("_digest"))
    names = [F.col(f"`{c}`") for c in df.columns if c != out]
    return keyed.join(small(vectors), "_digest").select(*names, F.col("_vector").alias(out))


def _stored_vectors(spark, store):
    """The vectors of a folder by digest, None if it has none yet."""
    if store is None:
        return None
    try:
        folders = snapshot(spark, store).folders.values()
    except FileNotFoundError:
        return None
    schema = T.StructType([T.StructField("_digest", T.BinaryType()), T.StructField("_vector", VECTOR)])
    return spark.read.schema(schema).option("basePath", store).parquet(*[f"{store}/{f}" for f in folders]).select("_digest", "_vector")


def embedder(encoder=HashingEncoder):
    """The same encoder as a column function, for use inside a select."""

    @F.pandas_udf(VECTOR)
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for texts in batches:
            yield pd.Series(list(np.asarray(model(texts.tolist()), dtype=np.float32)))

    return vectors
