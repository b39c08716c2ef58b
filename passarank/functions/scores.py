"""Numeric column expressions: label encoding, rounding, cosine distance."""

from pyspark.sql import functions as F

DISTANCE_DIGITS = 6


def encode_label(label, scale, strict=False):
    """Number of a label on an ordinal scale; an unknown label is NULL, or an error when strict."""
    mapping = F.create_map(*[F.lit(item) for pair in scale.items() for item in pair])
    number = F.try_element_at(mapping, label)
    if not strict:
        return number
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("NULL"))))
    return F.coalesce(number, unknown.cast("int"))


def round_half_even(value):
    """Round a double to one decimal as Python does: by its exact binary value, halves to even.

    The whole part is split off, which loses nothing. Ten times the rest is compared with the half in
    units of 2^-58, which is exact from 1/64 up; less rounds to nothing anyway.
    """
    size = F.abs(value)
    whole = F.floor(size)
    units = F.floor((size - whole) * float(1 << 58)).cast("long") * 10
    tenths = F.shiftright(units, 58)
    left = units - F.shiftleft(tenths, 58)
    half = F.lit(1 << 57)
    up = (left > half) | ((left == half) & (tenths % 2 == 1))
    tenths = tenths + F.when(up, 1).otherwise(0)
    # Whole tenths divide to the nearest double as long as their number has one of its own.
    rounded = F.when(size < float(1 << 49), (whole.cast("long") * 10 + tenths) / F.lit(10.0)).otherwise(whole + tenths / F.lit(10.0))
    return F.when(value < 0, -rounded).otherwise(rounded)


def dot(a, b):
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_distance(a, b, digits=DISTANCE_DIGITS):
    """1 - cosine similarity; a zero vector is at distance 1 from everything.

    The readable row-wise form, for pairs that a join has already made. Search over a whole
    collection uses the matrix kernel in ``operators.knn``.
    """
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    similarity = F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))
    return F.round(F.lit(1.0) - similarity, digits) + F.lit(0.0)
