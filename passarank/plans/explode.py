"""Arrays to rows without working the array out twice."""

from pyspark.sql import functions as F


def exploded(df, columns, array, position, item):
    """``columns`` of every row once per item of ``array``, with the item and its position from 0.

    The plain generator lets the optimizer put a test for empty arrays in front of it, into which it copies the
    whole expression of the array. Here rows without items are left out behind the generator instead.
    """
    every = df.select(*columns, F.posexplode_outer(array).alias(position, item))
    return every.filter(F.col(position).isNotNull())


def once(df, name, value):
    """Add a column whose expression is worked out once for each row.

    A filter or a select further up may otherwise copy the expression to every place that names the column;
    nothing is copied through a generator.
    """
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode_outer(F.array(value)).alias(name))
