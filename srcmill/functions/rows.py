"""Opening arrays into rows."""

from pyspark.sql import functions as F


def each(df, array, name, keep, position=None):
    """The `keep` columns with one row per element of the array.

    The outer form is used and its empty rows are removed: for the plain form Spark derives a filter on the size of
    the array and pushes it down, so that a costly array expression would be evaluated twice.
    """
    if position is None:
        return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(array).alias(position, name)).filter(F.col(position).isNotNull())
