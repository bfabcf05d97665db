"""Small helpers shared by the operators: work tables, word patterns, ASCII lower case."""

import functools
import string

import pyarrow as pa
from pyspark.sql import functions as F

from ..session import work_path

# The words of the operators' contracts.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN = r"[^\x20\x09-\x0D]+"

#: Bytes to lower case (A-Z only), with everything that is no part of a WORD made a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def stored(df, label):
    """The rows, written to a fresh table below the shared folder and read back."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(column):
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def text_bytes(column="text"):
    """A text as UTF-8 bytes, empty for null; tasks then need not decode it."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def free_name(df, name):
    """The name, lengthened until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back():
    """Freed memory goes back to the system: a Python worker outlives its tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # another C library


def trimmed(function):
    """A function for mapInArrow, mapInPandas or a UDF over batches that gives freed memory back at its end."""

    @functools.wraps(function)
    def run(batches):
        import gc

        yield from function(batches)
        gc.collect()
        give_back()

    return run


def trimmed_group(function):
    """The same for a function of one table, or of two of a cogroup, for applyInArrow; at the end of each group."""

    def one(table):
        out = function(table)
        give_back()
        return out

    def two(left, right):
        out = function(left, right)
        give_back()
        return out

    return one if function.__code__.co_argcount == 1 else two  # Spark counts the parameters
