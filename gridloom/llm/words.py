"""Words of a text, as Spark expressions.

A word is a longest run of characters other than space and U+0009..U+000D.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Hashes that serve as order keys are kept non-negative and below 2**62, so that differences fit a long.
KEY_MASK = (1 << 62) - 1


def words(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.size(words(text)).cast("long")


def hash_key(*cols: Column) -> Column:
    """62-bit hash of the columns, null and empty told apart."""
    seen = [x for c in cols for x in (c, c.isNull())]
    return F.xxhash64(*seen).bitwiseAND(F.lit(KEY_MASK))


def null_safe(c: Column) -> Column:
    """A never-null string that tells null from every value, to group and join by."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
