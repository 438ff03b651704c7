"""Join shapes that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def left_join_many(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join against a side with an unbounded number of rows per key.

    In a left outer join only the left side of a skewed partition can be split,
    so a key with very many right rows would end up in a single task.  The inner
    join of the matching rows can be split on both sides; the unmatched rows
    come from an anti join against the distinct keys, which are combined before
    they move.  Rows without a key need no join; with them set apart, both
    branches read the same shuffle of ``left``.
    """
    keyed = left.where(F.col(key).isNotNull())
    matched = keyed.join(right, key, "inner")
    unmatched = keyed.join(right.select(key).distinct(), key, "left_anti")
    keyless = left.where(F.col(key).isNull())
    return matched.unionByName(unmatched.unionByName(keyless), allowMissingColumns=True)

