"""Dense surrogate keys without a global order of the rows.

The rows are written once; from then on a file and a row's place in it do not change.  One
pass counts the rows of each file, a running sum over the files gives where each starts,
and a row's key is that plus its place.  No row moves, keys have no gaps, and a task that
runs again gives the same keys.  Files are numbered like the partitions they come from, so
the keys of rows that come in order follow it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

#: Files whose offsets are sent to every task; beyond, they are joined as a table.
_BROADCAST_FILES = 10_000


def with_dense_keys(rows: DataFrame, folder: str, column: str, first: int = 1) -> DataFrame:
    """``rows``, stored under ``folder``, with keys from ``first`` on in ``column``."""
    path = f"{folder.rstrip('/')}/keyed-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
    placed = stored.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    # One row per file.
    files = placed.groupBy("_file").agg(F.count("*").alias("_rows"))
    before = Window.orderBy(F.length("_file"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) + first).alias("_start"))
    if len(stored.inputFiles()) <= _BROADCAST_FILES:
        starts = F.broadcast(starts)
    return placed.join(starts, "_file").select(*rows.columns, (F.col("_start") + F.col("_place")).alias(column))
