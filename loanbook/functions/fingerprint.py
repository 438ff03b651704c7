"""Keys that follow from content, whatever the order and partitioning of the rows.

Every row is written as text and hashed; the hashes are combined by operations that do not
care for order, so that a fingerprint is one aggregation, also as a metric observed while
the rows are written.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame, functions as F

NULL_TEXT = "\\N"
SEPARATOR = "\x1f"


def row_text(columns: list[str]) -> Column:
    return F.concat_ws(SEPARATOR, *(F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT)) for c in columns))


def fingerprint(wide: Column, narrow: Column) -> list[Column]:
    """Aggregates ``rows``, ``mixed`` and ``summed`` of two hashes of each row.

    ``mixed`` combines the wide hashes by exclusive or, in which equal rows cancel;
    ``summed`` adds the narrow ones, which fit a long up to 5e11 rows with 24 bits each.
    """
    return [
        F.count("*").alias("rows"),
        F.coalesce(F.bit_xor(wide), F.lit(0).cast("long")).alias("mixed"),
        F.coalesce(F.sum(narrow), F.lit(0).cast("long")).alias("summed"),
    ]


def portable_hashes(columns: list[str]) -> list[Column]:
    """60 and 24 bits of the row's text, by a hash that other engines have as well."""
    digest = F.md5(row_text(columns).cast("binary"))
    return [_number(digest, 1, 15), _number(digest, 16, 6)]


def fast_hashes(columns: list[str]) -> list[Column]:
    return [F.xxhash64(*columns), F.shiftrightunsigned(F.xxhash64(F.lit(1), *columns), 40)]


def _number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def batch_keys(rows: DataFrame, by: str, as_of: dt.date) -> DataFrame:
    """(``by``, batch_rows, batch_key): a key per batch from its day and the content of its rows."""
    columns = [c for c in rows.columns if c != by]
    found = rows.groupBy(by).agg(*fingerprint(*portable_hashes(columns)))
    text = F.concat_ws(":", *(F.col(c).cast("string") for c in ("rows", "mixed", "summed")))
    key = F.concat(F.date_format(F.lit(as_of), "yyyyMMdd"), F.lit("-"), F.substring(F.md5(text.cast("binary")), 1, 12))
    return found.select(by, F.col("rows").alias("batch_rows"), key.alias("batch_key"))


def combined(parts: dict[str, tuple[int, int, int]]) -> str:
    """One key of several tables' (rows, mixed, summed)."""
    text = ";".join(f"{name}:{':'.join(map(str, parts[name]))}" for name in sorted(parts))
    return hashlib.md5(text.encode()).hexdigest()
