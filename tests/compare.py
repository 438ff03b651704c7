"""Run a registered query and its SQL and compare the results cell by cell."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.is_dir():
            path = path / "*.parquet"
        if path.parent.exists() and (path.exists() or "*" in path.name):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(row) for row in df.select(*names).collect())


def duck_rows(connection, sql: str) -> tuple[list[str], Counter]:
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    return names, Counter(tuple(row[i] for i in order) for row in cursor.fetchall())


def assert_same(df, connection, sql: str) -> int:
    names, ours = spark_rows(df)
    expected_names, theirs = duck_rows(connection, sql)
    assert names == expected_names
    missing, extra = theirs - ours, ours - theirs
    assert not missing and not extra, f"missing {list(missing)[:3]} extra {list(extra)[:3]}"
    kinds = [{type(v) for v in column if v is not None} for column in zip(*ours)]
    expected_kinds = [{type(v) for v in column if v is not None} for column in zip(*theirs)]
    assert kinds == expected_kinds
    return sum(ours.values())
