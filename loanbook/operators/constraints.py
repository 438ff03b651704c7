"""Integrity audit of the stored tables against their declared rules.

Each audit returns one row per rule with the number of violations, including the
rules that hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loanbook.book import LoanBook
from loanbook.schemas import TABLES, TEXT_LIMITS, Reference


def audit_checks(book: LoanBook) -> DataFrame:
    """Rows that break each CHECK rule.  All rules of a table are counted in one scan."""
    return _counted(book, "constraint_name", lambda t: {c.name: ~c.rule() for c in t.checks})


def audit_not_null(book: LoanBook) -> DataFrame:
    """NULLs in each column that must have a value."""
    return _counted(book, "column_name", lambda t: {name: F.expr(f"{name} IS NULL") for name in t.required})


def audit_text_lengths(book: LoanBook) -> DataFrame:
    """Values longer than their column's declared width."""
    return _counted(
        book,
        "column_name",
        lambda t: {name: F.expr(f"length({name}) > {limit}") for name, limit in TEXT_LIMITS.get(t.name, {}).items()},
    )


def audit_foreign_keys(book: LoanBook) -> DataFrame:
    """Child rows whose parent does not exist, per foreign key.

    The children of one parent are stacked and counted per key value, so each
    parent is scanned and joined once however many foreign keys point to it, and
    a value with very many child rows travels as one row per task.
    """
    tables = book.tables()
    children: dict[str, list[tuple[str, Reference]]] = {}
    for name in tables:
        for ref in TABLES[name].references:
            children.setdefault(ref.parent, []).append((name, ref))
    parts = []
    for parent, refs in children.items():
        key = TABLES[parent].key
        stacked = [
            tables[name].select(F.col(ref.column).alias(key), F.lit(ref.name).alias("_reference")) for name, ref in refs
        ]
        per_value = (
            reduce(DataFrame.unionByName, stacked)
            .where(F.col(key).isNotNull())
            .groupBy(key)
            .agg(*[F.count_if(F.col("_reference") == ref.name).alias(ref.name) for _, ref in refs])
        )
        orphans = per_value.join(tables[parent].select(key).distinct(), key, "left_anti")
        totals = orphans.agg(*[F.coalesce(F.sum(ref.name), F.lit(0)).alias(ref.name) for _, ref in refs])
        found = [
            F.struct(
                F.lit(name).alias("table_name"), F.lit(ref.name).alias("constraint_name"), F.col(ref.name).alias("violations")
            )
            for name, ref in refs
        ]
        parts.append(totals.select(F.inline(F.array(*found))))
    return reduce(DataFrame.unionByName, parts)


def orphan_rows(book: LoanBook, constraint: str) -> DataFrame:
    """The child rows behind one foreign-key finding."""
    tables = book.tables()
    for name, child in tables.items():
        for ref in TABLES[name].references:
            if ref.name == constraint:
                parents = tables[ref.parent].select(F.col(TABLES[ref.parent].key).alias(ref.column)).distinct()
                return child.where(F.col(ref.column).isNotNull()).join(parents, ref.column, "left_anti")
    raise KeyError(constraint)


def audit_uniqueness(book: LoanBook) -> DataFrame:
    """Repeated keys per primary key and unique constraint.

    ``violations`` counts the rows beyond the first of each key; NULLs never
    collide.

    Every table is read once: its keys are laid out as one row per constraint, and all are
    counted together.
    """
    parts, rules = [], []
    for name, df in book.tables().items():
        uniques = TABLES[name].uniques
        keys = [F.struct(F.lit(unique.name).alias("constraint_name"), _key_text(unique.columns).alias("key")) for unique in uniques]
        parts.append(df.select(F.lit(name).alias("table_name"), F.inline(F.array(*keys))).where("key IS NOT NULL"))
        rules += [(name, unique.name) for unique in uniques]
    found = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("table_name", "constraint_name", "key")
        .agg(F.count("*").alias("rows"))
        .groupBy("table_name", "constraint_name")
        .agg(F.count_if(F.col("rows") > 1).alias("repeated_keys"), F.sum(F.col("rows") - 1).alias("violations"))
    )
    every = found.sparkSession.createDataFrame(rules, "table_name string, constraint_name string")
    # One row per rule on either side.
    return every.join(F.broadcast(found), ["table_name", "constraint_name"], "left").fillna(0, ["repeated_keys", "violations"])


def _key_text(columns: tuple[str, ...]) -> Column:
    """The key as text, NULL if any part is."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    return F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]), F.to_json(F.struct(*columns)))


def duplicate_keys(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Key values that occur more than once, with their number of ``rows``."""
    return (
        df.select(*columns)
        .dropna(how="any")
        .groupBy(*columns)
        .agg(F.count("*").alias("rows"))
        .where(F.col("rows") > 1)
    )


def _counted(book: LoanBook, label: str, broken) -> DataFrame:
    """``(table_name, label, violations)`` with one aggregation per table."""
    parts = []
    for name, df in book.tables().items():
        rules: dict[str, Column] = broken(TABLES[name])
        if not rules:
            continue
        counts = df.agg(*[F.count_if(rule).alias(rule_name) for rule_name, rule in rules.items()])
        pairs = ", ".join(f"'{n}', {n}" for n in rules)
        parts.append(
            counts.selectExpr(f"'{name}' AS table_name", f"stack({len(rules)}, {pairs}) AS ({label}, violations)")
        )
    return reduce(DataFrame.unionByName, parts)
