"""The lending tables as one object."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame

from loanbook.schemas import RUN_KEY, TABLES


@dataclass(frozen=True)
class LoanBook:
    """One DataFrame per lending table.  Tables a job does not need may stay None."""

    customers: DataFrame | None = None
    customer_income: DataFrame | None = None
    income_verifications: DataFrame | None = None
    loan_applications: DataFrame | None = None
    application_scores: DataFrame | None = None
    application_decisions: DataFrame | None = None
    loan_contracts: DataFrame | None = None
    loan_collateral: DataFrame | None = None
    loan_disbursements: DataFrame | None = None
    payment_schedule: DataFrame | None = None
    payments: DataFrame | None = None
    delinquency_events: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        present = {f.name: getattr(self, f.name) for f in fields(self)}
        return {name: df for name, df in present.items() if df is not None}

    def with_tables(self, **tables: DataFrame) -> LoanBook:
        return replace(self, **tables)

    def register_views(self, prefix: str = "") -> None:
        """Expose every table, and the mart where its tables are there, to ``spark.sql`` under its own name."""
        from loanbook.operators.snapshot import portfolio_snapshot

        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)
        sources = (self.loan_contracts, self.payment_schedule, self.payments, self.delinquency_events)
        if all(df is not None for df in sources):
            portfolio_snapshot(*sources).createOrReplaceTempView(f"{prefix}portfolio_snapshot")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of ``df`` in the declared order and types, plus the run key if it has one.

    Columns that have their type already stay plain references, so that Spark
    recognises equal subplans built on them.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    columns = [
        f.name if present[f.name] == f.dataType else f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}"
        for f in TABLES[table].schema.fields
    ]
    if RUN_KEY in present:
        columns.append(RUN_KEY)
    return df.selectExpr(*columns)
