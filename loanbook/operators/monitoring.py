"""Portfolio-level monitoring: headline KPIs and exposure by delinquency bucket."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanbook.functions.calendar import as_date
from loanbook.functions.measures import MONEY_TOTAL, on_spine, pct
from loanbook.operators.measured import measures
from loanbook.operators.snapshot import DPD_BUCKETS
from loanbook.schemas import OPEN_BOOK_STATUSES


def open_book(snapshot: DataFrame) -> DataFrame:
    """Contracts still on the book: closed and cancelled ones are left out."""
    return snapshot.where(F.col("contract_status").isin(OPEN_BOOK_STATUSES))


def portfolio_kpis(snapshot: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """One row of headline figures for the open book."""
    return kpis_of(open_book(snapshot).agg(*measures()), as_of)


def kpis_of(totals: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """The headline figures from the measures of the whole open book."""
    contracts = F.col("contracts")

    def share_of_contracts(column: str) -> Column:
        return pct(F.col(column), contracts)

    def share_of_outstanding(column: str) -> Column:
        return pct(F.col(column), F.col("outstanding"), scale=2)

    return totals.select(
        as_date(as_of).alias("report_date"),
        contracts.alias("total_contracts"),
        F.col("principal").alias("total_principal"),
        F.col("outstanding").alias("total_outstanding"),
        F.col("overdue").alias("total_overdue"),
        F.col("delinquent").alias("delinquent_contracts"),
        share_of_contracts("delinquent").alias("delinquency_rate_pct"),
        F.col("late_30").alias("dpd_30_plus_contracts"),
        share_of_contracts("late_30").alias("dpd_30_plus_rate_pct"),
        F.col("late_90").alias("dpd_90_plus_contracts"),
        share_of_contracts("late_90").alias("dpd_90_plus_rate_pct"),
        share_of_outstanding("at_risk_30").alias("par_30_pct"),
        share_of_outstanding("at_risk_90").alias("par_90_pct"),
        share_of_outstanding("overdue").alias("overdue_share_pct"),
    )


def dpd_bucket_summary(snapshot: DataFrame) -> DataFrame:
    """Exposure of the open book by current delinquency bucket, one row per bucket."""
    wanted = measures("contracts", "principal", "outstanding", "overdue")
    return buckets_of(open_book(snapshot).groupBy("dpd_bucket").agg(*wanted))


def buckets_of(summary: DataFrame) -> DataFrame:
    """The report from the measures of each bucket that has contracts."""

    def filled(column: str, kind: str = MONEY_TOTAL) -> Column:
        return F.coalesce(column, F.lit(0)).cast(kind)

    everything = Window.partitionBy()  # over the five report rows only
    rows = on_spine(summary, "dpd_bucket", DPD_BUCKETS).select(
        "dpd_bucket",
        "sort_order",
        filled("contracts", "bigint").alias("contract_count"),
        filled("principal").alias("total_principal"),
        filled("outstanding").alias("outstanding_principal"),
        filled("overdue").alias("overdue_principal"),
    )
    # An empty book has no contract share at all: that division is an error, not NULL.
    contract_share = pct(
        F.col("contract_count"), F.sum("contract_count").over(everything), zero_is_null=False
    )
    outstanding_share = pct(
        F.col("outstanding_principal"),
        F.sum("outstanding_principal").over(everything).cast(MONEY_TOTAL),
        scale=2,
    )
    return (
        rows.withColumns({"share_of_contracts_pct": contract_share, "share_of_outstanding_pct": outstanding_share})
        .orderBy("sort_order")
        .drop("sort_order")
    )
