"""Four reports from one pass over the mart.

KPIs and the reports by delinquency bucket, loan size and months on book count the same
contracts by the same measures.  One aggregation over grouping sets makes all of them: the
mart is scanned once, and what moves is one row per task and report line.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from loanbook.operators import monitoring, segmentation
from loanbook.operators.measured import MEASURES, measures

#: Reports by the column that makes their lines, in the order of the grouping sets; the last has one line.
REPORTS = {
    "dpd_bucket_summary": "dpd_bucket",
    "risk_by_loan_size": "loan_size_segment",
    "risk_by_months_on_book": "mob_segment",
    "portfolio_kpis": None,
}


def mart_summary(snapshot: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """(report, segment, measures): a row per report and line that has contracts."""
    keys = [key for key in REPORTS.values() if key]
    lines = monitoring.open_book(snapshot).withColumns(
        {"loan_size_segment": segmentation.loan_size(), "mob_segment": segmentation.months_on_book(as_of)}
    )
    grouped = lines.groupingSets([[key] if key else [] for key in REPORTS.values()], *keys).agg(
        *[F.grouping(key).alias(f"_no_{key}") for key in keys], *measures()
    )
    report, segment = F.lit("portfolio_kpis"), F.lit(None).cast("string")
    for name, key in REPORTS.items():
        if key:
            own = F.col(f"_no_{key}") == 0
            report, segment = F.when(own, name).otherwise(report), F.when(own, F.col(key)).otherwise(segment)
    return grouped.select(report.alias("report"), segment.alias("segment"), *MEASURES)


def reports(summary: DataFrame, as_of: dt.date | Column) -> dict[str, DataFrame]:
    """The four reports from a summary, best a stored one: it has at most a line per report and segment."""

    def lines(name: str) -> DataFrame:
        key = REPORTS[name]
        rows = summary.where(F.col("report") == name)
        return rows.select(F.col("segment").alias(key), *MEASURES) if key else rows.select(*MEASURES)

    # Without contracts there is no line for the whole book: its sums are none.
    whole = lines("portfolio_kpis").agg(*[F.coalesce(F.sum(m), F.lit(0)).cast(t).alias(m) for m, t in MEASURES.items()])
    return {
        "portfolio_kpis": monitoring.kpis_of(whole, as_of),
        "dpd_bucket_summary": monitoring.buckets_of(lines("dpd_bucket_summary")),
        "risk_by_loan_size": segmentation.loan_sizes_of(lines("risk_by_loan_size")),
        "risk_by_months_on_book": segmentation.months_of(lines("risk_by_months_on_book")),
    }
