"""Risk by segment of the book, and the contracts that need attention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanbook.functions.calendar import as_date, full_months
from loanbook.functions.joins import left_join_many
from loanbook.functions.measures import (
    MONEY_TOTAL, RATE, bucket, count_where, mean, money_sum, on_spine, pct, sum_where,
)
from loanbook.operators.measured import measures
from loanbook.operators.monitoring import open_book

# --- Fixed values: report segments, thresholds and labels --------------------
LOAN_SIZE_EDGES = [(1_000_000, "Up to 1M"), (3_000_000, "1M-3M")]
LOAN_SIZE_ABOVE = "3M+"
MOB_EDGES = [(6, "0-6 months"), (12, "7-12 months"), (24, "13-24 months")]
MOB_ABOVE = "25+ months"
SCORE_RANGE = (350, 850)
SCORE_EDGES = [(449, "350-449"), (549, "450-549"), (649, "550-649"), (749, "650-749"), (850, "750-850")]
LOW_SCORE = 550
PRIORITIES = ["Critical", "High", "Medium"]
# -----------------------------------------------------------------------------


def risk_by_loan_size(snapshot: DataFrame) -> DataFrame:
    """Open book by original principal."""
    return loan_sizes_of(_segments(snapshot, "loan_size_segment", loan_size()))


def risk_by_months_on_book(snapshot: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """Open book by completed months since the contract started."""
    return months_of(_segments(snapshot, "mob_segment", months_on_book(as_of)))


def loan_size() -> Column:
    return bucket(F.col("principal_amount"), LOAN_SIZE_EDGES, LOAN_SIZE_ABOVE)


def months_on_book(as_of: dt.date | Column) -> Column:
    return bucket(full_months(F.col("start_date"), as_date(as_of)), MOB_EDGES, MOB_ABOVE)


def loan_sizes_of(summary: DataFrame) -> DataFrame:
    """The report from the measures of each loan size that has contracts."""
    labels = [label for _, label in LOAN_SIZE_EDGES] + [LOAN_SIZE_ABOVE]
    return _segment_report(summary, "loan_size_segment", labels).drop("share_of_outstanding_pct")


def months_of(summary: DataFrame) -> DataFrame:
    """The report from the measures of each age that has contracts."""
    return _segment_report(summary, "mob_segment", [label for _, label in MOB_EDGES] + [MOB_ABOVE])


def _segments(snapshot: DataFrame, key: str, segment: Column) -> DataFrame:
    wanted = measures("contracts", "principal", "outstanding", "delinquent", "late_30", "at_risk_30")
    return open_book(snapshot).groupBy(segment.alias(key)).agg(*wanted)


def _segment_report(summary: DataFrame, key: str, labels: list[str]) -> DataFrame:
    def filled(column: str, kind: str = "bigint") -> Column:
        return F.coalesce(column, F.lit(0)).cast(kind)

    rows = on_spine(summary, key, labels).select(
        key,
        "sort_order",
        filled("contracts").alias("contract_count"),
        filled("principal", MONEY_TOTAL).alias("total_principal"),
        filled("outstanding", MONEY_TOTAL).alias("total_outstanding"),
        filled("delinquent").alias("delinquent_contracts"),
        filled("late_30").alias("dpd_30_plus_contracts"),
        "at_risk_30",
    )
    contracts = F.col("contract_count")
    total = F.col("total_outstanding")
    everything = Window.partitionBy()  # over the report rows only
    average = mean(total, contracts, scale=2)
    return (
        rows.select(
            key,
            "sort_order",
            "contract_count",
            "total_principal",
            "total_outstanding",
            pct(total, F.sum(total).over(everything).cast(MONEY_TOTAL), scale=2).alias("share_of_outstanding_pct"),
            "delinquent_contracts",
            pct(F.col("delinquent_contracts"), contracts).alias("delinquency_rate_pct"),
            "dpd_30_plus_contracts",
            pct(F.col("dpd_30_plus_contracts"), contracts).alias("dpd_30_plus_rate_pct"),
            pct(F.col("at_risk_30"), total, scale=2).alias("par_30_pct"),
            F.coalesce(average, F.lit(0)).cast(RATE).alias("average_outstanding"),
        )
        .orderBy("sort_order")
        .drop("sort_order")
    )


def risk_by_score_band(contracts: DataFrame, scores: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Lifetime delinquency and default of all contracts by application score.

    An application scored several times counts its contract once per score.
    Scores are combined per application and band before the joins, so the
    repeats travel as a weight instead of as copies of the contract.  Scores
    outside the bands drop out.
    """
    band = F.when(F.col("score").between(*SCORE_RANGE), bucket(F.col("score"), SCORE_EDGES, None))
    weighted = (
        scores.select("loan_application_id", band.alias("score_band"), "score", "probability_of_default")
        .where(F.col("score_band").isNotNull())
        .groupBy("loan_application_id", "score_band")
        .agg(
            F.count("*").alias("weight"),
            F.sum("score").alias("score_sum"),
            F.sum("probability_of_default").alias("pd_sum"),
            F.count("probability_of_default").alias("pd_count"),
        )
    )
    scored = (
        contracts.select("loan_contract_id", "loan_application_id", "contract_status")
        .join(weighted, "loan_application_id")
        .join(snapshot.select("loan_contract_id", "outstanding_principal", "max_dpd"), "loan_contract_id", "left")
    )
    weight = F.col("weight")
    exposure = F.col("outstanding_principal") * weight.cast("decimal(12,0)")
    late_30 = F.col("max_dpd") >= 30
    late_90 = F.col("max_dpd") >= 90
    summary = scored.groupBy("score_band").agg(
        F.sum(weight).alias("contracts"),
        F.sum("score_sum").alias("score_sum"),
        F.sum("pd_sum").cast("decimal(24,6)").alias("pd_sum"),
        F.sum("pd_count").alias("pd_count"),
        sum_where(weight, late_30).alias("late_30"),
        sum_where(weight, late_90).alias("late_90"),
        sum_where(weight, F.col("contract_status") == "defaulted").alias("defaulted"),
        money_sum(exposure).alias("outstanding"),
        money_sum(exposure, late_30).alias("outstanding_30"),
        money_sum(exposure, late_90).alias("outstanding_90"),
    )

    def filled(column: str, kind: str = "bigint") -> Column:
        return F.coalesce(column, F.lit(0)).cast(kind)

    rows = on_spine(summary, "score_band", [label for _, label in SCORE_EDGES]).select(
        "score_band",
        "sort_order",
        filled("contracts").alias("total_contracts"),
        "score_sum",
        "pd_sum",
        "pd_count",
        filled("late_30").alias("ever_dpd_30_plus_contracts"),
        filled("late_90").alias("ever_dpd_90_plus_contracts"),
        filled("defaulted").alias("status_defaulted_contracts"),
        filled("outstanding", MONEY_TOTAL).alias("total_outstanding"),
        filled("outstanding_30", MONEY_TOTAL).alias("ever_dpd_30_plus_outstanding"),
        filled("outstanding_90", MONEY_TOTAL).alias("ever_dpd_90_plus_outstanding"),
    )
    total = F.col("total_contracts")
    outstanding = F.col("total_outstanding")

    def contract_rate(column: str) -> Column:
        return pct(F.col(column), total)

    def outstanding_share(column: str) -> Column:
        return pct(F.col(column), outstanding, scale=2)

    return rows.orderBy("sort_order").select(
        "score_band",
        "total_contracts",
        mean(F.col("score_sum"), total).alias("avg_score"),
        mean(F.col("pd_sum") * 100, F.col("pd_count"), scale=6).alias("avg_pd_pct"),
        "ever_dpd_30_plus_contracts",
        "ever_dpd_90_plus_contracts",
        "status_defaulted_contracts",
        contract_rate("ever_dpd_30_plus_contracts").alias("ever_dpd_30_plus_rate_pct"),
        contract_rate("ever_dpd_90_plus_contracts").alias("ever_dpd_90_plus_rate_pct"),
        contract_rate("status_defaulted_contracts").alias("status_default_rate_pct"),
        "total_outstanding",
        "ever_dpd_30_plus_outstanding",
        outstanding_share("ever_dpd_30_plus_outstanding").alias("ever_dpd_30_plus_outstanding_share_pct"),
        "ever_dpd_90_plus_outstanding",
        outstanding_share("ever_dpd_90_plus_outstanding").alias("ever_dpd_90_plus_outstanding_share_pct"),
    )


def high_risk_watchlist(
    snapshot: DataFrame, contracts: DataFrame, scores: DataFrame, top: int | None = None
) -> DataFrame:
    """Contracts with a balance that are 30 or more days late, defaulted or restructured.

    Cancelled contracts stay in.  ``top`` keeps only the first rows of the
    ranking.
    """
    dpd = F.col("current_dpd")
    status = F.col("contract_status")
    listed = snapshot.where(
        (status != "closed")
        & (F.col("outstanding_principal") > 0)
        & ((dpd >= 30) | status.isin("defaulted", "restructured"))
    )
    applications = contracts.select("loan_contract_id", "loan_application_id")
    scored = left_join_many(
        listed.join(applications, "loan_contract_id", "left"),
        scores.select("loan_application_id", "score", "probability_of_default"),
        "loan_application_id",
    )
    priority = (
        F.when((status == "defaulted") | (dpd >= 90), "Critical")
        .when((status == "restructured") | (dpd >= 61), "High")
        .when(dpd >= 30, "Medium")
    )
    lateness = (
        F.when(dpd >= 90, "Current DPD 90+").when(dpd >= 61, "Current DPD 61-89").when(dpd >= 30, "Current DPD 30-60")
    )
    low_score = F.when(F.col("score") < LOW_SCORE, "Low score")
    problem = F.when(status == "defaulted", "Defaulted status").when(status == "restructured", "Restructured status")
    ranked = scored.withColumns(
        {"priority": priority, "risk_reason": F.concat_ws("; ", lateness, low_score, problem)}
    ).orderBy(
        F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority")),
        F.desc("current_dpd"),
        F.desc("outstanding_principal"),
        # Ties in the ranking get a fixed order, which also lets the sort split them.
        "loan_contract_id",
        "score",
        "probability_of_default",
    )
    if top is not None:
        ranked = ranked.limit(top)
    return ranked.select(
        "loan_contract_id", "contract_number", "contract_status", "score", "probability_of_default",
        "outstanding_principal", "overdue_principal", "current_dpd", "max_dpd", "dpd_bucket", "priority", "risk_reason",
    )
