"""Payment behaviour: instalment states, monthly performance, delinquency outcomes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanbook.functions.calendar import as_date, month_start
from loanbook.functions.joins import left_join_many
from loanbook.functions.measures import MONEY_TOTAL, bucket, count_where, mean, money_sum, on_spine, pct, sum_where

# --- Fixed values: report buckets and labels ---------------------------------
EVENT_DPD_EDGES = [(7, "1-7"), (30, "8-30"), (60, "31-60"), (90, "61-90")]
EVENT_DPD_ABOVE = "91+"
EARLY_INSTALMENTS = 3
TIMINGS = ["No delinquency", "First 3 installments", "After 3 installments"]
# -----------------------------------------------------------------------------


def classify_installments(schedule: DataFrame, payments: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """Every instalment with each of its posted payments, and the state it is in.

    An instalment paid in several parts gives one row per part, each carrying
    the whole scheduled amount.
    """
    due = F.col("due_date")
    paid_on = F.col("payment_date")
    posted = payments.where(F.col("payment_status") == "posted").select(
        "payment_schedule_id", "payment_date", "payment_amount", "payment_status"
    )
    instalments = schedule.select("payment_schedule_id", "loan_contract_id", "due_date", "total_due")
    state = (
        F.when(due > as_date(as_of), "not_due")
        .when(paid_on.isNull(), "unpaid")
        .when(paid_on <= due, "on_time")
        .otherwise("late")
    )
    return left_join_many(instalments, posted, "payment_schedule_id").select(
        "payment_schedule_id",
        "loan_contract_id",
        "due_date",
        "payment_date",
        F.col("total_due").alias("scheduled_amount"),
        F.coalesce("payment_amount", F.lit(0)).cast("decimal(15,2)").alias("paid_amount"),
        "payment_status",
        month_start(due).alias("payment_month"),
        state.alias("payment_state"),
        F.when(paid_on > due, F.date_diff(paid_on, due)).alias("payment_delay_days"),
    )


def monthly_payment_performance(schedule: DataFrame, payments: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """Collection and punctuality by the month instalments fell due.

    An instalment paid in several parts counts once per part, with its whole
    amount each time.  The parts are combined per instalment and day before the
    join and carried as a weight, which bounds the rows per instalment by its
    number of payment days.
    """
    due = F.col("due_date")
    paid_on = F.col("payment_date")
    fallen_due = schedule.where(due <= as_date(as_of)).select("payment_schedule_id", "due_date", "total_due")
    parts = (
        payments.where(F.col("payment_status") == "posted")
        .groupBy("payment_schedule_id", "payment_date")
        .agg(F.count("*").alias("parts"), F.sum("payment_amount").cast(MONEY_TOTAL).alias("paid"))
    )
    weight = F.coalesce("parts", F.lit(1))

    def weighted(value: Column, condition: Column) -> Column:
        return F.coalesce(sum_where(value, condition), F.lit(0))

    summary = (
        fallen_due.join(parts, "payment_schedule_id", "left")
        .groupBy(month_start(due).alias("payment_month"))
        .agg(
            F.sum(weight).alias("scheduled_installments"),
            weighted(weight, paid_on.isNotNull()).alias("paid_installments"),
            weighted(weight, paid_on <= due).alias("on_time_installments"),
            weighted(weight, paid_on > due).alias("late_installments"),
            weighted(weight, paid_on.isNull()).alias("unpaid_installments"),
            money_sum(F.col("total_due") * weight.cast("decimal(12,0)")).alias("scheduled_amount"),
            money_sum(F.col("paid")).alias("paid_amount"),
            sum_where(weight * F.date_diff(paid_on, due), paid_on > due).alias("delay_days"),
        )
    )
    return summary.select(
        "payment_month",
        "scheduled_installments",
        "paid_installments",
        "on_time_installments",
        "late_installments",
        "unpaid_installments",
        "scheduled_amount",
        "paid_amount",
        pct(F.col("on_time_installments"), F.col("scheduled_installments")).alias("on_time_payment_rate_pct"),
        pct(F.col("paid_amount"), F.col("scheduled_amount"), scale=2).alias("collection_rate_pct"),
        mean(F.col("delay_days"), F.col("late_installments")).alias("average_payment_delay_days"),
    ).orderBy("payment_month")


def delinquency_resolution(events: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """How delinquency episodes ended, by how late they got."""
    closed = F.col("delinquency_status") == "closed"
    still_open = F.col("delinquency_status") == "open"
    to_resolution = F.date_diff("delinquency_end_date", "delinquency_start_date")
    open_for = F.date_diff(as_date(as_of), "delinquency_start_date")
    summary = (
        events.where(F.col("max_dpd") > 0)
        .groupBy(bucket(F.col("max_dpd"), EVENT_DPD_EDGES, EVENT_DPD_ABOVE).alias("dpd_bucket"))
        .agg(
            F.count("*").alias("total"),
            count_where(closed).alias("closed"),
            count_where(still_open).alias("open"),
            sum_where(to_resolution, closed).alias("resolution_days"),
            F.count(F.when(closed, to_resolution)).alias("resolution_count"),
            # Exact: the buffer holds one entry per distinct number of days.
            F.percentile(F.when(closed, to_resolution), 0.5).alias("median_days_to_resolution"),
            sum_where(open_for, still_open).alias("open_days"),
            F.count(F.when(still_open, open_for)).alias("open_count"),
        )
    )

    def filled(column: str) -> Column:
        return F.coalesce(column, F.lit(0)).cast("bigint")

    labels = [label for _, label in EVENT_DPD_EDGES] + [EVENT_DPD_ABOVE]
    return (
        on_spine(summary, "dpd_bucket", labels)
        .orderBy("sort_order")
        .select(
            "dpd_bucket",
            filled("total").alias("total_events"),
            filled("closed").alias("closed_events"),
            filled("open").alias("open_events"),
            pct(F.col("closed"), F.col("total")).alias("resolution_rate_pct"),
            mean(F.col("resolution_days"), F.col("resolution_count")).alias("avg_days_to_resolution"),
            "median_days_to_resolution",
            mean(F.col("open_days"), F.col("open_count")).alias("avg_open_duration_days"),
        )
    )


def early_delinquency_analysis(contracts: DataFrame, schedule: DataFrame, events: DataFrame) -> DataFrame:
    """Lifetime outcomes of all contracts by when they first fell behind."""
    per_instalment = events.groupBy("payment_schedule_id").agg(F.max("max_dpd").alias("max_dpd"))
    per_contract = (
        schedule.select("payment_schedule_id", "loan_contract_id", "installment_number")
        .join(per_instalment, "payment_schedule_id")
        .groupBy("loan_contract_id")
        .agg(F.min("installment_number").alias("first_late"), F.max("max_dpd").alias("max_dpd"))
    )
    first = F.col("first_late")
    never, early, later = TIMINGS
    timing = F.when(first.isNull(), never).when(first <= EARLY_INSTALMENTS, early).otherwise(later)
    dpd = F.coalesce("max_dpd", F.lit(0))
    summary = (
        contracts.select("loan_contract_id", "contract_status")
        .join(per_contract, "loan_contract_id", "left")
        .groupBy(timing.alias("delinquency_timing"))
        .agg(
            F.count("*").alias("contract_count"),
            count_where(dpd > 30).alias("ever_30_plus_contracts"),
            count_where(dpd > 90).alias("ever_90_plus_contracts"),
            count_where(F.col("contract_status") == "defaulted").alias("defaulted_contracts"),
        )
        .coalesce(1)  # at most three groups, already combined
    )
    contract_count = F.col("contract_count")
    everything = Window.partitionBy()  # over at most three groups

    def rate(column: str) -> Column:
        return pct(F.col(column), contract_count)

    return summary.select(
        "delinquency_timing",
        "contract_count",
        pct(contract_count, F.sum(contract_count).over(everything)).alias("share_of_contracts_pct"),
        "ever_30_plus_contracts",
        rate("ever_30_plus_contracts").alias("ever_30_plus_rate_pct"),
        "ever_90_plus_contracts",
        rate("ever_90_plus_contracts").alias("ever_90_plus_rate_pct"),
        "defaulted_contracts",
        rate("defaulted_contracts").alias("default_rate_pct"),
    ).orderBy(F.array_position(F.array(*[F.lit(t) for t in TIMINGS]), F.col("delinquency_timing")))
