"""Summaries that confirm a loaded batch looks right."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loanbook.functions.measures import bucket
from loanbook.schemas import RUN_KEY

# Buckets of the open-delinquency distribution, in report order.
OPEN_DPD_CURRENT = "Current"
OPEN_DPD_EDGES = [(30, "1-30"), (60, "31-60"), (90, "61-90")]
OPEN_DPD_ABOVE = "90+"


def batch_entity_counts(
    contracts: DataFrame, schedule: DataFrame, payments: DataFrame, events: DataFrame
) -> DataFrame:
    """Rows of each entity per batch, for batches that hold contracts.

    Every table is counted where it stands by its own run key.  Joining the
    entities first would multiply payments by events for each instalment.
    """
    counted = {
        "generated_contracts": contracts,
        "generated_schedule_rows": schedule,
        "generated_payments": payments,
        "generated_delinquency_events": events,
    }
    stacked = None
    for name, df in counted.items():
        ones = df.select(RUN_KEY, F.lit(1).alias(name))
        stacked = ones if stacked is None else stacked.unionByName(ones, allowMissingColumns=True)
    return (
        stacked.groupBy(RUN_KEY)
        .agg(*[F.count(name).alias(name) for name in counted])
        .where(F.col("generated_contracts") > 0)
        .orderBy(RUN_KEY)
    )


def contract_status_counts(contracts: DataFrame) -> DataFrame:
    """Contracts per status, most frequent first."""
    return (
        contracts.groupBy("contract_status")
        .agg(F.count("*").alias("contracts"))
        .orderBy(F.desc("contracts"), "contract_status")
    )


def open_dpd_distribution(contracts: DataFrame, schedule: DataFrame, events: DataFrame) -> DataFrame:
    """Contracts by the worst delinquency still open.  Empty buckets give no row."""
    per_instalment = (
        events.where(F.col("delinquency_status") == "open")
        .groupBy("payment_schedule_id")
        .agg(F.max("max_dpd").alias("dpd"))
    )
    per_contract = (
        schedule.select("payment_schedule_id", "loan_contract_id")
        .join(per_instalment, "payment_schedule_id")
        .groupBy("loan_contract_id")
        .agg(F.max("dpd").alias("dpd"))
    )
    dpd = F.col("dpd")
    # A value below one is no regular bucket and lands in the open-ended one.
    late = F.when(dpd >= 1, bucket(dpd, OPEN_DPD_EDGES, OPEN_DPD_ABOVE)).otherwise(OPEN_DPD_ABOVE)
    label = F.when(dpd.isNull(), OPEN_DPD_CURRENT).otherwise(late)
    order = [OPEN_DPD_CURRENT] + [name for _, name in OPEN_DPD_EDGES] + [OPEN_DPD_ABOVE]
    return (
        contracts.select("loan_contract_id")
        .join(per_contract, "loan_contract_id", "left")
        .groupBy(label.alias("dpd_bucket"))
        .agg(F.count("*").alias("contracts"))
        .coalesce(1)  # at most five groups, already combined
        .orderBy(F.array_position(F.array(*[F.lit(name) for name in order]), F.col("dpd_bucket")))
    )
