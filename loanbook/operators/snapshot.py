"""The contract-level mart every report reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loanbook.functions.measures import MONEY_TOTAL, bucket

# Delinquency buckets of the mart, in report order.
CURRENT = "Current"
DPD_EDGES = [(0, CURRENT), (30, "1-30"), (60, "31-60"), (89, "61-89")]
DPD_ABOVE = "90+"
DPD_BUCKETS = [label for _, label in DPD_EDGES] + [DPD_ABOVE]

SNAPSHOT_COLUMNS = [
    "loan_contract_id", "contract_number", "start_date", "maturity_date", "principal_amount", "contract_status",
    "paid_principal", "outstanding_principal", "overdue_principal", "current_dpd", "max_dpd", "dpd_bucket",
]


def portfolio_snapshot(
    contracts: DataFrame, schedule: DataFrame, payments: DataFrame, events: DataFrame, bucketed: bool = False
) -> DataFrame:
    """One row per contract with its balances and days past due.

    Payments and delinquency events are stacked and combined per instalment
    first.  The combination runs before the shuffle, so an instalment with very
    many payments moves as one row per task, and a single join then takes both
    facts to their contract.  ``current_dpd`` is the value stored on open events;
    it does not age with the calendar.

    With ``bucketed`` the three tables lie in buckets of the instalment key.  A stack of
    them would lose the buckets, so each is combined and joined on its own, in place.
    """
    is_open = F.col("delinquency_status") == "open"
    paid = payments.where(F.col("payment_status") == "posted").select(
        "payment_schedule_id", F.col("principal_paid").alias("paid")
    )
    late = events.select(
        "payment_schedule_id",
        F.when(is_open, F.col("overdue_principal")).alias("overdue"),
        F.when(is_open, F.col("max_dpd")).alias("open_dpd"),
        F.col("max_dpd").alias("any_dpd"),
    )
    sums = [F.sum(c).cast(MONEY_TOTAL).alias(c) for c in ("paid", "overdue")]
    highest = [F.max(c).alias(c) for c in ("open_dpd", "any_dpd")]
    instalments = schedule.select("payment_schedule_id", "loan_contract_id")
    if bucketed:
        paid_each = paid.groupBy("payment_schedule_id").agg(sums[0])
        late_each = late.groupBy("payment_schedule_id").agg(sums[1], *highest)
        facts = instalments.join(paid_each, "payment_schedule_id", "left").join(late_each, "payment_schedule_id", "left")
    else:
        stacked = paid.unionByName(late, allowMissingColumns=True)
        facts = stacked.groupBy("payment_schedule_id").agg(*sums, *highest).join(instalments, "payment_schedule_id")
    per_contract = (
        facts.groupBy("loan_contract_id")
        .agg(
            F.sum("paid").alias("paid"),
            F.sum("overdue").alias("overdue"),
            F.max("open_dpd").alias("open_dpd"),
            F.max("any_dpd").alias("any_dpd"),
        )
    )
    paid_principal = F.coalesce("paid", F.lit(0)).cast(MONEY_TOTAL)
    current_dpd = F.coalesce("open_dpd", F.lit(0))
    return contracts.join(per_contract, "loan_contract_id", "left").select(
        "loan_contract_id",
        "contract_number",
        "start_date",
        "maturity_date",
        "principal_amount",
        "contract_status",
        paid_principal.alias("paid_principal"),
        (F.col("principal_amount") - paid_principal).cast(MONEY_TOTAL).alias("outstanding_principal"),
        F.coalesce("overdue", F.lit(0)).cast(MONEY_TOTAL).alias("overdue_principal"),
        current_dpd.alias("current_dpd"),
        F.coalesce("any_dpd", F.lit(0)).alias("max_dpd"),
        _dpd_bucket(current_dpd).alias("dpd_bucket"),
    )


def _dpd_bucket(current_dpd):
    # Zero alone is current; a negative value would be a late instalment of the first bucket.
    late = bucket(current_dpd, DPD_EDGES[1:], DPD_ABOVE)
    return F.when(current_dpd == 0, CURRENT).otherwise(late)
