"""Checks on the contract mart.  A valid snapshot gives no rows, except for the review list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def balance_consistency(snapshot: DataFrame) -> DataFrame:
    """Contracts with a negative balance, or with more overdue than outstanding."""
    outstanding = F.col("outstanding_principal")
    overdue = F.col("overdue_principal")
    return snapshot.where((F.least(outstanding, overdue) < 0) | (overdue > outstanding)).select(
        "loan_contract_id", "contract_number", "contract_status", "outstanding_principal", "overdue_principal"
    )


def contract_status_consistency(snapshot: DataFrame) -> DataFrame:
    """Active contracts 90 or more days late with a balance: to be reviewed, not an error."""
    return (
        snapshot.where(
            (F.col("contract_status") == "active")
            & (F.col("current_dpd") >= 90)
            & (F.col("outstanding_principal") > 0)
        )
        .select(
            "loan_contract_id", "contract_number", "contract_status", "current_dpd", "outstanding_principal",
            "overdue_principal", "dpd_bucket",
        )
        .orderBy(F.desc("current_dpd"), F.desc("outstanding_principal"), "loan_contract_id")
    )


def snapshot_completeness(contracts: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Contracts the snapshot lacks."""
    present = snapshot.select("loan_contract_id").distinct()
    return contracts.select("loan_contract_id", "contract_number", "contract_status").join(
        present, "loan_contract_id", "left_anti"
    )


def snapshot_grain(snapshot: DataFrame) -> DataFrame:
    """Contracts with more than one snapshot row."""
    return (
        snapshot.groupBy("loan_contract_id").agg(F.count("*").alias("row_count")).where(F.col("row_count") > 1)
    )
