"""What the reports on the mart count, under one set of names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loanbook.functions.measures import MONEY_TOTAL, count_where, money_sum

MEASURES = {
    "contracts": "bigint", "principal": MONEY_TOTAL, "outstanding": MONEY_TOTAL, "overdue": MONEY_TOTAL,
    "delinquent": "bigint", "late_30": "bigint", "late_90": "bigint", "at_risk_30": MONEY_TOTAL, "at_risk_90": MONEY_TOTAL,
}


def measures(*names: str) -> list[Column]:
    """Aggregates over contracts of the mart; all of them without names."""
    dpd, outstanding = F.col("current_dpd"), F.col("outstanding_principal")
    found = {
        "contracts": F.count("*"),
        "principal": money_sum(F.col("principal_amount")),
        "outstanding": money_sum(outstanding),
        "overdue": money_sum(F.col("overdue_principal")),
        "delinquent": count_where(dpd > 0),
        "late_30": count_where(dpd >= 30),
        "late_90": count_where(dpd >= 90),
        "at_risk_30": money_sum(outstanding, dpd >= 30),
        "at_risk_90": money_sum(outstanding, dpd >= 90),
    }
    return [found[name].alias(name) for name in names or found]
