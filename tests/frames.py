"""Tiny lending tables with sensible defaults for the columns a test does not care about."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, types as T

from loanbook.schemas import TABLES

D = dt.date

_DEFAULTS = {
    "loan_contracts": dict(
        loan_contract_id=1, loan_application_id=1, contract_number="N", signing_date=D(2024, 1, 1),
        principal_amount="1000.00", interest_rate="12.0000", term_months=12, start_date=D(2024, 1, 1),
        maturity_date=D(2025, 1, 1), contract_status="active", closed_date=None,
    ),
    "application_scores": dict(
        application_score_id=1, loan_application_id=1, model_name="m", model_version="1", score=600,
        probability_of_default="0.100000", calculated_at=dt.datetime(2024, 1, 1),
    ),
    "payment_schedule": dict(
        payment_schedule_id=1, loan_contract_id=1, installment_number=1, due_date=D(2024, 6, 1),
        principal_due="100.00", interest_due="0.00", fee_due="0.00", total_due="100.00",
    ),
    "payments": dict(
        payment_id=1, payment_schedule_id=1, payment_date=D(2024, 6, 1), principal_paid="100.00",
        interest_paid="0.00", fee_paid="0.00", payment_amount="100.00", payment_method="card",
        payment_status="posted", created_at=dt.datetime(2024, 6, 1),
    ),
    "delinquency_events": dict(
        delinquency_event_id=1, payment_schedule_id=1, delinquency_start_date=D(2024, 6, 2),
        delinquency_end_date=None, overdue_principal="100.00", overdue_interest="0.00", overdue_fee="0.00",
        max_dpd=10, penalty_rate="20.0000", penalty_amount="0.00", delinquency_status="open",
    ),
}


def table(spark: SparkSession, name: str, *rows: dict, **extra: T.DataType) -> DataFrame:
    """Rows of one lending table; ``extra`` columns follow the declared ones."""
    declared = TABLES[name].schema
    fields = [T.StructField(f.name, f.dataType, True) for f in declared.fields]
    fields += [T.StructField(n, kind, True) for n, kind in extra.items()]
    values = []
    for row in rows:
        full = {**_DEFAULTS.get(name, {}), **row}
        values.append([_typed(full.get(f.name), f.dataType) for f in fields])
    return spark.createDataFrame(values, T.StructType(fields))


SNAPSHOT = T.StructType(
    [
        T.StructField("loan_contract_id", T.LongType()),
        T.StructField("contract_number", T.StringType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("maturity_date", T.DateType()),
        T.StructField("principal_amount", T.DecimalType(15, 2)),
        T.StructField("contract_status", T.StringType()),
        T.StructField("paid_principal", T.DecimalType(25, 2)),
        T.StructField("outstanding_principal", T.DecimalType(25, 2)),
        T.StructField("overdue_principal", T.DecimalType(25, 2)),
        T.StructField("current_dpd", T.IntegerType()),
        T.StructField("max_dpd", T.IntegerType()),
        T.StructField("dpd_bucket", T.StringType()),
    ]
)


def snapshot(spark: SparkSession, *rows: dict) -> DataFrame:
    base = dict(
        loan_contract_id=1, contract_number="N", start_date=D(2024, 1, 1), maturity_date=D(2025, 1, 1),
        principal_amount="1000.00", contract_status="active", paid_principal="0.00", outstanding_principal="1000.00",
        overdue_principal="0.00", current_dpd=0, max_dpd=0, dpd_bucket="Current",
    )
    values = [[_typed({**base, **row}[f.name], f.dataType) for f in SNAPSHOT.fields] for row in rows]
    return spark.createDataFrame(values, SNAPSHOT)


def _typed(value, kind: T.DataType):
    if value is not None and isinstance(kind, T.DecimalType):
        return Decimal(str(value))
    return value
