"""A damaged book, so that the audits have something to find.

An audit that is only ever run on clean tables proves nothing.  Rows are picked
by the remainder of their key, so the damage is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loanbook.book import LoanBook
from loanbook.functions.measures import MONEY_TOTAL
from loanbook.schemas import TABLES

# Per table: (modulus, remainder, column, value in plain SQL).
DEFECTS: dict[str, list[tuple[int, int, str, str]]] = {
    "customers": [
        (41, 1, "customer_status", "'dormant'"),
        (43, 2, "sex", "'unknown'"),
        (47, 3, "first_name", "NULL"),
        (53, 4, "city", "repeat('x', 101)"),
    ],
    "customer_income": [
        (41, 1, "monthly_income", "0"),
        (43, 2, "currency", "'rub'"),
        (47, 3, "valid_to", "DATE '1980-01-01'"),
        (53, 4, "customer_id", "-1"),
        (59, 6, "currency", "'EURO'"),
        (67, 7, "income_source", "NULL"),
    ],
    "income_verifications": [
        (41, 1, "verification_status", "'lost'"),
        (43, 2, "verified_amount", "-1"),
        (47, 3, "verification_method", "NULL"),
        (53, 4, "customer_income_id", "-1"),
        (67, 7, "customer_income_id", "NULL"),
    ],
    "loan_applications": [
        (41, 1, "requested_amount", "0"),
        (43, 2, "requested_term_months", "0"),
        (47, 3, "expected_interest_rate", "-1"),
        (53, 4, "customer_id", "-1"),
        (59, 6, "down_payment", "-1"),
        (67, 7, "asset_value", "0"),
        (71, 8, "application_status", "'draft'"),
        (73, 9, "loan_type", "repeat('x', 31)"),
    ],
    "application_scores": [
        (41, 1, "score", "1001"),
        (43, 2, "probability_of_default", "1.5"),
        (47, 3, "model_version", "NULL"),
        (53, 4, "loan_application_id", "-1"),
    ],
    "application_decisions": [
        (41, 1, "decision_type", "'deferred'"),
        (43, 2, "approved_amount", "0"),
        (47, 3, "approved_term_months", "0"),
        (53, 4, "loan_application_id", "-1"),
        (59, 6, "approved_interest_rate", "-1"),
        (67, 7, "approved_amount", "NULL"),
    ],
    "loan_contracts": [
        (41, 1, "principal_amount", "0"),
        (43, 2, "interest_rate", "-1"),
        (47, 3, "term_months", "0"),
        (53, 4, "loan_application_id", "-1"),
        (59, 6, "maturity_date", "DATE '1980-01-01'"),
        (67, 7, "closed_date", "DATE '1980-01-01'"),
        (71, 8, "contract_status", "'paused'"),
        (73, 9, "contract_status", "'closed'"),
        (79, 10, "contract_number", "'SYN-DUPLICATE'"),
    ],
    "loan_collateral": [
        (41, 1, "market_value", "0"),
        (43, 2, "released_at", "DATE '1980-01-01'"),
        (47, 3, "collateral_status", "'lost'"),
        (53, 4, "loan_contract_id", "-1"),
        (59, 6, "collateral_status", "'released'"),
    ],
    "loan_disbursements": [
        (41, 1, "disbursement_amount", "0"),
        (43, 2, "transaction_reference", "NULL"),
        (47, 3, "transaction_reference", "'TX-DUPLICATE'"),
        (53, 4, "loan_contract_id", "-1"),
    ],
    "payment_schedule": [
        (41, 1, "installment_number", "0"),
        (43, 2, "principal_due", "-1"),
        (47, 3, "interest_due", "-1"),
        (53, 4, "loan_contract_id", "-1"),
        (59, 6, "fee_due", "-100000000"),
    ],
    "payments": [
        (41, 1, "principal_paid", "-1"),
        (43, 2, "interest_paid", "-1"),
        (47, 3, "fee_paid", "-100000000"),
        (53, 4, "payment_schedule_id", "-1"),
        (59, 6, "payment_status", "'bounced'"),
        (67, 7, "payment_date", "NULL"),
    ],
    "delinquency_events": [
        (41, 1, "delinquency_end_date", "DATE '1980-01-01'"),
        (43, 2, "overdue_principal", "-1"),
        (47, 3, "overdue_interest", "-1"),
        (53, 4, "payment_schedule_id", "-1"),
        (59, 6, "overdue_fee", "-1"),
        (67, 7, "max_dpd", "0"),
        (71, 8, "penalty_rate", "-1"),
        (73, 9, "delinquency_status", "'lapsed'"),
        (79, 10, "delinquency_status", "'open'"),
    ],
}

#: Rows with this remainder of their key stand in their table twice.
DUPLICATED = (61, 5)


def damaged_table(df: DataFrame, table: str) -> DataFrame:
    key = TABLES[table].key
    schema = TABLES[table].schema
    changed = {name: name for name in df.columns}
    for modulus, remainder, column, value in DEFECTS[table]:
        bad = f"CAST({value} AS {schema[column].dataType.simpleString()})"
        changed[column] = f"CASE WHEN {key} % {modulus} = {remainder} THEN {bad} ELSE {changed[column]} END"
    modulus, remainder = DUPLICATED
    copies = f"explode(sequence(1, CASE WHEN {key} % {modulus} = {remainder} THEN 2 ELSE 1 END)) AS _copy"
    return df.selectExpr("*", copies).selectExpr(*[f"{value} AS {name}" for name, value in changed.items()])


def damaged_book(book: LoanBook) -> LoanBook:
    return LoanBook(**{name: damaged_table(df, name) for name, df in book.tables().items()})


def damaged_snapshot(snapshot: DataFrame) -> DataFrame:
    """A stored mart gone wrong: contracts missing, repeated, and overdue beyond their balance."""
    key = F.col("loan_contract_id")
    copies = F.when(key % 89 == 0, 2).otherwise(1)
    excess = (F.col("outstanding_principal") + 1).cast(MONEY_TOTAL)
    return (
        snapshot.where(key % 101 != 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
        .withColumn("overdue_principal", F.when(key % 97 == 0, excess).otherwise(F.col("overdue_principal")))
        .drop("_copy")
    )
