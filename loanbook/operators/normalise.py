"""Split wide staging rows into the customer, application and contract tables.

Every staging row becomes one customer, income, verification, application,
score, decision, contract and disbursement, and for secured loans one
collateral.  All of them take the key ``key_offset + row_no``, or that of a key column:
the staging frame itself is the map from row to key, so each table is a projection of it
and nothing is joined or shuffled, and a retried task gives the same keys.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from loanbook.book import LoanBook, conform
from loanbook.functions.calendar import midnight
from loanbook.functions.measures import MONEY
from loanbook.operators.lifecycle import SECURED_LOANS, padded, surcharged_rate
from loanbook.schemas import DEFAULT_CURRENCY, OPEN_BOOK_STATUSES, RUN_KEY

# --- Fixed values: texts and codes written by the loader ---------------------
INCOME_SOURCE = "salary"
VERIFICATION_NOTE = "Synthetic verified income"
SCORE_MODEL = ("Synthetic Credit Score", "1.0")
REASON_CONDITIONS = "HIGHER_RISK_PRICING"
REASON_STANDARD = "STANDARD_APPROVAL"
VEHICLE = ("vehicle", "Synthetic vehicle collateral", "VIN-")
REAL_ESTATE = ("real_estate", "Synthetic residential property collateral", "CAD-")
FORECLOSED_BELOW_SCORE = 470
DISBURSEMENT_METHODS = {"mortgage": "seller_transfer", "auto_loan": "dealer_transfer"}
DISBURSEMENT_DEFAULT = "account_credit"
# -----------------------------------------------------------------------------


def normalise_batch(
    terms: DataFrame, loaded_at: dt.datetime | None = None, key_offset: int = 0, key_column: str = "row_no"
) -> LoanBook:
    """Tables of one load from the output of ``derive_contract_terms``."""
    return LoanBook(**{table: normalise_table(terms, table, loaded_at, key_offset, key_column) for table in _BUILDERS})


def normalise_table(
    terms: DataFrame,
    table: str,
    loaded_at: dt.datetime | None = None,
    key_offset: int = 0,
    key_column: str = "row_no",
) -> DataFrame:
    """One table of the load."""
    stamp = F.lit(loaded_at).cast("timestamp") if loaded_at is not None else F.current_timestamp()
    rows = terms.withColumns({"_key": F.col(key_column) + F.lit(key_offset).cast("bigint"), "_stamp": stamp})
    return conform(_BUILDERS[table](rows), table)


def _key(name: str) -> Column:
    return F.col("_key").alias(name)


def _reference(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col(RUN_KEY), F.lit("-"), padded(F.col("row_no"), 4))


def _rate() -> Column:
    return surcharged_rate(F.col("interest_rate"), F.col("decision_type"))


def _customers(rows: DataFrame) -> DataFrame:
    on_book = F.col("contract_status").isin(OPEN_BOOK_STATUSES)
    return rows.select(
        _key("customer_id"), "first_name", "last_name", "middle_name", "birth_date", "sex", "occupation", "city",
        "country", "address",
        F.when(on_book, "active").otherwise("inactive").alias("customer_status"),
        F.col("_stamp").alias("created_at"),
        RUN_KEY,
    )


def _income(rows: DataFrame) -> DataFrame:
    return rows.select(
        _key("customer_income_id"),
        _key("customer_id"),
        F.lit(INCOME_SOURCE).alias("income_source"),
        "monthly_income",
        F.lit(DEFAULT_CURRENCY).alias("currency"),
        "employer_name",
        F.add_months("application_date", -12).alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
        F.col("_stamp").alias("created_at"),
        RUN_KEY,
    )


def _verifications(rows: DataFrame) -> DataFrame:
    # 0.90 plus a five-thousandth per score point above 350: both terms have four decimals.
    confirmed = (F.col("score") - 350) * F.lit("0.0002").cast("decimal(5,4)") + F.lit("0.90").cast("decimal(3,2)")
    return rows.select(
        _key("income_verification_id"),
        _key("customer_income_id"),
        midnight(F.col("application_date"), 1).alias("verification_date"),
        "verification_method",
        F.lit("verified").alias("verification_status"),
        F.round(F.col("monthly_income") * confirmed, 2).cast(MONEY).alias("verified_amount"),
        F.lit(VERIFICATION_NOTE).alias("notes"),
        RUN_KEY,
    )


def _applications(rows: DataFrame) -> DataFrame:
    return rows.select(
        _key("loan_application_id"),
        _key("customer_id"),
        midnight(F.col("application_date")).alias("application_date"),
        "loan_type",
        "requested_amount",
        F.col("term_months").alias("requested_term_months"),
        F.col("interest_rate").alias("expected_interest_rate"),
        "down_payment",
        "asset_value",
        F.lit("approved").alias("application_status"),
        RUN_KEY,
    )


def _scores(rows: DataFrame) -> DataFrame:
    name, version = SCORE_MODEL
    return rows.select(
        _key("application_score_id"),
        _key("loan_application_id"),
        F.lit(name).alias("model_name"),
        F.lit(version).alias("model_version"),
        "score",
        "probability_of_default",
        midnight(F.col("application_date"), 1).alias("calculated_at"),
        RUN_KEY,
    )


def _decisions(rows: DataFrame) -> DataFrame:
    conditional = F.col("decision_type") == "approved_with_conditions"
    return rows.select(
        _key("application_decision_id"),
        _key("loan_application_id"),
        "decision_type",
        F.col("requested_amount").alias("approved_amount"),
        F.col("term_months").alias("approved_term_months"),
        _rate().alias("approved_interest_rate"),
        F.when(conditional, REASON_CONDITIONS).otherwise(REASON_STANDARD).alias("reason_code"),
        midnight(F.col("application_date"), 2).alias("decision_at"),
        RUN_KEY,
    )


def _contracts(rows: DataFrame) -> DataFrame:
    return rows.select(
        _key("loan_contract_id"),
        _key("loan_application_id"),
        _reference("SYN-").alias("contract_number"),
        "signing_date",
        F.col("requested_amount").alias("principal_amount"),
        _rate().alias("interest_rate"),
        "term_months",
        "start_date",
        "maturity_date",
        "contract_status",
        "closed_date",
        RUN_KEY,
    )


def _collateral(rows: DataFrame) -> DataFrame:
    vehicle = F.col("loan_type") == "auto_loan"
    closed = F.col("contract_status") == "closed"
    seized = (F.col("contract_status") == "defaulted") & (F.col("score") < FORECLOSED_BELOW_SCORE)

    def by_type(position: int) -> Column:
        return F.when(vehicle, VEHICLE[position]).otherwise(REAL_ESTATE[position])

    return rows.where(F.col("loan_type").isin(SECURED_LOANS)).select(
        _key("loan_collateral_id"),
        _key("loan_contract_id"),
        by_type(0).alias("collateral_type"),
        by_type(1).alias("collateral_description"),
        F.concat(by_type(2), _reference("")).alias("identification_number"),
        F.col("asset_value").alias("market_value"),
        F.col("signing_date").alias("valuation_date"),
        F.when(closed, "released").when(seized, "foreclosed").otherwise("pledged").alias("collateral_status"),
        F.col("signing_date").alias("pledged_at"),
        F.when(closed, F.col("closed_date")).alias("released_at"),
        RUN_KEY,
    )


def _disbursements(rows: DataFrame) -> DataFrame:
    method = None
    for loan_type, name in DISBURSEMENT_METHODS.items():
        test = F.col("loan_type") == loan_type
        method = F.when(test, name) if method is None else method.when(test, name)
    return rows.select(
        _key("loan_disbursement_id"),
        _key("loan_contract_id"),
        F.col("start_date").alias("disbursement_date"),
        F.col("requested_amount").alias("disbursement_amount"),
        method.otherwise(DISBURSEMENT_DEFAULT).alias("disbursement_method"),
        _reference("TX-").alias("transaction_reference"),
        RUN_KEY,
    )


_BUILDERS = {
    "customers": _customers,
    "customer_income": _income,
    "income_verifications": _verifications,
    "loan_applications": _applications,
    "application_scores": _scores,
    "application_decisions": _decisions,
    "loan_contracts": _contracts,
    "loan_collateral": _collateral,
    "loan_disbursements": _disbursements,
}

#: Tables that a batch of contract terms is split into; all take the same keys.
NORMALISED = list(_BUILDERS)
