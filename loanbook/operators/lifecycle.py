"""From contract terms to schedules, delinquency events and derived columns."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from loanbook.book import conform
from loanbook.functions.calendar import as_date, full_months
from loanbook.functions.measures import (
    MONEY, cents_to_money, divide_half_up, round_to_cents, scale_half_up, whole_units,
)
from loanbook.schemas import DEFAULT_CURRENCY, DEFAULT_PENALTY_RATE, RUN_KEY, TABLES

# --- Fixed values: pricing, scoring and key rules ----------------------------
SECURED_LOANS = ["auto_loan", "mortgage"]
SURCHARGE = "1.5000"
CONDITIONS_BELOW_SCORE = 540
PD_AT_LOWEST_SCORE = "0.450"
PD_PER_POINT = "0.0008"
PD_NOISE_WIDTH = "0.05"
PD_RANGE = ("0.005", "0.600")
LOWEST_SCORE = 350
DAYS_PER_YEAR = 365
# -----------------------------------------------------------------------------

#: Instalment keys are ``contract key * stride + number``; a term fits in 16 bits.
SCHEDULE_KEY_STRIDE = 100_000

_RATE_SCALE = 4
_SHARE_SCALE = 4


# Generated columns -----------------------------------------------------------


def with_total_due(schedule: DataFrame) -> DataFrame:
    return schedule.withColumn("total_due", _money_total("principal_due", "interest_due", "fee_due"))


def with_payment_amount(payments: DataFrame) -> DataFrame:
    return payments.withColumn("payment_amount", _money_total("principal_paid", "interest_paid", "fee_paid"))


def with_penalty_amount(events: DataFrame) -> DataFrame:
    """Simple interest on the overdue principal at the yearly penalty rate."""
    units = (
        whole_units(F.col("overdue_principal"), 2)
        * whole_units(F.col("penalty_rate"), _RATE_SCALE).cast("decimal(11,0)")
        * F.col("max_dpd")
    ).cast("decimal(38,0)")
    per_cent = 100 * DAYS_PER_YEAR * 10**_RATE_SCALE
    return events.withColumn("penalty_amount", round_to_cents(units, per_cent))


def _money_total(*columns: str) -> Column:
    total = F.col(columns[0])
    for name in columns[1:]:
        total = total + F.col(name)
    return total.cast(MONEY)


# Column defaults -------------------------------------------------------------


def apply_defaults(df: DataFrame, table: str, loaded_at: Column) -> DataFrame:
    """Fill the columns that have a default, adding those ``df`` does not bring."""
    zero = F.lit(0).cast(MONEY)
    key = TABLES[table].key
    defaults: dict[str, dict[str, Column]] = {
        "customers": {"customer_status": F.lit("applicant"), "created_at": loaded_at},
        "customer_income": {"currency": F.lit(DEFAULT_CURRENCY), "created_at": loaded_at},
        "income_verifications": {"verification_date": loaded_at},
        "loan_applications": {
            "application_date": loaded_at,
            "down_payment": zero,
            "application_status": F.lit("submitted"),
        },
        "application_scores": {"calculated_at": loaded_at},
        "application_decisions": {"decision_at": loaded_at},
        "loan_contracts": {
            "contract_number": F.concat(
                F.lit("AUTO-"), F.date_format(loaded_at, "yyyy"), F.lit("-"), padded(F.col(key), 6)
            ),
            "contract_status": F.lit("active"),
        },
        "loan_collateral": {"collateral_status": F.lit("pledged")},
        "payment_schedule": {"fee_due": zero},
        "payments": {
            "principal_paid": zero,
            "interest_paid": zero,
            "fee_paid": zero,
            "payment_status": F.lit("posted"),
            "created_at": loaded_at,
        },
        "delinquency_events": {
            "overdue_principal": zero,
            "overdue_interest": zero,
            "overdue_fee": zero,
            "penalty_rate": F.lit(DEFAULT_PENALTY_RATE).cast("decimal(7,4)"),
        },
    }
    filled = {
        name: F.coalesce(F.col(name), value) if name in df.columns else value
        for name, value in defaults.get(table, {}).items()
    }
    return df.withColumns(filled) if filled else df


def padded(number: Column, width: int) -> Column:
    """Number with leading zeros; longer numbers keep all their digits."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


# Payment schedule ------------------------------------------------------------


def build_payment_schedule(contracts: DataFrame) -> DataFrame:
    """Equal principal parts with interest on the balance left, one row per instalment.

    The last part takes up the rounding difference, so the parts add up to the
    principal.  Rows are generated within each contract's own partition; nothing
    is shuffled.  Amounts are whole cents in longs until the last step.
    """
    number = F.col("installment_number")
    last = number == F.col("term_months")
    balance = F.col("principal_cents") - F.col("part_cents") * (number - 1)
    interest = scale_half_up(balance, F.col("rate_units"), 100 * 12 * 10**_RATE_SCALE)
    carried = [RUN_KEY] if RUN_KEY in contracts.columns else []
    terms = (
        # sequence(1, 0) would count down, so contracts without a term are left out first.
        contracts.where(F.col("term_months") >= 1)
        .select(
            "loan_contract_id",
            "start_date",
            "term_months",
            whole_units(F.col("principal_amount"), 2).cast("bigint").alias("principal_cents"),
            whole_units(F.col("interest_rate"), _RATE_SCALE).cast("bigint").alias("rate_units"),
            *carried,
        )
        .withColumn("part_cents", divide_half_up(F.col("principal_cents"), F.col("term_months")))
    )
    rows = terms.withColumn("installment_number", F.explode(F.sequence(F.lit(1), F.col("term_months")))).select(
        (F.col("loan_contract_id") * SCHEDULE_KEY_STRIDE + number).alias("payment_schedule_id"),
        "loan_contract_id",
        "installment_number",
        F.add_months("start_date", number).alias("due_date"),
        cents_to_money(F.when(last, balance).otherwise(F.col("part_cents"))).alias("principal_due"),
        cents_to_money(interest).alias("interest_due"),
        F.lit(0).cast(MONEY).alias("fee_due"),
        *carried,
    )
    return conform(with_total_due(rows), "payment_schedule")


# Delinquency events ----------------------------------------------------------


def derive_delinquency_events(schedule: DataFrame, payments: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """One event per instalment paid late, or due before ``as_of`` and not paid at all.

    Any payment ends the event, whatever its status or amount; the amounts
    overdue are those due.
    """
    today = as_date(as_of)
    last_paid = payments.groupBy("payment_schedule_id").agg(F.max("payment_date").alias("paid_on"))
    due = F.col("due_date")
    until = F.coalesce("paid_on", today)
    carried = [RUN_KEY] if RUN_KEY in schedule.columns else []
    events = (
        schedule.where(due < today)
        .join(last_paid, "payment_schedule_id", "left")
        .where(until > due)
        .select(
            # At most one event per instalment, so the instalment's key serves for both.
            F.col("payment_schedule_id").alias("delinquency_event_id"),
            "payment_schedule_id",
            F.date_add(due, 1).alias("delinquency_start_date"),
            F.col("paid_on").alias("delinquency_end_date"),
            F.col("principal_due").alias("overdue_principal"),
            F.col("interest_due").alias("overdue_interest"),
            F.col("fee_due").alias("overdue_fee"),
            F.date_diff(until, due).alias("max_dpd"),
            F.lit(DEFAULT_PENALTY_RATE).cast("decimal(7,4)").alias("penalty_rate"),
            F.when(F.col("paid_on").isNull(), "open").otherwise("closed").alias("delinquency_status"),
            *carried,
        )
    )
    return conform(with_penalty_amount(events), "delinquency_events")


# Contract terms --------------------------------------------------------------


def derive_contract_terms(staging: DataFrame) -> DataFrame:
    """Add to staged contract rows everything that follows from their inputs.

    Amounts are computed as whole cents in longs.  Decimal arithmetic would also
    make the generated code too long for the JVM to compile.
    """
    secured = F.col("loan_type").isin(SECURED_LOANS)
    # The loan finances what the down payment leaves of the asset; shares are in ten-thousandths.
    whole = 10**_SHARE_SCALE
    inputs = staging.withColumns(
        {
            "_cents": whole_units(F.col("requested_amount"), 2).cast("bigint"),
            "_share": whole_units(F.col("down_payment_share"), _SHARE_SCALE).cast("bigint"),
            "_secured": secured,
        }
    )
    cents, share = F.col("_cents"), F.col("_share")
    with_values = inputs.withColumns(
        {
            "_down_payment": F.when(F.col("_secured"), scale_half_up(cents, share, whole - share)).otherwise(0),
            "_asset_value": F.when(F.col("_secured"), scale_half_up(cents, whole, whole - share)),
            "probability_of_default": default_probability(F.col("score"), _noise(staging)),
            "months_on_book": full_months(F.col("start_date"), F.col("as_of_date")),
            "maturity_date": F.add_months("start_date", F.col("term_months")),
            "decision_type": F.when(
                (F.col("score") < CONDITIONS_BELOW_SCORE) | F.col("condition_flag"), "approved_with_conditions"
            ).otherwise("approved"),
        }
    )
    matured = F.col("maturity_date") <= F.col("as_of_date")
    status = (
        F.when(F.col("is_defaulted"), "defaulted")
        .when(F.col("is_restructured"), "restructured")
        .when(matured & F.col("is_clean"), "closed")
        .otherwise("active")
    )
    closing_day = F.least("as_of_date", F.date_add("maturity_date", F.col("close_lag_days")))
    derived = with_values.withColumns(
        {
            "down_payment": cents_to_money(F.col("_down_payment")),
            "asset_value": cents_to_money(F.col("_asset_value")),
            "due_installments": F.least(F.col("term_months"), F.greatest(F.lit(0), F.col("months_on_book"))),
            "contract_status": status,
            "closed_date": F.when(status == "closed", closing_day),
        }
    )
    return derived.drop("_cents", "_share", "_secured", "_down_payment", "_asset_value")


def default_probability(score: Column, noise: Column) -> Column:
    """Default probability falling linearly with the score; ``noise`` is a draw in [0, 1)."""
    spread = F.floor((noise - 0.5) * _millionths(PD_NOISE_WIDTH) + 0.5)
    trend = _millionths(PD_AT_LOWEST_SCORE) - (score - LOWEST_SCORE) * _millionths(PD_PER_POINT)
    low, high = (F.lit(_millionths(limit)).cast("bigint") for limit in PD_RANGE)
    clamped = F.greatest(low, F.least(high, trend + spread))
    return (clamped.cast("decimal(8,0)") * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(8,6)")


def _millionths(number: str) -> int:
    return int(Decimal(number) * 10**6)


def _noise(staging: DataFrame) -> Column:
    if "pd_noise" in staging.columns:
        return F.coalesce(F.col("pd_noise"), F.lit(0.5))
    return F.lit(0.5)


def surcharged_rate(rate: Column, decision: Column) -> Column:
    """Rate of a contract approved with conditions carries the surcharge."""
    extra = F.lit(SURCHARGE).cast("decimal(7,4)")
    return F.when(decision == "approved_with_conditions", rate + extra).otherwise(rate).cast("decimal(7,4)")
