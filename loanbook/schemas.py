"""The twelve lending tables: columns, value domains and integrity rules.

Parquet enforces none of these, so they are kept as data and checked by
``loanbook.operators.constraints``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F, types as T

# --- Fixed values: status and type codes used by the lending tables ----------
CUSTOMER_STATUSES = ["applicant", "active", "inactive", "blocked"]
SEXES = ["male", "female", "other", "not_specified"]
VERIFICATION_STATUSES = ["pending", "verified", "rejected"]
APPLICATION_STATUSES = ["submitted", "under_review", "approved", "rejected", "cancelled"]
DECISION_TYPES = ["approved", "approved_with_conditions", "rejected", "cancelled"]
APPROVALS = ["approved", "approved_with_conditions"]
CONTRACT_STATUSES = ["active", "closed", "defaulted", "restructured", "cancelled"]
OPEN_BOOK_STATUSES = ["active", "defaulted", "restructured"]
COLLATERAL_STATUSES = ["pledged", "released", "foreclosed"]
PAYMENT_STATUSES = ["pending", "posted", "reversed"]
EVENT_STATUSES = ["open", "closed"]
DEFAULT_CURRENCY = "RUB"
DEFAULT_PENALTY_RATE = "20.0000"
# -----------------------------------------------------------------------------

#: Batch a row was loaded with; an extra column of every stored table.
RUN_KEY = "run_key"

_TYPES = {
    "id": T.LongType(),
    "str": T.StringType(),
    "int": T.IntegerType(),
    "date": T.DateType(),
    "ts": T.TimestampType(),
    "money": T.DecimalType(15, 2),
    "rate": T.DecimalType(7, 4),
    "pd": T.DecimalType(8, 6),
}


def _struct(columns: str) -> T.StructType:
    """Schema from ``name type`` pairs; a ``!`` after the type means NOT NULL."""
    fields = []
    for column in columns.split(","):
        name, kind = column.split()
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


@dataclass(frozen=True)
class Check:
    """A row rule.  Like a SQL CHECK it is broken only where it is false, not NULL."""

    name: str
    rule: Callable[[], Column]


@dataclass(frozen=True)
class Reference:
    """A foreign key to the primary key of another table."""

    name: str
    column: str
    parent: str


@dataclass(frozen=True)
class Unique:
    """Columns that identify a row; rows with a NULL among them never collide."""

    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    checks: list[Check] = field(default_factory=list)
    references: list[Reference] = field(default_factory=list)
    uniques: list[Unique] = field(default_factory=list)

    @property
    def key(self) -> str:
        return self.schema.fieldNames()[0]

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


# Rule constructors.  They are evaluated lazily: a Column needs a running session.
def _positive(*columns: str):
    return lambda: _total(columns) > 0


def _not_negative(column: str):
    return lambda: F.col(column) >= 0


def _within(column: str, low: int, high: int):
    return lambda: F.col(column).between(low, high)


def _one_of(column: str, values: list[str]):
    return lambda: F.col(column).isin(values)


def _not_before(column: str, start: str):
    return lambda: F.col(column) >= F.col(start)


def _needs(column: str, states: list[str], *needed: str):
    """When ``column`` is in ``states`` every ``needed`` column has a value."""

    def rule() -> Column:
        present = F.lit(True)
        for name in needed:
            present = present & F.col(name).isNotNull()
        return ~F.col(column).isin(states) | present

    return rule


def _total(columns: tuple[str, ...]) -> Column:
    total = F.col(columns[0])
    for name in columns[1:]:
        total = total + F.col(name)
    return total


def _open_until_ended() -> Column:
    """An event has an end date exactly when it is closed."""
    ended = F.col("delinquency_end_date").isNotNull()
    return F.when(ended, F.col("delinquency_status") == "closed").otherwise(F.col("delinquency_status") == "open")


TABLES: dict[str, Table] = {
    t.name: t
    for t in [
        Table(
            "customers",
            _struct(
                "customer_id id!,first_name str!,last_name str!,middle_name str,birth_date date!,sex str!,"
                "occupation str,city str!,country str!,address str!,customer_status str!,created_at ts!"
            ),
            [
                Check("chk_customers_status", _one_of("customer_status", CUSTOMER_STATUSES)),
                Check("chk_customers_sex", _one_of("sex", SEXES)),
            ],
            [],
            [Unique("customers_pkey", ("customer_id",))],
        ),
        Table(
            "customer_income",
            _struct(
                "customer_income_id id!,customer_id id!,income_source str!,monthly_income money!,currency str!,"
                "employer_name str,valid_from date!,valid_to date,created_at ts!"
            ),
            [
                Check("chk_customer_income_amount", _positive("monthly_income")),
                # Anchored with \A and \z: "$" would also match before a final newline.
                Check("chk_customer_income_currency", lambda: F.col("currency").rlike(r"\A[A-Z]{3}\z")),
                Check("chk_customer_income_period", _not_before("valid_to", "valid_from")),
            ],
            [Reference("fk_customer_income_customer", "customer_id", "customers")],
            [Unique("customer_income_pkey", ("customer_income_id",))],
        ),
        Table(
            "income_verifications",
            _struct(
                "income_verification_id id!,customer_income_id id!,verification_date ts!,verification_method str!,"
                "verification_status str!,verified_amount money,notes str"
            ),
            [
                Check("chk_income_verification_status", _one_of("verification_status", VERIFICATION_STATUSES)),
                Check("chk_income_verification_amount", _not_negative("verified_amount")),
            ],
            [Reference("fk_income_verification_income", "customer_income_id", "customer_income")],
            [Unique("income_verifications_pkey", ("income_verification_id",))],
        ),
        Table(
            "loan_applications",
            _struct(
                "loan_application_id id!,customer_id id!,application_date ts!,loan_type str!,requested_amount money!,"
                "requested_term_months int!,expected_interest_rate rate,down_payment money!,asset_value money,"
                "application_status str!"
            ),
            [
                Check("chk_loan_application_amount", _positive("requested_amount")),
                Check("chk_loan_application_term", _positive("requested_term_months")),
                Check("chk_loan_application_rate", _not_negative("expected_interest_rate")),
                Check("chk_loan_application_down_payment", _not_negative("down_payment")),
                Check("chk_loan_application_asset_value", _positive("asset_value")),
                Check("chk_loan_application_status", _one_of("application_status", APPLICATION_STATUSES)),
            ],
            [Reference("fk_loan_application_customer", "customer_id", "customers")],
            [Unique("loan_applications_pkey", ("loan_application_id",))],
        ),
        Table(
            "application_scores",
            _struct(
                "application_score_id id!,loan_application_id id!,model_name str!,model_version str!,score int!,"
                "probability_of_default pd,calculated_at ts!"
            ),
            [
                Check("chk_application_score_value", _within("score", 0, 1000)),
                Check("chk_application_score_pd", _within("probability_of_default", 0, 1)),
            ],
            [Reference("fk_application_score_application", "loan_application_id", "loan_applications")],
            [Unique("application_scores_pkey", ("application_score_id",))],
        ),
        Table(
            "application_decisions",
            _struct(
                "application_decision_id id!,loan_application_id id!,decision_type str!,approved_amount money,"
                "approved_term_months int,approved_interest_rate rate,reason_code str,decision_at ts!"
            ),
            [
                Check("chk_application_decision_type", _one_of("decision_type", DECISION_TYPES)),
                Check("chk_application_decision_amount", _positive("approved_amount")),
                Check("chk_application_decision_term", _positive("approved_term_months")),
                Check("chk_application_decision_rate", _not_negative("approved_interest_rate")),
                Check(
                    "chk_approved_decision_fields",
                    _needs(
                        "decision_type",
                        APPROVALS,
                        "approved_amount",
                        "approved_term_months",
                        "approved_interest_rate",
                    ),
                ),
            ],
            [Reference("fk_application_decision_application", "loan_application_id", "loan_applications")],
            [Unique("application_decisions_pkey", ("application_decision_id",))],
        ),
        Table(
            "loan_contracts",
            _struct(
                "loan_contract_id id!,loan_application_id id!,contract_number str!,signing_date date!,"
                "principal_amount money!,interest_rate rate!,term_months int!,start_date date!,maturity_date date!,"
                "contract_status str!,closed_date date"
            ),
            [
                Check("chk_loan_contract_principal", _positive("principal_amount")),
                Check("chk_loan_contract_rate", _not_negative("interest_rate")),
                Check("chk_loan_contract_term", _positive("term_months")),
                Check("chk_loan_contract_dates", _not_before("maturity_date", "start_date")),
                Check("chk_loan_contract_closed_date", _not_before("closed_date", "start_date")),
                Check("chk_loan_contract_status", _one_of("contract_status", CONTRACT_STATUSES)),
                Check("chk_closed_contract_date", _needs("contract_status", ["closed"], "closed_date")),
            ],
            [Reference("fk_loan_contract_application", "loan_application_id", "loan_applications")],
            [
                Unique("loan_contracts_pkey", ("loan_contract_id",)),
                Unique("loan_contracts_loan_application_id_key", ("loan_application_id",)),
                Unique("loan_contracts_contract_number_key", ("contract_number",)),
            ],
        ),
        Table(
            "loan_collateral",
            _struct(
                "loan_collateral_id id!,loan_contract_id id!,collateral_type str!,collateral_description str!,"
                "identification_number str,market_value money!,valuation_date date!,collateral_status str!,"
                "pledged_at date!,released_at date"
            ),
            [
                Check("chk_loan_collateral_value", _positive("market_value")),
                Check("chk_loan_collateral_dates", _not_before("released_at", "pledged_at")),
                Check("chk_loan_collateral_status", _one_of("collateral_status", COLLATERAL_STATUSES)),
                Check("chk_released_collateral_date", _needs("collateral_status", ["released"], "released_at")),
            ],
            [Reference("fk_loan_collateral_contract", "loan_contract_id", "loan_contracts")],
            [Unique("loan_collateral_pkey", ("loan_collateral_id",))],
        ),
        Table(
            "loan_disbursements",
            _struct(
                "loan_disbursement_id id!,loan_contract_id id!,disbursement_date date!,disbursement_amount money!,"
                "disbursement_method str,transaction_reference str"
            ),
            [Check("chk_loan_disbursement_amount", _positive("disbursement_amount"))],
            [Reference("fk_loan_disbursement_contract", "loan_contract_id", "loan_contracts")],
            [
                Unique("loan_disbursements_pkey", ("loan_disbursement_id",)),
                Unique("loan_disbursements_transaction_reference_key", ("transaction_reference",)),
            ],
        ),
        Table(
            "payment_schedule",
            _struct(
                "payment_schedule_id id!,loan_contract_id id!,installment_number int!,due_date date!,"
                "principal_due money!,interest_due money!,fee_due money!,total_due money"
            ),
            [
                Check("chk_payment_schedule_installment", _positive("installment_number")),
                Check("chk_payment_schedule_principal", _not_negative("principal_due")),
                Check("chk_payment_schedule_interest", _not_negative("interest_due")),
                Check("chk_payment_schedule_fee", _not_negative("fee_due")),
                Check("chk_payment_schedule_total", _positive("principal_due", "interest_due", "fee_due")),
            ],
            [Reference("fk_payment_schedule_contract", "loan_contract_id", "loan_contracts")],
            [
                Unique("payment_schedule_pkey", ("payment_schedule_id",)),
                Unique("uq_payment_schedule_installment", ("loan_contract_id", "installment_number")),
            ],
        ),
        Table(
            "payments",
            _struct(
                "payment_id id!,payment_schedule_id id!,payment_date date!,principal_paid money!,interest_paid money!,"
                "fee_paid money!,payment_amount money,payment_method str,payment_status str!,created_at ts!"
            ),
            [
                Check("chk_payment_principal", _not_negative("principal_paid")),
                Check("chk_payment_interest", _not_negative("interest_paid")),
                Check("chk_payment_fee", _not_negative("fee_paid")),
                Check("chk_payment_amount", _positive("principal_paid", "interest_paid", "fee_paid")),
                Check("chk_payment_status", _one_of("payment_status", PAYMENT_STATUSES)),
            ],
            [Reference("fk_payment_schedule", "payment_schedule_id", "payment_schedule")],
            [Unique("payments_pkey", ("payment_id",))],
        ),
        Table(
            "delinquency_events",
            _struct(
                "delinquency_event_id id!,payment_schedule_id id!,delinquency_start_date date!,"
                "delinquency_end_date date,overdue_principal money!,overdue_interest money!,overdue_fee money!,"
                "max_dpd int!,penalty_rate rate!,penalty_amount money,delinquency_status str!"
            ),
            [
                Check("chk_delinquency_dates", _not_before("delinquency_end_date", "delinquency_start_date")),
                Check("chk_delinquency_principal", _not_negative("overdue_principal")),
                Check("chk_delinquency_interest", _not_negative("overdue_interest")),
                Check("chk_delinquency_fee", _not_negative("overdue_fee")),
                Check("chk_delinquency_dpd", _positive("max_dpd")),
                Check("chk_delinquency_penalty_rate", _not_negative("penalty_rate")),
                Check("chk_delinquency_status", _one_of("delinquency_status", EVENT_STATUSES)),
                Check("chk_delinquency_status_dates", _open_until_ended),
            ],
            [Reference("fk_delinquency_payment_schedule", "payment_schedule_id", "payment_schedule")],
            [
                Unique("delinquency_events_pkey", ("delinquency_event_id",)),
                Unique("delinquency_events_payment_schedule_id_key", ("payment_schedule_id",)),
            ],
        ),
    ]
}

#: Widest text each column may hold; unlisted text columns are unlimited.
TEXT_LIMITS: dict[str, dict[str, int]] = {
    "customers": {
        "first_name": 100, "last_name": 100, "middle_name": 100, "sex": 20, "city": 100, "country": 100,
        "customer_status": 20,
    },
    "customer_income": {"income_source": 50, "currency": 3},
    "income_verifications": {"verification_method": 50, "verification_status": 20},
    "loan_applications": {"loan_type": 30, "application_status": 30},
    "application_scores": {"model_name": 100, "model_version": 50},
    "application_decisions": {"decision_type": 30, "reason_code": 100},
    "loan_contracts": {"contract_number": 50, "contract_status": 30},
    "loan_collateral": {"collateral_type": 50, "identification_number": 100, "collateral_status": 20},
    "loan_disbursements": {"disbursement_method": 50, "transaction_reference": 100},
    "payments": {"payment_method": 50, "payment_status": 20},
    "delinquency_events": {"delinquency_status": 20},
}
