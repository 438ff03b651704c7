"""Integrity audits of the damaged book, in SQL."""

from loanbook.schemas import TABLES, TEXT_LIMITS
from loanbook.sources.defects import DEFECTS, DUPLICATED

_SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE", "timestamp": "TIMESTAMP"}


def damaged(table: str) -> str:
    """The table of the clean book with the listed defects."""
    key, schema = TABLES[table].key, TABLES[table].schema
    columns = []
    for column in schema.fieldNames():
        expression = column
        for modulus, remainder, name, value in DEFECTS[table]:
            if name == column:
                kind = schema[column].dataType.simpleString()
                cast = f"CAST({value} AS {_SQL_TYPES.get(kind, kind)})"
                expression = f"CASE WHEN {key} % {modulus} = {remainder} THEN {cast} ELSE {expression} END"
        columns.append(f"{expression} AS {column}")
    modulus, remainder = DUPLICATED
    copies = f"range(0, CASE WHEN {key} % {modulus} = {remainder} THEN 2 ELSE 1 END) copies(i)"
    return f"SELECT {', '.join(columns)} FROM {table}, {copies}"


DAMAGED = {f"bad_{name}": damaged(name) for name in TABLES}

# What breaks each rule, stated as the condition of a bad row.
BROKEN: dict[str, dict[str, str]] = {
    "customers": {
        "chk_customers_status": "customer_status NOT IN ('applicant', 'active', 'inactive', 'blocked')",
        "chk_customers_sex": "sex NOT IN ('male', 'female', 'other', 'not_specified')",
    },
    "customer_income": {
        "chk_customer_income_amount": "monthly_income <= 0",
        "chk_customer_income_currency": "NOT regexp_full_match(currency, '[A-Z][A-Z][A-Z]')",
        "chk_customer_income_period": "valid_to < valid_from",
    },
    "income_verifications": {
        "chk_income_verification_status": "verification_status NOT IN ('pending', 'verified', 'rejected')",
        "chk_income_verification_amount": "verified_amount < 0",
    },
    "loan_applications": {
        "chk_loan_application_amount": "requested_amount <= 0",
        "chk_loan_application_term": "requested_term_months <= 0",
        "chk_loan_application_rate": "expected_interest_rate < 0",
        "chk_loan_application_down_payment": "down_payment < 0",
        "chk_loan_application_asset_value": "asset_value <= 0",
        "chk_loan_application_status":
            "application_status NOT IN ('submitted', 'under_review', 'approved', 'rejected', 'cancelled')",
    },
    "application_scores": {
        "chk_application_score_value": "score < 0 OR score > 1000",
        "chk_application_score_pd": "probability_of_default < 0 OR probability_of_default > 1",
    },
    "application_decisions": {
        "chk_application_decision_type":
            "decision_type NOT IN ('approved', 'approved_with_conditions', 'rejected', 'cancelled')",
        "chk_application_decision_amount": "approved_amount <= 0",
        "chk_application_decision_term": "approved_term_months <= 0",
        "chk_application_decision_rate": "approved_interest_rate < 0",
        "chk_approved_decision_fields":
            "starts_with(decision_type, 'approved') AND (approved_amount IS NULL OR approved_term_months IS NULL"
            " OR approved_interest_rate IS NULL)",
    },
    "loan_contracts": {
        "chk_loan_contract_principal": "principal_amount <= 0",
        "chk_loan_contract_rate": "interest_rate < 0",
        "chk_loan_contract_term": "term_months <= 0",
        "chk_loan_contract_dates": "maturity_date < start_date",
        "chk_loan_contract_closed_date": "closed_date < start_date",
        "chk_loan_contract_status":
            "contract_status NOT IN ('active', 'closed', 'defaulted', 'restructured', 'cancelled')",
        "chk_closed_contract_date": "contract_status = 'closed' AND closed_date IS NULL",
    },
    "loan_collateral": {
        "chk_loan_collateral_value": "market_value <= 0",
        "chk_loan_collateral_dates": "released_at < pledged_at",
        "chk_loan_collateral_status": "collateral_status NOT IN ('pledged', 'released', 'foreclosed')",
        "chk_released_collateral_date": "collateral_status = 'released' AND released_at IS NULL",
    },
    "loan_disbursements": {"chk_loan_disbursement_amount": "disbursement_amount <= 0"},
    "payment_schedule": {
        "chk_payment_schedule_installment": "installment_number <= 0",
        "chk_payment_schedule_principal": "principal_due < 0",
        "chk_payment_schedule_interest": "interest_due < 0",
        "chk_payment_schedule_fee": "fee_due < 0",
        "chk_payment_schedule_total": "principal_due + interest_due + fee_due <= 0",
    },
    "payments": {
        "chk_payment_principal": "principal_paid < 0",
        "chk_payment_interest": "interest_paid < 0",
        "chk_payment_fee": "fee_paid < 0",
        "chk_payment_amount": "principal_paid + interest_paid + fee_paid <= 0",
        "chk_payment_status": "payment_status NOT IN ('pending', 'posted', 'reversed')",
    },
    "delinquency_events": {
        "chk_delinquency_dates": "delinquency_end_date < delinquency_start_date",
        "chk_delinquency_principal": "overdue_principal < 0",
        "chk_delinquency_interest": "overdue_interest < 0",
        "chk_delinquency_fee": "overdue_fee < 0",
        "chk_delinquency_dpd": "max_dpd <= 0",
        "chk_delinquency_penalty_rate": "penalty_rate < 0",
        "chk_delinquency_status": "delinquency_status NOT IN ('open', 'closed')",
        "chk_delinquency_status_dates":
            "delinquency_status NOT IN ('open', 'closed') OR (delinquency_status = 'open') = (delinquency_end_date IS NOT NULL)",
    },
}


def _count(table: str, label: str, name: str, condition: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{name}' AS {label}, count(*) FILTER (WHERE {condition}) AS violations"
        f" FROM bad_{table}"
    )


def checks() -> str:
    return "\nUNION ALL\n".join(
        _count(table, "constraint_name", name, condition)
        for table, rules in BROKEN.items()
        for name, condition in rules.items()
    )


def not_null() -> str:
    return "\nUNION ALL\n".join(
        _count(name, "column_name", column, f"{column} IS NULL") for name, t in TABLES.items() for column in t.required
    )


def text_lengths() -> str:
    return "\nUNION ALL\n".join(
        _count(name, "column_name", column, f"length({column}) > {limit}")
        for name, limits in TEXT_LIMITS.items()
        for column, limit in limits.items()
    )


def foreign_keys() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, '{ref.name}' AS constraint_name, count(*) AS violations FROM bad_{name} c"
        f" WHERE {ref.column} IS NOT NULL AND NOT EXISTS"
        f" (SELECT 1 FROM bad_{ref.parent} p WHERE p.{TABLES[ref.parent].key} = c.{ref.column})"
        for name, t in TABLES.items()
        for ref in t.references
    )


def uniqueness() -> str:
    parts = []
    for name, t in TABLES.items():
        for unique in t.uniques:
            keys = ", ".join(unique.columns)
            present = " AND ".join(f"{c} IS NOT NULL" for c in unique.columns)
            parts.append(
                f"SELECT '{name}' AS table_name, '{unique.name}' AS constraint_name, count(*) AS repeated_keys,"
                f" CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS violations"
                f" FROM (SELECT count(*) AS n FROM bad_{name} WHERE {present} GROUP BY {keys} HAVING count(*) >= 2) d"
            )
    return "\nUNION ALL\n".join(parts)


# Rules at load time: a row breaks a rule by itself, by a key that a row before it holds,
# or by a parent that did not pass.  Tables come parents first.


def _gate_parts() -> dict[str, str]:
    parts = {}
    for name, t in TABLES.items():
        broken = list(BROKEN[name].items())
        broken += [(f"not_null:{c}", f"{c} IS NULL") for c in t.required]
        broken += [(f"width:{c}", f"length({c}) > {limit}") for c, limit in TEXT_LIMITS.get(name, {}).items()]
        for u in t.uniques:
            present = " AND ".join(f"{c} IS NOT NULL" for c in u.columns)
            nth = f"row_number() OVER (PARTITION BY {', '.join(u.columns)} ORDER BY {t.key}, place)"
            broken.append((u.name, f"{present} AND {nth} > 1"))
        for ref in t.references:
            parent = f"SELECT {TABLES[ref.parent].key} FROM passed_{ref.parent}"
            broken.append((ref.name, f"{ref.column} IS NOT NULL AND {ref.column} NOT IN ({parent})"))
        cases = ", ".join(f"CASE WHEN {test} THEN '{rule}' END" for rule, test in broken)
        # Equal rows are told apart, so that all unique keys agree on the first of them.
        parts[f"placed_{name}"] = f"SELECT *, row_number() OVER () AS place FROM bad_{name}"
        parts[f"judged_{name}"] = f"SELECT *, list_filter([{cases}], lambda r: r IS NOT NULL) AS broken FROM placed_{name}"
        parts[f"passed_{name}"] = f"SELECT * FROM judged_{name} WHERE len(broken) = 0"
    return parts


GATE = _gate_parts()


def gate() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, rule, count(*) AS rows FROM (SELECT unnest(broken) AS rule FROM judged_{name}) b"
        f" GROUP BY rule UNION ALL SELECT '{name}', 'accepted', count(*) FROM passed_{name}"
        for name in TABLES
    )
