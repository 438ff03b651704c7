"""SQL of every registered query."""

from oracle import audit
from oracle.batch import BATCH
from oracle.book import AS_OF, BOOK, SNAPSHOT_OUT
from oracle.compose import amount, average, compose, money, padded, share
from loanbook.schemas import TABLES

PARTS = {**BOOK, **BATCH, **audit.DAMAGED, **audit.GATE}


def _if(condition: str, value: str = "1") -> str:
    return f"coalesce(sum(CASE WHEN {condition} THEN {value} END), 0)"


def _n(condition: str) -> str:
    return f"CAST({_if(condition)} AS BIGINT)"


def _spine(*labels: str) -> str:
    rows = ", ".join(f"('{label}', {i})" for i, label in enumerate(labels, 1))
    return f"(VALUES {rows}) AS spine(label, pos)"


def _segment_report(key: str, labels: list[str], segment: str, with_share: bool) -> str:
    total = "coalesce(sum(outstanding_cents), 0)"
    book_total = "(SELECT sum(outstanding_cents) FROM snapshot WHERE on_book)"
    share_column = f"{share(total, book_total)} AS share_of_outstanding_pct," if with_share else ""
    return f"""
SELECT spine.label AS {key}, count(loan_contract_id) AS contract_count,
       {money("coalesce(sum(CAST(principal_amount * 100 AS HUGEINT)), 0)")} AS total_principal,
       {money(total)} AS total_outstanding, {share_column}
       {_n("current_dpd > 0")} AS delinquent_contracts,
       {share(_if("current_dpd > 0"), "count(loan_contract_id)")} AS delinquency_rate_pct,
       {_n("current_dpd > 29")} AS dpd_30_plus_contracts,
       {share(_if("current_dpd > 29"), "count(loan_contract_id)")} AS dpd_30_plus_rate_pct,
       {share(_if("current_dpd > 29", "outstanding_cents"), total)} AS par_30_pct,
       coalesce({average(total, "count(loan_contract_id)", 100)}, 0) AS average_outstanding
FROM {_spine(*labels)}
LEFT JOIN (SELECT *, {segment} AS segment FROM snapshot WHERE on_book) s ON s.segment = spine.label
GROUP BY spine.label
"""


_RAW: dict[str, str] = {}

_RAW["portfolio_snapshot"] = f"SELECT {SNAPSHOT_OUT} FROM snapshot"

_RAW["portfolio_kpis"] = f"""
SELECT {AS_OF} AS report_date, count(*) AS total_contracts,
       {money("coalesce(sum(CAST(principal_amount * 100 AS HUGEINT)), 0)")} AS total_principal,
       {money("coalesce(sum(outstanding_cents), 0)")} AS total_outstanding,
       {money("coalesce(sum(overdue_cents), 0)")} AS total_overdue,
       {_n("current_dpd > 0")} AS delinquent_contracts,
       {share(_if("current_dpd > 0"), "count(*)")} AS delinquency_rate_pct,
       {_n("current_dpd > 29")} AS dpd_30_plus_contracts,
       {share(_if("current_dpd > 29"), "count(*)")} AS dpd_30_plus_rate_pct,
       {_n("current_dpd > 89")} AS dpd_90_plus_contracts,
       {share(_if("current_dpd > 89"), "count(*)")} AS dpd_90_plus_rate_pct,
       {share(_if("current_dpd > 29", "outstanding_cents"), "sum(outstanding_cents)")} AS par_30_pct,
       {share(_if("current_dpd > 89", "outstanding_cents"), "sum(outstanding_cents)")} AS par_90_pct,
       {share("sum(overdue_cents)", "sum(outstanding_cents)")} AS overdue_share_pct
FROM snapshot WHERE on_book
"""

_RAW["dpd_bucket_summary"] = f"""
SELECT spine.label AS dpd_bucket, count(loan_contract_id) AS contract_count,
       {money("coalesce(sum(CAST(principal_amount * 100 AS HUGEINT)), 0)")} AS total_principal,
       {money("coalesce(sum(outstanding_cents), 0)")} AS outstanding_principal,
       {money("coalesce(sum(overdue_cents), 0)")} AS overdue_principal,
       {share("count(loan_contract_id)", "(SELECT count(*) FROM snapshot WHERE on_book)")} AS share_of_contracts_pct,
       {share("coalesce(sum(outstanding_cents), 0)", "(SELECT sum(outstanding_cents) FROM snapshot WHERE on_book)")}
           AS share_of_outstanding_pct
FROM {_spine("Current", "1-30", "31-60", "61-89", "90+")}
LEFT JOIN snapshot s ON s.dpd_bucket = spine.label AND s.on_book
GROUP BY spine.label
"""

_RAW["risk_by_loan_size"] = _segment_report(
    "loan_size_segment",
    ["Up to 1M", "1M-3M", "3M+"],
    "CASE WHEN principal_amount > 3000000 THEN '3M+' WHEN principal_amount > 1000000 THEN '1M-3M' ELSE 'Up to 1M' END",
    with_share=False,
)

_MOB = (
    f"((year({AS_OF}) - year(start_date)) * 12 + month({AS_OF}) - month(start_date)"
    f" - CASE WHEN day(start_date) > day({AS_OF}) THEN 1 ELSE 0 END)"
)
_RAW["risk_by_months_on_book"] = _segment_report(
    "mob_segment",
    ["0-6 months", "7-12 months", "13-24 months", "25+ months"],
    f"CASE WHEN {_MOB} > 24 THEN '25+ months' WHEN {_MOB} > 12 THEN '13-24 months'"
    f" WHEN {_MOB} > 6 THEN '7-12 months' ELSE '0-6 months' END",
    with_share=True,
)

_RAW["risk_by_score_band"] = f"""
SELECT spine.label AS score_band, count(loan_contract_id) AS total_contracts,
       {average("sum(score)", "count(score)")} AS avg_score,
       {average("sum(CAST(probability_of_default * 1000000 AS HUGEINT)) * 100", "count(probability_of_default)", 1000000)}
           AS avg_pd_pct,
       {_n("max_dpd > 29")} AS ever_dpd_30_plus_contracts,
       {_n("max_dpd > 89")} AS ever_dpd_90_plus_contracts,
       {_n("contract_status = 'defaulted'")} AS status_defaulted_contracts,
       {share(_if("max_dpd > 29"), "count(loan_contract_id)")} AS ever_dpd_30_plus_rate_pct,
       {share(_if("max_dpd > 89"), "count(loan_contract_id)")} AS ever_dpd_90_plus_rate_pct,
       {share(_if("contract_status = 'defaulted'"), "count(loan_contract_id)")} AS status_default_rate_pct,
       {money("coalesce(sum(outstanding_cents), 0)")} AS total_outstanding,
       {money(_if("max_dpd > 29", "outstanding_cents"))} AS ever_dpd_30_plus_outstanding,
       {share(_if("max_dpd > 29", "outstanding_cents"), "sum(outstanding_cents)")}
           AS ever_dpd_30_plus_outstanding_share_pct,
       {money(_if("max_dpd > 89", "outstanding_cents"))} AS ever_dpd_90_plus_outstanding,
       {share(_if("max_dpd > 89", "outstanding_cents"), "sum(outstanding_cents)")}
           AS ever_dpd_90_plus_outstanding_share_pct
FROM (VALUES (350, 449), (450, 549), (550, 649), (650, 749), (750, 850)) AS band(low, high),
     LATERAL (SELECT low || '-' || high AS label) spine
LEFT JOIN (SELECT s.*, a.score, a.probability_of_default
           FROM snapshot s JOIN loan_contracts c USING (loan_contract_id)
           JOIN application_scores a ON a.loan_application_id = c.loan_application_id) x
       ON x.score >= band.low AND x.score <= band.high
GROUP BY spine.label
"""

_WATCHLIST = f"""
SELECT loan_contract_id, contract_number, contract_status, score, probability_of_default,
       {money("outstanding_cents")} AS outstanding_principal, {money("overdue_cents")} AS overdue_principal,
       CAST(current_dpd AS INTEGER) AS current_dpd, CAST(max_dpd AS INTEGER) AS max_dpd, dpd_bucket,
       CASE rank_no WHEN 1 THEN 'Critical' WHEN 2 THEN 'High' ELSE 'Medium' END AS priority,
       array_to_string(list_filter([
           CASE WHEN current_dpd > 89 THEN 'Current DPD 90+' WHEN current_dpd > 60 THEN 'Current DPD 61-89'
                WHEN current_dpd > 29 THEN 'Current DPD 30-60' END,
           CASE WHEN score <= 549 THEN 'Low score' END,
           CASE contract_status WHEN 'defaulted' THEN 'Defaulted status'
                                WHEN 'restructured' THEN 'Restructured status' END],
           lambda r: r IS NOT NULL), '; ') AS risk_reason
FROM (SELECT s.*, a.score, a.probability_of_default,
             CASE WHEN s.current_dpd > 89 OR s.contract_status = 'defaulted' THEN 1
                  WHEN s.current_dpd > 60 OR s.contract_status = 'restructured' THEN 2
                  WHEN s.current_dpd > 29 THEN 3 END AS rank_no
      FROM snapshot s
      LEFT JOIN loan_contracts c USING (loan_contract_id)
      LEFT JOIN application_scores a ON a.loan_application_id = c.loan_application_id
      WHERE NOT s.contract_status = 'closed' AND s.outstanding_cents > 0) w
WHERE rank_no IS NOT NULL
"""
_RAW["high_risk_watchlist"] = _WATCHLIST
_RAW["high_risk_watchlist_top"] = (
    _WATCHLIST + "ORDER BY rank_no, w.current_dpd DESC, outstanding_cents DESC, loan_contract_id LIMIT 100"
)

_RAW["classify_installments"] = f"""
SELECT s.payment_schedule_id, s.loan_contract_id, s.due_date, p.payment_date, s.total_due AS scheduled_amount,
       CAST(coalesce(p.payment_amount, 0) AS DECIMAL(15,2)) AS paid_amount, p.payment_status,
       s.due_date - CAST(day(s.due_date) - 1 AS INTEGER) AS payment_month,
       CASE WHEN s.due_date > {AS_OF} THEN 'not_due' WHEN p.payment_date IS NULL THEN 'unpaid'
            WHEN p.payment_date > s.due_date THEN 'late' ELSE 'on_time' END AS payment_state,
       CAST(nullif(greatest(p.payment_date - s.due_date, 0), 0) AS INTEGER) AS payment_delay_days
FROM payment_schedule s
LEFT JOIN payments p ON p.payment_schedule_id = s.payment_schedule_id AND p.payment_status = 'posted'
"""

_RAW["monthly_payment_performance"] = f"""
SELECT payment_month, count(*) AS scheduled_installments, {_n("delay IS NOT NULL")} AS paid_installments,
       {_n("delay <= 0")} AS on_time_installments, {_n("delay > 0")} AS late_installments,
       {_n("delay IS NULL")} AS unpaid_installments,
       {money("sum(due_cents)")} AS scheduled_amount, {money("sum(paid_cents)")} AS paid_amount,
       {share(_if("delay <= 0"), "count(*)")} AS on_time_payment_rate_pct,
       {share("sum(paid_cents)", "sum(due_cents)")} AS collection_rate_pct,
       {average("sum(CASE WHEN delay > 0 THEN delay END)", _if("delay > 0"))} AS average_payment_delay_days
FROM (SELECT make_date(year(s.due_date), month(s.due_date), 1) AS payment_month,
             CAST(s.total_due * 100 AS HUGEINT) AS due_cents,
             coalesce(CAST(p.payment_amount * 100 AS HUGEINT), 0) AS paid_cents,
             p.payment_date - s.due_date AS delay
      FROM payment_schedule s
      LEFT JOIN payments p ON p.payment_schedule_id = s.payment_schedule_id AND p.payment_status = 'posted'
      WHERE s.due_date <= {AS_OF}) x
GROUP BY payment_month
"""

_RAW["delinquency_resolution"] = f"""
SELECT band.label AS dpd_bucket, count(delinquency_event_id) AS total_events,
       {_n("delinquency_status = 'closed'")} AS closed_events, {_n("delinquency_status = 'open'")} AS open_events,
       {share(_if("delinquency_status = 'closed'"), "count(delinquency_event_id)")} AS resolution_rate_pct,
       {average("sum(to_end)", "count(to_end)")} AS avg_days_to_resolution,
       CAST(median(to_end) AS DOUBLE) AS median_days_to_resolution,
       {average("sum(open_for)", "count(open_for)")} AS avg_open_duration_days
FROM (VALUES ('1-7', 1, 7), ('8-30', 8, 30), ('31-60', 31, 60), ('61-90', 61, 90), ('91+', 91, 1000000))
     AS band(label, low, high)
LEFT JOIN (SELECT *,
                  CASE WHEN delinquency_status = 'closed' THEN delinquency_end_date - delinquency_start_date END AS to_end,
                  CASE WHEN delinquency_status = 'open' THEN {AS_OF} - delinquency_start_date END AS open_for
           FROM delinquency_events) e ON e.max_dpd BETWEEN band.low AND band.high
GROUP BY band.label
"""

_RAW["early_delinquency_analysis"] = f"""
SELECT timing AS delinquency_timing, count(*) AS contract_count,
       {share("count(*)", "(SELECT count(*) FROM loan_contracts)")} AS share_of_contracts_pct,
       {_n("worst > 30")} AS ever_30_plus_contracts, {share(_if("worst > 30"), "count(*)")} AS ever_30_plus_rate_pct,
       {_n("worst > 90")} AS ever_90_plus_contracts, {share(_if("worst > 90"), "count(*)")} AS ever_90_plus_rate_pct,
       {_n("contract_status = 'defaulted'")} AS defaulted_contracts,
       {share(_if("contract_status = 'defaulted'"), "count(*)")} AS default_rate_pct
FROM (SELECT c.loan_contract_id, c.contract_status, coalesce(max(e.max_dpd), 0) AS worst,
             CASE WHEN count(e.delinquency_event_id) = 0 THEN 'No delinquency'
                  WHEN min(CASE WHEN e.max_dpd IS NOT NULL THEN s.installment_number END) > 3
                  THEN 'After 3 installments' ELSE 'First 3 installments' END AS timing
      FROM loan_contracts c
      LEFT JOIN payment_schedule s USING (loan_contract_id)
      LEFT JOIN delinquency_events e USING (payment_schedule_id)
      GROUP BY c.loan_contract_id, c.contract_status) t
GROUP BY timing
"""

_RAW["dq_balance_consistency"] = f"""
SELECT loan_contract_id, contract_number, contract_status, {money("outstanding_cents")} AS outstanding_principal,
       {money("overdue_cents")} AS overdue_principal
FROM damaged_snapshot
WHERE NOT (outstanding_cents >= 0 AND overdue_cents >= 0 AND overdue_cents <= outstanding_cents)
"""

_RAW["dq_contract_status_consistency"] = f"""
SELECT loan_contract_id, contract_number, contract_status, CAST(current_dpd AS INTEGER) AS current_dpd,
       {money("outstanding_cents")} AS outstanding_principal, {money("overdue_cents")} AS overdue_principal, dpd_bucket
FROM snapshot WHERE dpd_bucket = '90+' AND contract_status = 'active' AND outstanding_cents > 0
"""

_RAW["dq_snapshot_completeness"] = """
SELECT loan_contract_id, contract_number, contract_status FROM loan_contracts c
WHERE NOT EXISTS (SELECT 1 FROM damaged_snapshot s WHERE s.loan_contract_id = c.loan_contract_id)
"""

_RAW["dq_snapshot_grain"] = """
SELECT loan_contract_id, n AS row_count
FROM (SELECT loan_contract_id, count(*) AS n FROM damaged_snapshot GROUP BY loan_contract_id) g WHERE n >= 2
"""

_RAW["batch_entity_counts"] = """
SELECT c.run_key, count(DISTINCT c.loan_contract_id) AS generated_contracts,
       count(DISTINCT s.payment_schedule_id) AS generated_schedule_rows,
       count(DISTINCT p.payment_id) AS generated_payments,
       count(DISTINCT e.delinquency_event_id) AS generated_delinquency_events
FROM loan_contracts c
LEFT JOIN payment_schedule s USING (loan_contract_id)
LEFT JOIN payments p USING (payment_schedule_id)
LEFT JOIN delinquency_events e USING (payment_schedule_id)
GROUP BY c.run_key
"""

_RAW["contract_status_counts"] = """
SELECT contract_status, count(*) AS contracts FROM loan_contracts GROUP BY contract_status
"""

_RAW["open_dpd_distribution"] = """
SELECT CASE WHEN worst IS NULL THEN 'Current' WHEN worst > 90 THEN '90+' WHEN worst > 60 THEN '61-90'
            WHEN worst > 30 THEN '31-60' ELSE '1-30' END AS dpd_bucket, count(*) AS contracts
FROM (SELECT c.loan_contract_id, max(CASE e.delinquency_status WHEN 'open' THEN e.max_dpd END) AS worst
      FROM loan_contracts c
      LEFT JOIN payment_schedule s USING (loan_contract_id)
      LEFT JOIN delinquency_events e USING (payment_schedule_id)
      GROUP BY c.loan_contract_id) t
GROUP BY 1
"""

_RAW["audit_checks"] = audit.checks()
_RAW["audit_foreign_keys"] = audit.foreign_keys()
_RAW["audit_uniqueness"] = audit.uniqueness()
_RAW["audit_not_null"] = audit.not_null()
_RAW["audit_text_lengths"] = audit.text_lengths()

_RAW["generated_columns"] = """
SELECT 'payment_schedule' AS table_name, 'total_due' AS column_name, payment_schedule_id AS row_id, total_due AS amount
FROM payment_schedule
UNION ALL SELECT 'payments', 'payment_amount', payment_id, payment_amount FROM payments
UNION ALL SELECT 'delinquency_events', 'penalty_amount', delinquency_event_id, penalty_amount FROM delinquency_events
"""

_RAW["apply_defaults"] = f"""
SELECT loan_contract_id, 'AUTO-2001-' || {padded("loan_contract_id", 6)} AS contract_number,
       CASE WHEN loan_contract_id % 2 = 0 THEN 'active' ELSE contract_status END AS contract_status
FROM loan_contracts
"""

_PART = "((2 * cents + term_months) // (2 * term_months))"
_LEFT = f"(cents - {_PART} * (k - 1))"
_RAW["build_payment_schedule"] = f"""
SELECT payment_schedule_id, loan_contract_id, installment_number, due_date, principal_due, interest_due, fee_due,
       CAST(principal_due + interest_due + fee_due AS DECIMAL(15,2)) AS total_due
FROM (SELECT loan_contract_id * 100000 + k AS payment_schedule_id, loan_contract_id,
             CAST(k AS INTEGER) AS installment_number,
             CAST(start_date + to_months(CAST(k AS INTEGER)) AS DATE) AS due_date,
             {amount(f"CASE WHEN k < term_months THEN {_PART} ELSE {_LEFT} END")} AS principal_due,
             {amount(f"(2 * {_LEFT} * rate + 12000000) // 24000000")} AS interest_due,
             CAST(0 AS DECIMAL(15,2)) AS fee_due
      FROM (SELECT *, CAST(principal_amount * 100 AS HUGEINT) AS cents, CAST(interest_rate * 10000 AS HUGEINT) AS rate,
                   unnest(range(1, CAST(term_months + 1 AS BIGINT))) AS k FROM loan_contracts) x) y
"""

_RAW["derive_delinquency_events"] = """
SELECT delinquency_event_id, payment_schedule_id, delinquency_start_date, delinquency_end_date, overdue_principal,
       overdue_interest, overdue_fee, max_dpd, penalty_rate, penalty_amount, delinquency_status
FROM delinquency_events
"""

_RAW["derive_contract_terms"] = """
SELECT run_key, row_no, down_payment, asset_value, probability_of_default, months_on_book, due_installments,
       maturity_date, contract_status, closed_date, decision_type
FROM terms
"""

_NORMALISED = {
    "customers": "customers",
    "customer_income": "customer_income",
    "income_verifications": "income_verifications",
    "loan_applications": "loan_applications",
    "application_scores": "batch_scores",
    "application_decisions": "application_decisions",
    "loan_contracts": "batch_contracts",
    "loan_collateral": "loan_collateral",
    "loan_disbursements": "loan_disbursements",
}
_RAW["normalise_batch"] = "\nUNION ALL\n".join(
    f"SELECT '{table}' AS table_name, count(*) AS table_rows, min({TABLES[table].key}) AS first_key,"
    f" max({TABLES[table].key}) AS last_key FROM {part}"
    for table, part in _NORMALISED.items()
)
for _table, _part in _NORMALISED.items():
    _RAW[f"normalise_{_table}"] = f"SELECT * EXCLUDE (run_key) FROM {_part}" if _part == "batch_contracts" else f"SELECT * FROM {_part}"

_PER_CONTRACT = [
    "customers", "customer_income", "income_verifications", "loan_applications", "application_decisions", "loan_disbursements",
]
_WITH_RUN = ["loan_contracts", "application_scores", "payment_schedule", "delinquency_events"]
_RAW["append_batch"] = f"""
SELECT table_name, run_key, count(*) AS stored_rows,
       CAST(sum(sum(CASE WHEN run_key = 'RUN1' AND early THEN 1 ELSE 0 END)) OVER (PARTITION BY table_name) AS BIGINT)
           AS refused_rows
FROM ({" UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, run_key, TRUE AS early FROM terms" for t in _PER_CONTRACT]
    + ["SELECT 'loan_collateral', run_key, TRUE FROM terms WHERE loan_type <> 'consumer_loan'"]
    + [f"SELECT '{t}', run_key, TRUE FROM {t}" for t in _WITH_RUN]
    + ["SELECT 'payments', run_key, payment_id % 10 = 2 FROM payments"]
)}) x
GROUP BY table_name, run_key
"""

_RAW["load_gate"] = audit.gate()
_RAW["refreshed_mart"] = _RAW["portfolio_snapshot"]
_RAW["roll_events"] = _RAW["derive_delinquency_events"]

_RAW["median_resolution_sketch"] = """
SELECT band.label AS dpd_bucket, count(delinquency_event_id) AS closed_events,
       CASE WHEN count(delinquency_event_id) > 0 THEN TRUE END AS within_error
FROM (VALUES ('1-7', 1, 7), ('8-30', 8, 30), ('31-60', 31, 60), ('61-90', 61, 90), ('91+', 91, 1000000))
     AS band(label, low, high)
LEFT JOIN (SELECT * FROM delinquency_events WHERE delinquency_status = 'closed') e
       ON e.max_dpd BETWEEN band.low AND band.high
GROUP BY band.label
"""

_SIZE = "CASE WHEN principal_amount <= 1000000 THEN 'Up to 1M' WHEN principal_amount <= 3000000 THEN '1M-3M' ELSE '3M+' END"
_AGE = f"""CASE WHEN age <= 6 THEN '0-6 months' WHEN age <= 12 THEN '7-12 months' WHEN age <= 24 THEN '13-24 months'
                ELSE '25+ months' END"""
_AGED = f"""(SELECT *, (year({AS_OF}) - year(start_date)) * 12 + month({AS_OF}) - month(start_date)
                       - CASE WHEN day({AS_OF}) < day(start_date) THEN 1 ELSE 0 END AS age FROM snapshot WHERE on_book)"""
_RAW["mart_summary"] = " UNION ALL ".join(
    f"""
SELECT '{report}' AS report, {segment} AS segment, count(*) AS contracts,
       {money("coalesce(sum(CAST(principal_amount * 100 AS HUGEINT)), 0)")} AS principal,
       {money("coalesce(sum(outstanding_cents), 0)")} AS outstanding, {money("coalesce(sum(overdue_cents), 0)")} AS overdue,
       {_n("current_dpd > 0")} AS delinquent, {_n("current_dpd > 29")} AS late_30, {_n("current_dpd > 89")} AS late_90,
       {money(_if("current_dpd > 29", "outstanding_cents"))} AS at_risk_30,
       {money(_if("current_dpd > 89", "outstanding_cents"))} AS at_risk_90
FROM {_AGED} s GROUP BY {segment}"""
    for report, segment in {
        "portfolio_kpis": "CAST(NULL AS VARCHAR)", "dpd_bucket_summary": "dpd_bucket", "risk_by_loan_size": _SIZE,
        "risk_by_months_on_book": _AGE,
    }.items()
)
_RAW["bucketed_snapshot"] = _RAW["portfolio_snapshot"]
_RAW["bucketed_events"] = _RAW["derive_delinquency_events"]
_RAW["bucketed_installments"] = _RAW["classify_installments"]

_TERM_TEXTS = ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), '\\N')"
    for c in "row_no down_payment asset_value probability_of_default months_on_book due_installments maturity_date"
    " contract_status closed_date decision_type".split()
)
_RAW["batch_key"] = f"""
SELECT run_key, rows AS batch_rows,
       strftime({AS_OF}, '%Y%m%d') || '-' || substr(md5(concat_ws(':', rows, mixed, summed)), 1, 12) AS batch_key
FROM (SELECT run_key, count(*) AS rows, bit_xor(CAST('0x' || substr(digest, 1, 15) AS BIGINT)) AS mixed,
             sum(CAST('0x' || substr(digest, 16, 6) AS BIGINT)) AS summed
      FROM (SELECT run_key, md5(concat_ws(chr(31), {_TERM_TEXTS})) AS digest FROM terms) d GROUP BY run_key) g
"""

# Keys run from 1 through both batches, whichever row has which.
_RAW["load_two_batches"] = f"""
SELECT table_name, run_key, count(*) AS stored_rows,
       CAST(sum(count(*)) OVER (PARTITION BY table_name) AS BIGINT) AS table_rows,
       CAST(sum(count(*)) OVER (PARTITION BY table_name) AS BIGINT) AS table_keys,
       CASE WHEN table_name <> 'loan_collateral' THEN CAST(1 AS BIGINT) END AS low_key,
       CASE WHEN table_name <> 'loan_collateral' THEN CAST(sum(count(*)) OVER (PARTITION BY table_name) AS BIGINT) END
           AS high_key
FROM ({" UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, run_key FROM terms" for t in _NORMALISED if t != "loan_collateral"]
    + ["SELECT 'loan_collateral', run_key FROM terms WHERE loan_type <> 'consumer_loan'"]
)}) x
GROUP BY table_name, run_key
"""

ORACLE: dict[str, str] = {name: compose(sql, PARTS) for name, sql in _RAW.items()}
