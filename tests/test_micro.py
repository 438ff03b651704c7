"""Hand-computed cases, one for each rule that is easy to get wrong."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from frames import D, snapshot, table
from loanbook.functions.calendar import full_months
from loanbook.functions.measures import mean, pct, scale_half_up
from loanbook.operators import constraints, lifecycle, monitoring, payments, quality, segmentation, validation
from loanbook.operators.snapshot import portfolio_snapshot
from loanbook.book import LoanBook


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "start, end, months",
    [
        (D(2024, 1, 31), D(2024, 2, 29), 0),
        (D(2020, 2, 29), D(2021, 2, 28), 11),
        (D(2021, 3, 15), D(2021, 8, 14), 4),
        (D(2021, 3, 15), D(2021, 8, 15), 5),
        (D(2024, 2, 10), D(2024, 1, 15), 0),
        (D(2024, 1, 31), D(2024, 3, 31), 2),
    ],
)
def test_full_months(spark, start, end, months):
    assert one(spark, full_months(F.lit(start), F.lit(end))) == months


@pytest.mark.parametrize(
    "part, total, expected",
    [
        (1, 3, "33.33"), (2, 3, "66.67"), (1, 800, "0.13"), (201, 20000, "1.01"), (0, 0, None), (0, 7, "0.00"),
        (-1, 800, "-0.13"), (1, -800, "-0.13"), (-1, -800, "0.13"),
    ],
)
def test_pct(spark, part, total, expected):
    value = one(spark, pct(F.lit(part), F.lit(total)))
    assert value == (None if expected is None else Decimal(expected))


def test_mean_rounds_half_away_from_zero(spark):
    assert one(spark, mean(F.lit(1), F.lit(8))) == Decimal("0.13")
    assert one(spark, mean(F.lit(-1), F.lit(8))) == Decimal("-0.13")
    assert one(spark, mean(F.lit(Decimal("10.01")), F.lit(2), scale=2)) == Decimal("5.01")


def test_scale_half_up_matches_exact_arithmetic(spark):
    values = [(v, f) for v in (0, 1, 5, 7, 10**13 + 3, 10**15 - 1, -7, -(10**14)) for f in (0, 1, 3, 9_999_999)]
    df = spark.createDataFrame(values, "v long, f long")
    for v, f, got in df.select("v", "f", scale_half_up(F.col("v"), F.col("f"), 12_000_000)).collect():
        size = (2 * abs(v) * f + 12_000_000) // 24_000_000
        assert got == (-size if v < 0 else size)


def test_payment_schedule(spark):
    contracts = table(
        spark, "loan_contracts",
        dict(principal_amount="100000.00", term_months=3, interest_rate="12.0000", start_date=D(2024, 1, 31)),
        dict(loan_contract_id=2, term_months=0),
    )
    got = rows(
        lifecycle.build_payment_schedule(contracts).orderBy("installment_number"),
        "principal_due", "interest_due", "due_date", "total_due",
    )
    assert [(str(p), str(i), d) for p, i, d, _ in got] == [
        ("33333.33", "1000.00", D(2024, 2, 29)),
        ("33333.33", "666.67", D(2024, 3, 31)),
        ("33333.34", "333.33", D(2024, 4, 30)),
    ]
    assert str(got[0][3]) == "34333.33"


@pytest.mark.parametrize("amount, term", [("0.05", 10), ("999999999999.99", 240), ("1000.00", 7), ("0.01", 1)])
def test_schedule_adds_up_to_principal(spark, amount, term):
    contracts = table(spark, "loan_contracts", dict(principal_amount=amount, term_months=term))
    total = lifecycle.build_payment_schedule(contracts).agg(F.sum("principal_due")).first()[0]
    assert total == Decimal(amount)


def test_events(spark):
    as_of = D(2024, 6, 30)
    schedule = table(
        spark, "payment_schedule",
        *[
            dict(payment_schedule_id=i, due_date=due)
            for i, due in enumerate(
                [D(2024, 6, 30), D(2024, 6, 29), D(2024, 5, 31), D(2024, 5, 31), D(2024, 5, 1), D(2024, 5, 1)], 1
            )
        ],
    )
    paid = table(
        spark, "payments",
        dict(payment_schedule_id=3, payment_date=D(2024, 5, 31)),
        dict(payment_schedule_id=4, payment_date=D(2024, 6, 10)),
        dict(payment_schedule_id=5, payment_date=D(2024, 5, 3), payment_status="reversed"),
        dict(payment_schedule_id=6, payment_date=D(2024, 5, 1), principal_paid="1.00"),
    )
    events = lifecycle.derive_delinquency_events(schedule, paid, as_of).orderBy("payment_schedule_id")
    assert rows(
        events, "payment_schedule_id", "delinquency_status", "delinquency_start_date", "delinquency_end_date", "max_dpd"
    ) == [
        (2, "open", D(2024, 6, 30), None, 1),
        (4, "closed", D(2024, 6, 1), D(2024, 6, 10), 10),
        (5, "closed", D(2024, 5, 2), D(2024, 5, 3), 2),
    ]
    resolution = payments.delinquency_resolution(events.where("payment_schedule_id = 4"), as_of).collect()
    assert resolution[1].avg_days_to_resolution == Decimal("9.00")


def test_penalty(spark):
    events = table(spark, "delinquency_events", dict(overdue_principal="100000.00", max_dpd=37))
    assert rows(lifecycle.with_penalty_amount(events), "penalty_amount") == [(Decimal("2027.40"),)]


def test_mart_buckets(spark):
    dpds = [0, 1, 30, 31, 60, 61, 89, 90]
    contracts = table(spark, "loan_contracts", *[dict(loan_contract_id=i) for i in range(len(dpds))])
    schedule = table(
        spark, "payment_schedule", *[dict(payment_schedule_id=i, loan_contract_id=i) for i in range(len(dpds))]
    )
    events = table(
        spark, "delinquency_events",
        *[dict(delinquency_event_id=i, payment_schedule_id=i, max_dpd=d) for i, d in enumerate(dpds) if d],
    )
    snap = portfolio_snapshot(contracts, schedule, table(spark, "payments"), events).orderBy("loan_contract_id")
    assert [r[0] for r in rows(snap, "dpd_bucket")] == [
        "Current", "1-30", "1-30", "31-60", "31-60", "61-89", "61-89", "90+"
    ]


def test_snapshot_balances(spark):
    contracts = table(spark, "loan_contracts", dict(loan_contract_id=1), dict(loan_contract_id=2))
    schedule = table(
        spark, "payment_schedule",
        dict(payment_schedule_id=10, loan_contract_id=1), dict(payment_schedule_id=11, loan_contract_id=1),
    )
    paid = table(
        spark, "payments",
        dict(payment_schedule_id=10, principal_paid="60.00"),
        dict(payment_schedule_id=10, principal_paid="40.00"),
        dict(payment_schedule_id=11, principal_paid="7.00", payment_status="pending"),
        dict(payment_schedule_id=11, principal_paid="9.00", payment_status="reversed"),
    )
    events = table(
        spark, "delinquency_events",
        dict(payment_schedule_id=10, max_dpd=95, delinquency_status="closed", overdue_principal="100.00"),
        dict(payment_schedule_id=11, max_dpd=20, overdue_principal="55.00"),
    )
    snap = portfolio_snapshot(contracts, schedule, paid, events).orderBy("loan_contract_id")
    got = rows(
        snap, "paid_principal", "outstanding_principal", "overdue_principal", "current_dpd", "max_dpd", "dpd_bucket"
    )
    assert got == [
        (Decimal("100.00"), Decimal("900.00"), Decimal("55.00"), 20, 95, "1-30"),
        (Decimal("0.00"), Decimal("1000.00"), Decimal("0.00"), 0, 0, "Current"),
    ]


def test_report_bucket_edges_differ(spark):
    dpds = [7, 8, 30, 31, 60, 61, 90, 91]
    events = table(
        spark, "delinquency_events",
        *[dict(delinquency_event_id=i, payment_schedule_id=i, max_dpd=d) for i, d in enumerate(dpds)],
    )
    resolution = payments.delinquency_resolution(events, D(2024, 6, 30))
    assert rows(resolution, "dpd_bucket", "total_events") == [
        ("1-7", 1), ("8-30", 2), ("31-60", 2), ("61-90", 2), ("91+", 1)
    ]
    contracts = table(spark, "loan_contracts", *[dict(loan_contract_id=i) for i in range(9)])
    schedule = table(spark, "payment_schedule", *[dict(payment_schedule_id=i, loan_contract_id=i) for i in range(8)])
    spread = validation.open_dpd_distribution(contracts, schedule, events)
    assert rows(spread, "dpd_bucket", "contracts") == [
        ("Current", 1), ("1-30", 3), ("31-60", 2), ("61-90", 2), ("90+", 1)
    ]


def test_watchlist(spark):
    cases = [
        ("active", 30, "1000.00", 600), ("active", 61, "1000.00", 600), ("active", 90, "1000.00", 600),
        ("restructured", 0, "1000.00", 500), ("defaulted", 95, "1000.00", 549), ("closed", 95, "1000.00", 600),
        ("cancelled", 95, "1000.00", 600), ("active", 95, "0.00", 600), ("active", 30, "1000.00", None),
    ]
    snap = snapshot(
        spark,
        *[
            dict(loan_contract_id=i, contract_status=s, current_dpd=d, outstanding_principal=o)
            for i, (s, d, o, _) in enumerate(cases)
        ],
    )
    contracts = table(
        spark, "loan_contracts", *[dict(loan_contract_id=i, loan_application_id=100 + i) for i in range(len(cases))]
    )
    scores = table(
        spark, "application_scores",
        *[dict(loan_application_id=100 + i, score=c[3]) for i, c in enumerate(cases) if c[3] is not None],
    )
    listed = segmentation.high_risk_watchlist(snap, contracts, scores)
    assert {r[0]: r[1:] for r in rows(listed, "loan_contract_id", "priority", "risk_reason")} == {
        0: ("Medium", "Current DPD 30-60"),
        1: ("High", "Current DPD 61-89"),
        2: ("Critical", "Current DPD 90+"),
        3: ("High", "Low score; Restructured status"),
        4: ("Critical", "Current DPD 90+; Low score; Defaulted status"),
        6: ("Critical", "Current DPD 90+"),
        8: ("Medium", "Current DPD 30-60"),
    }
    assert [r[0] for r in rows(listed, "loan_contract_id")] == [4, 6, 2, 1, 3, 0, 8]
    top = segmentation.high_risk_watchlist(snap, contracts, scores, top=2)
    assert [r[0] for r in rows(top, "loan_contract_id")] == [4, 6]


def test_parts_of_a_payment_fan_out(spark):
    schedule = table(spark, "payment_schedule", dict(due_date=D(2024, 6, 1), total_due="100.00"))
    paid = table(
        spark, "payments",
        dict(payment_id=1, payment_date=D(2024, 6, 1), payment_amount="60.00"),
        dict(payment_id=2, payment_date=D(2024, 6, 1), payment_amount="40.00"),
    )
    month = payments.monthly_payment_performance(schedule, paid, D(2024, 6, 30)).first()
    assert (month.scheduled_installments, month.paid_installments, month.unpaid_installments) == (2, 2, 0)
    assert (month.scheduled_amount, month.paid_amount) == (Decimal("200.00"), Decimal("100.00"))
    assert (month.on_time_payment_rate_pct, month.collection_rate_pct) == (Decimal("100.00"), Decimal("50.00"))
    assert month.average_payment_delay_days is None


def test_only_posted_payments_settle(spark):
    schedule = table(
        spark, "payment_schedule", dict(due_date=D(2024, 6, 1)), dict(payment_schedule_id=2, due_date=D(2024, 7, 1))
    )
    paid = table(spark, "payments", dict(payment_status="pending"))
    states = payments.classify_installments(schedule, paid, D(2024, 6, 30)).orderBy("payment_schedule_id")
    assert [r[0] for r in rows(states, "payment_state")] == ["unpaid", "not_due"]


def test_empty_book(spark):
    nothing = snapshot(spark)
    kpis = monitoring.portfolio_kpis(nothing, D(2024, 6, 30)).first()
    assert (kpis.total_contracts, kpis.total_outstanding) == (0, Decimal("0.00"))
    assert (kpis.delinquency_rate_pct, kpis.par_30_pct, kpis.overdue_share_pct) == (None, None, None)
    with pytest.raises(Exception, match="(?i)divi"):
        monitoring.dpd_bucket_summary(nothing).collect()
    sizes = segmentation.risk_by_loan_size(nothing).collect()
    assert [(r.loan_size_segment, r.contract_count, r.delinquency_rate_pct, r.average_outstanding) for r in sizes] == [
        ("Up to 1M", 0, None, Decimal("0.00")), ("1M-3M", 0, None, Decimal("0.00")), ("3M+", 0, None, Decimal("0.00"))
    ]
    assert {r.share_of_outstanding_pct for r in segmentation.risk_by_months_on_book(nothing, D(2024, 6, 30)).collect()} == {None}


def test_empty_segments_have_zero_share(spark):
    snap = snapshot(spark, dict(start_date=D(2024, 6, 1)))
    report = segmentation.risk_by_months_on_book(snap, D(2024, 6, 30)).collect()
    assert [r.share_of_outstanding_pct for r in report] == [Decimal("100.00")] + [Decimal("0.00")] * 3
    assert [r.par_30_pct for r in report] == [Decimal("0.00"), None, None, None]


def test_score_bands(spark):
    contracts = table(
        spark, "loan_contracts",
        *[dict(loan_contract_id=i, loan_application_id=10 + i, contract_status="closed") for i in (1, 2, 3)],
    )
    scores = table(
        spark, "application_scores",
        dict(application_score_id=1, loan_application_id=11, score=340),
        dict(application_score_id=2, loan_application_id=12, score=449, probability_of_default="0.100000"),
        dict(application_score_id=3, loan_application_id=12, score=400, probability_of_default=None),
        dict(application_score_id=4, loan_application_id=12, score=450, probability_of_default="0.200000"),
    )
    snap = snapshot(spark, *[dict(loan_contract_id=i, contract_status="closed", max_dpd=30) for i in (1, 2, 3)])
    report = segmentation.risk_by_score_band(contracts, scores, snap).collect()
    assert [r.total_contracts for r in report] == [2, 1, 0, 0, 0]
    low = report[0]
    assert (low.avg_score, low.avg_pd_pct) == (Decimal("424.50"), Decimal("10.00"))
    assert (low.ever_dpd_30_plus_contracts, low.total_outstanding) == (2, Decimal("2000.00"))
    assert report[4].avg_score is None and report[4].total_outstanding == Decimal("0.00")


def test_lifetime_thresholds_differ(spark):
    contracts = table(
        spark, "loan_contracts", *[dict(loan_contract_id=i, loan_application_id=i) for i in (1, 2)]
    )
    schedule = table(spark, "payment_schedule", *[dict(payment_schedule_id=i, loan_contract_id=i) for i in (1, 2)])
    events = table(
        spark, "delinquency_events",
        dict(delinquency_event_id=1, payment_schedule_id=1, max_dpd=30),
        dict(delinquency_event_id=2, payment_schedule_id=2, max_dpd=31),
    )
    snap = portfolio_snapshot(contracts, schedule, table(spark, "payments"), events)
    scores = table(spark, "application_scores", *[dict(loan_application_id=i, score=600) for i in (1, 2)])
    assert segmentation.risk_by_score_band(contracts, scores, snap).collect()[2].ever_dpd_30_plus_contracts == 2
    early = payments.early_delinquency_analysis(contracts, schedule, events).collect()
    assert [(r.delinquency_timing, r.ever_30_plus_contracts) for r in early] == [("First 3 installments", 1)]


@pytest.mark.parametrize("days, expected", [([0, 1, 9], 1.0), ([0, 1], 0.5), ([], None)])
def test_median(spark, days, expected):
    events = table(
        spark, "delinquency_events",
        *[
            dict(
                delinquency_event_id=i, payment_schedule_id=i, max_dpd=5, delinquency_status="closed",
                delinquency_end_date=D(2024, 6, 2) + dt.timedelta(days=d),
            )
            for i, d in enumerate(days)
        ],
    )
    assert payments.delinquency_resolution(events, D(2024, 6, 30)).first().median_days_to_resolution == expected


def test_contract_without_schedule(spark):
    contracts = table(spark, "loan_contracts", dict(loan_contract_id=1))
    schedule, events = table(spark, "payment_schedule"), table(spark, "delinquency_events")
    early = payments.early_delinquency_analysis(contracts, schedule, events).collect()
    assert [(r.delinquency_timing, r.contract_count) for r in early] == [("No delinquency", 1)]


def test_checks_pass_on_null(spark):
    book = LoanBook(
        loan_contracts=table(
            spark, "loan_contracts",
            dict(loan_contract_id=1, contract_status="closed", closed_date=None),
            dict(loan_contract_id=2, contract_status=None),
        ),
        customer_income=table(spark, "customer_income", dict(customer_income_id=1, currency="RUB\n", valid_to=None)),
        loan_disbursements=table(
            spark, "loan_disbursements",
            dict(loan_disbursement_id=1, transaction_reference=None),
            dict(loan_disbursement_id=2, transaction_reference=None),
        ),
    )
    found = {r.constraint_name: r.violations for r in constraints.audit_checks(book).collect() if r.violations}
    assert found == {"chk_closed_contract_date": 1, "chk_customer_income_currency": 1}
    repeated = {r.constraint_name: r.violations for r in constraints.audit_uniqueness(book).collect() if r.violations}
    assert repeated == {
        "loan_contracts_loan_application_id_key": 1, "loan_contracts_contract_number_key": 1,
    }


def test_orphan_rows(spark):
    book = LoanBook(
        payment_schedule=table(spark, "payment_schedule", dict(payment_schedule_id=1)),
        payments=table(spark, "payments", dict(payment_id=1), dict(payment_id=2, payment_schedule_id=9)),
    )
    assert rows(constraints.orphan_rows(book, "fk_payment_schedule"), "payment_id") == [(2,)]


def test_balance_check(spark):
    snap = snapshot(
        spark,
        dict(loan_contract_id=1),
        dict(loan_contract_id=2, outstanding_principal="-0.01"),
        dict(loan_contract_id=3, overdue_principal="-1.00"),
        dict(loan_contract_id=4, overdue_principal="1000.01"),
    )
    assert sorted(r[0] for r in rows(quality.balance_consistency(snap), "loan_contract_id")) == [2, 3, 4]


def test_contract_terms(spark):
    base = dict(
        row_no=1, as_of_date=D(2024, 6, 30), loan_type="auto_loan", requested_amount=Decimal("900000.00"),
        term_months=12, down_payment_share=Decimal("0.1000"), score=350, pd_noise=0.5, start_date=D(2023, 5, 31),
        is_defaulted=False, is_restructured=False, is_clean=True, condition_flag=False, close_lag_days=20,
    )
    cases = [
        base,
        {**base, "row_no": 2, "start_date": D(2023, 6, 20), "close_lag_days": 20},
        {**base, "row_no": 3, "loan_type": "consumer_loan", "score": 850, "pd_noise": 0.999, "is_defaulted": True},
        {**base, "row_no": 4, "is_restructured": True, "condition_flag": True, "score": 700},
        {**base, "row_no": 5, "start_date": D(2024, 7, 10), "score": 540},
    ]
    schema = (
        "row_no long, as_of_date date, loan_type string, requested_amount decimal(15,2), term_months int,"
        " down_payment_share decimal(6,4), score int, pd_noise double, start_date date, is_defaulted boolean,"
        " is_restructured boolean, is_clean boolean, condition_flag boolean, close_lag_days int"
    )
    staging = spark.createDataFrame([[c[n.split()[0]] for n in _columns(schema)] for c in cases], schema)
    got = {
        r.row_no: r
        for r in lifecycle.derive_contract_terms(staging).collect()
    }
    assert (got[1].asset_value, got[1].down_payment) == (Decimal("1000000.00"), Decimal("100000.00"))
    assert (got[3].asset_value, got[3].down_payment) == (None, Decimal("0.00"))
    assert got[1].probability_of_default == Decimal("0.450000")
    assert got[3].probability_of_default == Decimal("0.074950")
    assert (got[1].months_on_book, got[1].due_installments, got[1].maturity_date) == (12, 12, D(2024, 5, 31))
    assert (got[1].contract_status, got[1].closed_date) == ("closed", D(2024, 6, 20))
    assert (got[2].contract_status, got[2].closed_date) == ("closed", D(2024, 6, 30))
    assert [got[i].contract_status for i in (3, 4, 5)] == ["defaulted", "restructured", "active"]
    assert [got[i].decision_type for i in (1, 4, 5)] == ["approved_with_conditions"] * 2 + ["approved"]
    assert got[5].due_installments == 0


def _columns(schema):
    import re

    return [c.strip() for c in re.split(r",(?![^(]*\))", schema)]
