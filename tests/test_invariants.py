"""Totals that must agree between reports over the same book."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loanbook.functions.joins import left_join_many
from loanbook.operators import constraints, lifecycle, monitoring, payments, segmentation
from loanbook.plans import inspect
from loanbook.sources.orders_book import AS_OF, OrdersBook


@pytest.fixture(scope="module")
def book(spark, small):
    return OrdersBook(spark, small)


def test_snapshot_has_one_row_per_contract(book):
    assert book.snapshot.count() == book.contracts.count()
    assert book.snapshot.select("loan_contract_id").distinct().count() == book.contracts.count()


def test_balances(book):
    wrong = book.snapshot.where(
        "overdue_principal < 0 OR overdue_principal > outstanding_principal"
        " OR paid_principal + outstanding_principal <> principal_amount OR current_dpd > max_dpd"
    )
    assert wrong.isEmpty()


def test_segment_reports_add_up_to_the_kpis(book):
    kpis = monitoring.portfolio_kpis(book.snapshot, AS_OF).first()
    buckets = monitoring.dpd_bucket_summary(book.snapshot).collect()
    assert sum(r.contract_count for r in buckets) == kpis.total_contracts
    assert sum(r.outstanding_principal for r in buckets) == kpis.total_outstanding
    assert sum(r.overdue_principal for r in buckets) == kpis.total_overdue
    assert abs(sum(r.share_of_contracts_pct for r in buckets) - 100) <= Decimal("0.03")
    for report in [
        segmentation.risk_by_loan_size(book.snapshot),
        segmentation.risk_by_months_on_book(book.snapshot, AS_OF),
    ]:
        rows = report.collect()
        assert sum(r.contract_count for r in rows) == kpis.total_contracts
        assert sum(r.total_principal for r in rows) == kpis.total_principal
        assert sum(r.dpd_30_plus_contracts for r in rows) == kpis.dpd_30_plus_contracts


def test_monthly_counts(book):
    months = payments.monthly_payment_performance(book.schedule, book.payments, AS_OF).collect()
    for m in months:
        assert m.paid_installments + m.unpaid_installments == m.scheduled_installments
        assert m.on_time_installments + m.late_installments == m.paid_installments
    states = payments.classify_installments(book.schedule, book.payments, AS_OF)
    assert sum(m.scheduled_installments for m in months) == states.where("payment_state <> 'not_due'").count()


def test_resolution_counts(book):
    rows = payments.delinquency_resolution(book.delinquency_events, AS_OF).collect()
    assert all(r.closed_events + r.open_events == r.total_events for r in rows)
    assert sum(r.total_events for r in rows) == book.delinquency_events.count()


def test_built_schedule_repays_the_principal(book):
    parts = lifecycle.build_payment_schedule(book.contracts).groupBy("loan_contract_id").agg(
        F.sum("principal_due").alias("repaid"), F.count("*").alias("parts")
    )
    wrong = book.contracts.join(parts, "loan_contract_id").where("repaid <> principal_amount OR parts <> term_months")
    assert wrong.isEmpty() and parts.count() == book.contracts.count()


def test_clean_book_passes_every_audit(book):
    for audit in [constraints.audit_foreign_keys, constraints.audit_uniqueness, constraints.audit_not_null,
                  constraints.audit_text_lengths, constraints.audit_checks]:
        assert audit(book.book).where("violations > 0").collect() == []


def test_left_join_many_keeps_rows_without_a_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (1, 11), (None, 12)], "k int, w int")
    expected = left.join(right, "k", "left")
    got = left_join_many(left, right, "k").select(*expected.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_both_branches_read_one_shuffle(spark, book):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        states = payments.classify_installments(book.schedule, book.payments, AS_OF)
        states.write.format("noop").mode("overwrite").save()
        states.collect()
        assert "ReusedExchange" in states._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_derived_schedule_shuffles_each_side_once(spark, small):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = OrdersBook(spark, small)
        # Lines by contract for numbering and join alike, and the contracts.
        assert inspect.shuffles(inspect.physical_plan(fresh._derive_schedule())) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
