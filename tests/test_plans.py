"""Properties a plan needs on large data, checked before any data is large."""

import re

import pytest

import __spark_entry__ as registered
from loanbook.operators import monitoring, payments, segmentation
from loanbook.operators.snapshot import portfolio_snapshot
from loanbook.plans import inspect
from loanbook.sources.orders_book import AS_OF, OrdersBook

SEGMENT_KEYS = ("dpd_bucket", "score_band", "loan_size_segment", "mob_segment")


@pytest.fixture(scope="module")
def book(spark, small):
    return OrdersBook(spark, small)


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are once no table is small enough to broadcast by size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", list(registered.queries()))
def test_no_python_and_no_products(spark, small, name):
    plan = inspect.physical_plan(registered.queries()[name](spark, small))
    assert inspect.python_nodes(plan) == []
    assert inspect.cartesian_nodes(plan) == []


def test_reports_never_join_facts_on_a_segment(spark, book, no_broadcast):
    reports = [
        monitoring.dpd_bucket_summary(book.snapshot),
        segmentation.risk_by_loan_size(book.snapshot),
        segmentation.risk_by_months_on_book(book.snapshot, AS_OF),
        segmentation.risk_by_score_band(book.contracts, book.scores, book.snapshot),
        payments.delinquency_resolution(book.delinquency_events, AS_OF),
    ]
    for report in reports:
        plan = inspect.physical_plan(report)
        merges = [block for block in plan.split("\n\n") if "SortMergeJoin" in block.split("\n")[0]]
        assert not any(key in block for block in merges for key in SEGMENT_KEYS)


def test_snapshot_reads_each_table_once(spark, book, no_broadcast):
    plan = inspect.physical_plan(
        portfolio_snapshot(book.contracts, book.schedule, book.payments, book.delinquency_events)
    )
    assert inspect.scans(plan) == 4
    # Facts by instalment, schedule by instalment, totals by contract, contracts by contract.
    assert inspect.shuffles(plan) == 4


def test_kpis_prune_columns_and_push_the_status(spark, book):
    plan = inspect.physical_plan(monitoring.portfolio_kpis(book.snapshot, AS_OF))
    (columns,) = inspect.read_columns(plan)
    assert "contract_number" not in columns and "paid_principal" not in columns
    assert any("contract_status" in f for f in inspect.pushed_filters(plan))


def test_monthly_report_scans_due_instalments_only(spark, book):
    plan = inspect.physical_plan(payments.monthly_payment_performance(book.schedule, book.payments, AS_OF))
    filters = " ".join(inspect.pushed_filters(plan))
    assert "LessThanOrEqual(due_date,2001-08-15)" in filters
    assert "EqualTo(payment_status,posted)" in filters


def test_schedule_expansion_does_not_shuffle(spark, book):
    from loanbook.operators.lifecycle import build_payment_schedule

    assert inspect.shuffles(inspect.physical_plan(build_payment_schedule(book.contracts))) == 0


def test_top_of_the_watchlist_does_not_sort_everything(spark, book):
    plan = inspect.physical_plan(
        segmentation.high_risk_watchlist(book.snapshot, book.contracts, book.scores, top=10)
    )
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("name", ["bucketed_snapshot", "bucketed_events", "bucketed_installments"])
def test_buckets_spare_the_shuffle_by_instalment(spark, small, no_broadcast, name):
    plan = inspect.physical_plan(registered.queries()[name](spark, small))
    exchanged = [block.split("\n")[-1] for block in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", block)]
    assert not any("payment_schedule_id" in keys for keys in exchanged)
    assert "Bucketed: true" in plan
    # What is left moves totals and contracts by contract.
    assert inspect.shuffles(plan) == (2 if name == "bucketed_snapshot" else 0)
