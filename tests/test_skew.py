"""One key holding a third of the rows must neither change results nor end up in one group."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import compare
from frames import D, snapshot, table
from loanbook.operators import payments, segmentation
from loanbook.operators.snapshot import portfolio_snapshot
from loanbook.sources.orders_book import MAX_TERM, OrdersBook

HOT_ORDER = 7


@pytest.fixture(scope="module", params=["many parts", "copies of one line", "one part at many prices"])
def skewed(request, spark, small, tmp_path_factory):
    """Order tables in which one order has a third of all lines, all different or all equal."""
    folder = tmp_path_factory.mktemp("skewed")
    for name in ["orders", "customer"]:
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    hot = lines.where("l_orderkey % 2 = 0").withColumns(
        {"l_orderkey": F.lit(HOT_ORDER).cast("long"), "l_partkey": F.col("l_partkey") + 1}
    )
    if request.param == "copies of one line":
        hot = lines.limit(1).drop("l_orderkey").crossJoin(hot.select("l_orderkey")).select(*lines.columns)
    if request.param == "one part at many prices":
        hot = hot.withColumns({"l_partkey": F.lit(3).cast("long"), "l_suppkey": F.lit(4).cast("long"), "l_linenumber": F.lit(1).cast(lines.schema["l_linenumber"].dataType)})
    lines.unionByName(hot).repartition(4).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize(
    "name",
    [
        "portfolio_snapshot", "portfolio_kpis", "risk_by_score_band", "high_risk_watchlist",
        "monthly_payment_performance", "early_delinquency_analysis", "derive_delinquency_events",
        "build_payment_schedule", "batch_entity_counts", "normalise_loan_contracts", "audit_uniqueness",
    ],
)
def test_skewed_orders_match_sql(spark, skewed, name):
    with compare.duck(skewed) as connection:
        assert compare.assert_same(
            registered.queries()[name](spark, skewed), connection, registered.oracle_sql()[name]
        ) > 0


def test_oversized_order_is_split(spark, skewed):
    book = OrdersBook(spark, skewed, store=False)
    lines = spark.read.parquet(f"{skewed}/lineitem.parquet")
    assert lines.where(F.col("l_orderkey") == HOT_ORDER).count() > lines.count() / 3.1
    per_contract = book.wide_schedule.groupBy("loan_contract_id").count()
    assert per_contract.agg(F.max("count")).first()[0] <= MAX_TERM
    assert book.wide_schedule.count() == lines.count()
    assert book.wide_schedule.select("payment_schedule_id").distinct().count() == lines.count()


def test_splitting_without_broadcast_or_storage_gives_the_same_book(spark, skewed):
    def contracts(store):
        return OrdersBook(spark, skewed, store=store).contracts.orderBy("loan_contract_id").collect()

    stored = contracts(True)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert contracts(True) == stored
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert contracts(False) == stored


def test_copies_are_laid_out_in_blocks(spark, monkeypatch):
    import loanbook.sources.orders_book as module

    monkeypatch.setattr(module, "_COPY_BLOCK", 10)
    rows = spark.createDataFrame([(1, "a")] * 37 + [(1, "b")] + [(2, "a")] * 10, "k long, v string")
    got = module._numbered_copies(rows).groupBy("k", "v").agg(F.sort_array(F.collect_list("copy")).alias("copies"))
    assert {(r.k, r.v): r.copies for r in got.collect()} == {
        (1, "a"): list(range(37)), (1, "b"): [0], (2, "a"): list(range(10))
    }


@pytest.fixture(scope="module")
def hot_payments(spark):
    """300 instalments; the first has a third of all payments."""
    pick = random.Random(3)
    schedule = [
        dict(
            payment_schedule_id=i, loan_contract_id=i // 3, installment_number=i % 3 + 1,
            due_date=D(2024, 1 + i % 6, 1 + i % 28), total_due=f"{100 + i}.50", principal_due=f"{100 + i}.50",
        )
        for i in range(300)
    ]
    paid = [
        dict(
            payment_id=n, payment_schedule_id=0 if n % 3 == 0 else pick.randrange(1, 250),
            payment_date=D(2024, pick.randrange(1, 8), pick.randrange(1, 28)),
            payment_amount=f"{pick.randrange(1, 50)}.25", principal_paid=f"{pick.randrange(1, 50)}.25",
            payment_status=pick.choice(["posted", "posted", "posted", "pending", "reversed"]),
        )
        for n in range(900)
    ]
    return table(spark, "payment_schedule", *schedule), table(spark, "payments", *paid), schedule, paid


def test_hot_instalment_classified_row_by_row(spark, hot_payments):
    schedule_df, paid_df, schedule, paid = hot_payments
    as_of = D(2024, 5, 15)
    expected = []
    for s in schedule:
        mine = [p for p in paid if p["payment_schedule_id"] == s["payment_schedule_id"] and p["payment_status"] == "posted"]
        for p in mine or [None]:
            day = p["payment_date"] if p else None
            state = (
                "not_due" if s["due_date"] > as_of
                else "unpaid" if day is None
                else "on_time" if day <= s["due_date"] else "late"
            )
            late = (day - s["due_date"]).days if day and day > s["due_date"] else None
            expected.append((s["payment_schedule_id"], day, state, late, p["payment_amount"] if p else "0.00"))
    got = payments.classify_installments(schedule_df, paid_df, as_of).select(
        "payment_schedule_id", "payment_date", "payment_state", "payment_delay_days",
        F.col("paid_amount").cast("string"),
    )
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)


def test_hot_instalment_in_snapshot(spark, hot_payments):
    schedule_df, paid_df, schedule, paid = hot_payments
    contracts = table(
        spark, "loan_contracts",
        *[dict(loan_contract_id=i, loan_application_id=i, principal_amount="100000.00") for i in range(100)],
    )
    events = table(
        spark, "delinquency_events",
        *[dict(delinquency_event_id=i, payment_schedule_id=i * 7, max_dpd=i + 1) for i in range(40)],
    )
    owner = {s["payment_schedule_id"]: s["loan_contract_id"] for s in schedule}
    cents = dict.fromkeys(range(100), 0)
    for p in paid:
        if p["payment_status"] == "posted":
            cents[owner[p["payment_schedule_id"]]] += int(p["principal_paid"].replace(".", ""))
    snap = portfolio_snapshot(contracts, schedule_df, paid_df, events)
    assert {r.loan_contract_id: int(r.paid_principal * 100) for r in snap.collect()} == cents


def test_hot_application_keeps_every_score(spark):
    count = 300
    snap = snapshot(
        spark,
        *[dict(loan_contract_id=i, current_dpd=30 + i % 90, max_dpd=30 + i % 90, contract_status="active") for i in range(100)],
    )
    contracts = table(spark, "loan_contracts", *[dict(loan_contract_id=i, loan_application_id=i) for i in range(100)])
    applications = [5 if n % 3 == 0 else n % 80 for n in range(count)]
    scores = table(
        spark, "application_scores",
        *[dict(application_score_id=n, loan_application_id=a, score=350 + n) for n, a in enumerate(applications)],
    )
    listed = segmentation.high_risk_watchlist(snap, contracts, scores)
    unscored = 100 - len(set(applications))
    assert listed.count() == count + unscored
    bands = segmentation.risk_by_score_band(contracts, scores, snap).collect()
    assert sum(r.total_contracts for r in bands) == count
    assert sum(r.total_outstanding for r in bands) == count * 1000
