"""Reports from one summary, events rolled forward, merged medians."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from loanbook.book import LoanBook
from loanbook.operators import monitoring, segmentation, sketches, summary
from loanbook.operators.lifecycle import derive_delinquency_events
from loanbook.operators.rolling import roll_delinquency_events
from loanbook.plans import inspect
from loanbook.schemas import RUN_KEY
from loanbook.operators.snapshot import portfolio_snapshot
from loanbook.sources import mart, orders_book, storage
from loanbook.sources.orders_book import AS_OF, OrdersBook


@pytest.fixture(scope="module")
def book(spark, small):
    return OrdersBook(spark, small)


def today(snapshot):
    return {
        "portfolio_kpis": monitoring.portfolio_kpis(snapshot, AS_OF),
        "dpd_bucket_summary": monitoring.dpd_bucket_summary(snapshot),
        "risk_by_loan_size": segmentation.risk_by_loan_size(snapshot),
        "risk_by_months_on_book": segmentation.risk_by_months_on_book(snapshot, AS_OF),
    }


def test_four_reports_from_one_scan(spark, book, tmp_path):
    found = summary.mart_summary(book.snapshot, AS_OF)
    plan = inspect.physical_plan(found)
    assert inspect.scans(plan) == 1 and inspect.shuffles(plan) == 1
    reports = summary.reports(storage.write_table(found, str(tmp_path / "summary")), AS_OF)
    for name, report in today(book.snapshot).items():
        assert reports[name].columns == report.columns
        assert reports[name].collect() == report.collect(), name


def test_reports_of_an_empty_book(spark, book, tmp_path):
    nothing = book.snapshot.limit(0)
    reports = summary.reports(storage.write_table(summary.mart_summary(nothing, AS_OF), str(tmp_path / "s")), AS_OF)
    expected = today(nothing)
    for name in ("portfolio_kpis", "risk_by_loan_size", "risk_by_months_on_book"):
        assert reports[name].collect() == expected[name].collect()


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("back", [(400, 0), (90, 89, 30, 0), (1, 0)])
def test_rolling_equals_deriving(book, back):
    days = [AS_OF - dt.timedelta(days=n) for n in back]
    paid = F.col("payment_date")
    events = derive_delinquency_events(book.schedule, book.payments.where(paid <= days[0]), days[0])
    for since, day in zip(days, days[1:]):
        new = book.payments.where((paid > since) & (paid <= day))
        events = roll_delinquency_events(events, book.schedule, book.payments.where(paid <= since), new, since, day)
    assert rows(events) == rows(derive_delinquency_events(book.schedule, book.payments, AS_OF))


def test_payments_that_arrive_late(book):
    """Payments known only afterwards, whatever their day, change what was an event."""
    since, day = AS_OF - dt.timedelta(days=120), AS_OF
    key, paid = F.col("payment_id"), F.col("payment_date")
    known = book.payments.where((paid <= since) & (F.xxhash64(key) % 3 != 0))
    new = book.payments.where((paid > since) | (F.xxhash64(key) % 3 == 0))
    events = derive_delinquency_events(book.schedule, known, since)
    rolled = roll_delinquency_events(events, book.schedule, known, new, since, day)
    assert rows(rolled) == rows(derive_delinquency_events(book.schedule, book.payments, day))
    assert not events.join(rolled, "delinquency_event_id", "left_anti").isEmpty()


def test_merged_medians_stay_within_their_rank_error(spark):
    start = F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("id") % 11).cast("int"))
    days = (F.pmod(F.xxhash64("id"), F.lit(900)) * F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7))).cast("int")
    events = spark.range(200_000).select(
        (F.col("id") % 120 + 1).cast("int").alias("max_dpd"), F.lit("closed").alias("delinquency_status"),
        start.alias("delinquency_start_date"), F.date_add(start, days).alias("delinquency_end_date"),
        F.concat(F.lit("R"), F.floor(F.col("id") / 17_000)).alias(RUN_KEY),
    )
    parts = sketches.resolution_sketches(events)
    assert parts.count() == 5 * 12
    assert parts.agg(F.max(F.octet_length("sketch"))).first()[0] < 20_000
    errors = sketches.rank_of_median(sketches.median_resolution(parts), events).collect()
    assert [r.dpd_bucket for r in sorted(errors, key=lambda r: r.dpd_bucket)] == ["1-7", "31-60", "61-90", "8-30", "91+"]
    assert all(r.rank_error <= 0.015 for r in errors)
    exact = events.groupBy().agg(F.count("*")).first()[0]
    assert sum(r.closed_events for r in errors) == exact


def test_the_mart_follows_its_loads(spark, book, tmp_path):
    root, place = str(tmp_path / "book"), str(tmp_path / "mart")
    tables = {name: df for name, df in book.book.tables().items() if name in mart.SOURCES}
    key, part = F.col("loan_contract_id"), F.col("payment_schedule_id") % 2 == 0
    some = key % 3 == 0
    batches = [
        # Payments and events of contracts that are not there yet, and the other way round.
        {"loan_contracts": some, "payment_schedule": some, "payments": part},
        {"loan_contracts": ~some, "payment_schedule": ~some, "delinquency_events": F.lit(True)},
        {"payments": ~part & (F.col("payment_schedule_id") < 2_000_000)},
    ]
    for n, batch in enumerate(batches):
        storage.append_batch(LoanBook(**{name: tables[name].where(test) for name, test in batch.items()}), root)
        done = mart.refresh_snapshot(spark, root, place, buckets=32)
        stored = storage.read_book(spark, root).tables()
        whole = portfolio_snapshot(
            *(stored.get(name, tables[name].limit(0)) for name in mart.SOURCES)
        )
        assert rows(mart.read_mart(spark, place)) == rows(whole)
        assert len(done.loads) == 1
        if n == 2:
            assert 0 < len(done.buckets) < 32 and done.contracts < 40
    assert mart.refresh_snapshot(spark, root, place, buckets=32) == mart.Refreshed((), 0, ())


def test_untouched_buckets_are_not_opened(spark, book, tmp_path):
    root, place = str(tmp_path / "book"), str(tmp_path / "mart")
    tables = {name: df for name, df in book.book.tables().items() if name in mart.SOURCES}
    one = book.payments.orderBy("payment_id").select("payment_schedule_id").first()[0]
    late = F.col("payment_schedule_id") == one
    storage.append_batch(LoanBook(**{n: df.where(~late) if n == "payments" else df for n, df in tables.items()}), root)
    mart.refresh_snapshot(spark, root, place, buckets=8)
    storage.append_batch(LoanBook(payments=book.payments.where(late)), root)
    contract = book.schedule.where(late).first().loan_contract_id
    own = spark.createDataFrame([(contract,)], "loan_contract_id long").select(mart._bucket(8)).first()[0]
    for folder in (tmp_path / "mart").glob("*/bucket=*"):
        if folder.name != f"bucket={own}":
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"not to be opened")
    done = mart.refresh_snapshot(spark, root, place, buckets=8)
    assert (done.contracts, done.buckets) == (1, (own,))


def test_much_is_refreshed_without_single_keys_and_in_parts(spark, book, tmp_path, monkeypatch):
    """The same mart whether keys are sent out or not; a bucket is written in as many parts as there are partitions for it."""
    tables = {name: df for name, df in book.book.tables().items() if name in mart.SOURCES}
    late = F.col("payment_schedule_id") % 7 == 0
    marts = []
    for few in (mart.FEW_KEYS, 0):
        monkeypatch.setattr(mart, "FEW_KEYS", few)
        monkeypatch.setattr(storage, "FEW_KEYS", few)
        root, place = str(tmp_path / f"book-{few}"), str(tmp_path / f"mart-{few}")
        first = {n: df.where(~late) if n == "payments" else df for n, df in tables.items()}
        storage.append_batch(LoanBook(**first), root)
        mart.refresh_snapshot(spark, root, place, buckets=2)
        parts = [len(list(f.glob("*.parquet"))) for f in (tmp_path / f"mart-{few}").glob("*/bucket=*")]
        assert len(parts) == 2 and min(parts) > 1
        report = storage.append_batch(LoanBook(payments=book.payments), root)[0]
        assert report.refused == book.payments.where(~late).count() and report.added == book.payments.where(late).count()
        mart.refresh_snapshot(spark, root, place, buckets=2)
        marts.append(rows(mart.read_mart(spark, place)))
    assert marts[0] == marts[1] == rows(book.derive_snapshot())


def test_fresh_rows_are_stored_without_moving(spark, tmp_path, monkeypatch):
    """Keys in the range of an earlier load, none of them stored: keys are compared, rows stay where they are."""
    root, plans = str(tmp_path / "book"), []
    columns = storage.stored_schema("loan_contracts")
    given = spark.range(2000).select(*(
        F.col("id").alias(f.name) if f.name == "loan_contract_id" else F.lit("R" if f.name == RUN_KEY else None).cast(f.dataType).alias(f.name)
        for f in columns
    ))
    storage.append_batch(LoanBook(loan_contracts=given.where("loan_contract_id % 2 = 0")), root)
    opened = storage._read
    monkeypatch.setattr(storage, "_read", lambda *args: plans.append(args[3]) or opened(*args))
    odd = given.where("loan_contract_id % 2 = 1").repartition(3)
    (report,) = storage.append_batch(LoanBook(loan_contracts=odd), root)
    assert (report.added, report.refused, len(plans)) == (1000, 0, 1)
    # One file per partition of the batch: a join would have dealt them anew.
    (load,) = [r.folder for r in storage.loads(spark, root).where("low = 1").collect()]
    assert len(list((tmp_path / "book" / "loan_contracts" / load).glob("*.parquet"))) == 3


def test_shuffles_of_the_book_follow_its_input(spark, small, tmp_path, monkeypatch):
    """What a task holds is bounded by rows of the input per partition, not by the session's number."""
    seen, store = [], orders_book.write_table

    def noted(df, path):
        seen.append((spark.conf.get("spark.sql.shuffle.partitions"), path.rsplit("/", 1)[1]))
        return store(df, path)

    monkeypatch.setattr(orders_book, "ROWS_PER_PARTITION", 500)
    monkeypatch.setattr(orders_book, "write_table", noted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    sized = OrdersBook(spark, small)
    rows_in = sum(spark.read.parquet(f"{small}/{t}.parquet").count() for t in ("orders", "lineitem"))
    assert sized.partitions == -(-rows_in // 500) > int(before)
    assert sized.snapshot.count() > 0
    assert {n for n, _ in seen} == {str(sized.partitions)} and "portfolio_snapshot" in {name for _, name in seen}
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    monkeypatch.setattr(registered, "_book", lambda spark, folder: sized)
    registered.queries()["bucketed_events"](spark, small)
    assert spark.sql("SHOW TABLES").count() >= 3
    names = [r.tableName for r in spark.sql("SHOW TABLES").collect() if r.tableName.endswith("payment_schedule")]
    details = [r.data_type for n in names for r in spark.sql(f"DESCRIBE FORMATTED {n}").where("col_name = 'Num Buckets'").collect()]
    assert str(sized.partitions) in details
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f.rsplit("/", 1)[-1] for f in files.split("\n") if "/shuffle_" in f}


def test_jobs_of_a_book_leave_no_shuffle_files(spark, small, tmp_path):
    """Neither where the session has partitions enough nor where it gets more."""
    book = OrdersBook(spark, small)
    names = (orders_book._PARTITIONS, orders_book._MERGED_SIZE, orders_book._RELEASED)
    before, known = [spark.conf.get(name) for name in names], shuffle_files(spark)
    for partitions in (1, 20):
        book.partitions = partitions
        with book.sized():
            counts = book._table("lineitem", orders_book._LINES).repartition(4, "l_suppkey").groupBy("l_partkey").count()
            storage.write_table(counts, str(tmp_path / f"counts-{partitions}"))
            assert counts.count() > 0
        until = time.time() + 20
        while (left := shuffle_files(spark) - known) and time.time() < until:
            time.sleep(0.2)
        assert not left
        assert [spark.conf.get(name) for name in names] == before


def test_a_refresh_keeps_no_work_tables(spark, small, tmp_path):
    """Nor does an append; what is kept in touched buckets and what is computed anew make up the mart."""
    root, folder = str(tmp_path / "book"), str(tmp_path / "mart")
    book = OrdersBook(spark, small).book
    tables = {name: df for name, df in book.tables().items() if name in mart.SOURCES}
    for rows in ("RUN1", "RUN2"):
        storage.append_batch(LoanBook(**{name: df.where(F.col(RUN_KEY) == rows) for name, df in tables.items()}), root)
        mart.refresh_snapshot(spark, root, folder, buckets=3)
    stored = LoanBook(**{name: df.where(F.col(RUN_KEY).isin("RUN1", "RUN2")) for name, df in tables.items()})
    whole = portfolio_snapshot(stored.loan_contracts, stored.payment_schedule, stored.payments, stored.delinquency_events)
    got = mart.read_mart(spark, folder).select(whole.columns)
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()
    assert not list(tmp_path.glob("mart/work/*")) and not list(tmp_path.glob("book/_refused/*/*"))
