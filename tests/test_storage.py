"""Appending batches and staying clear of other runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanbook.book import LoanBook
from loanbook.operators import normalise, validation
from loanbook.schemas import RUN_KEY, TABLES
from loanbook.sources import storage
from loanbook.sources.orders_book import OrdersBook


@pytest.fixture(scope="module")
def batch(spark, small):
    return OrdersBook(spark, small).batch


def only(book: LoanBook, *runs: str) -> LoanBook:
    return LoanBook(**{name: df.where(F.col(RUN_KEY).isin(*runs)) for name, df in book.tables().items()})


def counts(spark, root):
    return {
        name: dict(map(tuple, df.groupBy(RUN_KEY).count().collect()))
        for name, df in storage.read_book(spark, root).tables().items()
    }


def totals(report):
    return {r.table: (r.added, r.refused) for r in report}


def test_runs_accumulate_and_rows_are_stored_once(spark, batch, tmp_path):
    root = str(tmp_path / "book")
    report = totals(storage.append_batch(only(batch, "RUN1"), root))
    first = counts(spark, root)
    assert set(first) == set(batch.tables()) and set(first["customers"]) == {"RUN1"}
    assert report == {name: (c["RUN1"], 0) for name, c in first.items()}
    again = totals(storage.append_batch(only(batch, "RUN1"), root))
    assert again == {name: (0, c["RUN1"]) for name, c in first.items()}
    assert counts(spark, root) == first
    storage.append_batch(only(batch, "RUN1", "RUN2"), root)
    second = counts(spark, root)
    assert {name: c["RUN1"] for name, c in second.items()} == {name: c["RUN1"] for name, c in first.items()}
    assert set(second["loan_contracts"]) == {"RUN1", "RUN2"}


def test_late_rows_of_a_known_run_are_stored(spark, batch, tmp_path):
    root = str(tmp_path / "book")
    rows = only(batch, "RUN1").customers
    early, late = rows.where("customer_id % 2 = 0"), rows.where("customer_id % 2 = 1")
    storage.append_batch(LoanBook(customers=early, loan_contracts=only(batch, "RUN1").loan_contracts), root)
    assert totals(storage.append_batch(LoanBook(customers=late), root)) == {"customers": (late.count(), 0)}
    assert totals(storage.append_batch(LoanBook(customers=rows), root)) == {"customers": (0, rows.count())}
    assert storage.read_book(spark, root).customers.count() == rows.count()


def test_a_run_without_contracts_is_stored(spark, batch, tmp_path):
    root = str(tmp_path / "book")
    other = only(batch, "RUN2").customers
    storage.append_batch(LoanBook(loan_contracts=only(batch, "RUN1").loan_contracts, customers=other), root)
    assert storage.read_book(spark, root).customers.count() == other.count()


def test_rows_without_a_run_are_refused_as_a_whole(spark, batch, tmp_path):
    root = str(tmp_path / "book")
    broken = batch.customers.withColumn(RUN_KEY, F.when(F.col("customer_id") != 1, F.col(RUN_KEY)))
    with pytest.raises(ValueError, match="1 rows without"):
        storage.append_batch(batch.with_tables(customers=broken), root)
    with pytest.raises(FileNotFoundError):
        storage.read_book(spark, root)


def test_unfinished_load_is_never_seen(spark, batch, tmp_path):
    root = str(tmp_path / "book")
    run = only(batch, "RUN3")
    # What a load that died after its first table leaves behind, with half of the rows and a stale one.
    run.customers.sample(0.5, seed=1).write.parquet(f"{root}/customers/load_id=dead")
    with pytest.raises(FileNotFoundError):
        storage.read_book(spark, root)
    storage.append_batch(run, root)
    stored = storage.read_book(spark, root).customers
    assert stored.count() == run.customers.count() == stored.select("customer_id").distinct().count()


def test_plain_tables_are_read_without_a_run_key(spark, batch, tmp_path):
    root = str(tmp_path / "plain")
    batch.customers.drop(RUN_KEY).write.parquet(f"{root}/customers")
    batch.loan_contracts.drop(RUN_KEY).write.parquet(f"{root}/loan_contracts.parquet")
    book = storage.read_tables(spark, root)
    assert set(book.tables()) == {"customers", "loan_contracts"}
    assert book.customers.count() == batch.customers.count() and RUN_KEY not in book.customers.columns


def test_stored_tables_keep_declared_types(spark, batch, tmp_path):
    root = str(tmp_path / "book")
    storage.append_batch(only(batch, "RUN4"), root)
    for name, df in storage.read_book(spark, root).tables().items():
        declared = {f.name: f.dataType for f in TABLES[name].schema.fields}
        assert {f.name: f.dataType for f in df.schema.fields if f.name != RUN_KEY} == declared


def test_keys_are_stable_and_offset(spark, small):
    terms = OrdersBook(spark, small).terms
    when = dt.datetime(2001, 8, 15)
    once = normalise.normalise_table(terms.repartition(5), "loan_contracts", when)
    again = normalise.normalise_table(terms.repartition(3), "loan_contracts", when)
    assert once.exceptAll(again).isEmpty()
    moved = normalise.normalise_table(terms, "customers", when, key_offset=10_000)
    assert moved.agg(F.min("customer_id")).first()[0] >= 10_000


def test_shared_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    folder = storage.shared_folder(spark)
    assert folder.startswith(base if base else "/")


def test_views(spark, batch, small):
    batch.register_views("batch_")
    assert spark.sql("SELECT count(*) FROM batch_customers").first()[0] == batch.customers.count()
    whole = OrdersBook(spark, small)
    whole.book.register_views("whole_")
    assert spark.sql("SELECT * FROM whole_portfolio_snapshot").exceptAll(whole.snapshot).isEmpty()


def test_status_counts_ordered(spark, batch):
    found = [r.contracts for r in validation.contract_status_counts(batch.loan_contracts).collect()]
    assert found == sorted(found, reverse=True)
