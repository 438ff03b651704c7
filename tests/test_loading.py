"""Loading: compared loads, keys of batches, dense keys, and rules at load time."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loanbook.book import LoanBook
from loanbook.functions.fingerprint import batch_keys
from loanbook.plans import inspect
from loanbook.schemas import RUN_KEY, TABLES, TEXT_LIMITS
from loanbook.sources import loading, storage
from loanbook.sources.defects import damaged_book
from loanbook.sources.keys import with_dense_keys
from loanbook.sources.loading import gate, load_batch, load_terms
from loanbook.sources.orders_book import OrdersBook

CUSTOMER = (
    "customer_id long, first_name string, last_name string, middle_name string, birth_date date, sex string,"
    " occupation string, city string, country string, address string, customer_status string, created_at timestamp,"
    " run_key string"
)


def customers(spark, keys, run="R", name="Ann"):
    day = dt.date(1980, 1, 1)
    rows = [(k, name, "B", None, day, "other", None, "C", "D", "E", "active", dt.datetime(2001, 1, 1), run) for k in keys]
    return LoanBook(customers=spark.createDataFrame(rows, CUSTOMER))


def applications(spark, rows):
    values = [(k, c, dt.datetime(2001, 1, 1), "auto_loan", 5, 12, None, 0, None, "approved", "R") for k, c in rows]
    schema = (
        "loan_application_id long, customer_id long, application_date timestamp, loan_type string, requested_amount int,"
        " requested_term_months int, expected_interest_rate int, down_payment int, asset_value int,"
        " application_status string, run_key string"
    )
    return spark.createDataFrame(values, schema)


def forget_files(root, load_id):
    """Make any look at a load's files an error, without removing them from the list."""
    for file in root.glob(f"customers/load_id={load_id}/*.parquet"):
        file.write_bytes(b"not to be opened")


def load_ids(spark, root):
    return {r.low: r.load_id for r in storage.loads(spark, root).collect()}


def test_only_loads_that_may_hold_a_key_are_opened(spark, tmp_path):
    root = str(tmp_path / "book")
    for first in (0, 1000, 2000):
        assert storage.append_batch(customers(spark, range(first + 1, first + 51)), root)[0].added == 50
    ids = load_ids(spark, root)
    late = customers(spark, [1050, 1060, 1061])
    report = storage.append_batch(late, root)[0]
    assert (report.added, report.refused, report.opened) == (2, 1, (ids[1001],))
    # In the range of the first load, but of none of its keys' hashes.
    bits = int.from_bytes(storage.loads(spark, root).where("low = 1").first().key_bits)
    spread = customers(spark, [-5, 700])
    assert bits
    assert storage.append_batch(spread, root)[0].opened == ()
    for load_id in ids.values():
        forget_files(tmp_path / "book", load_id)
    fresh = storage.append_batch(customers(spark, range(5000, 5010)), root)[0]
    assert (fresh.added, fresh.refused, fresh.opened) == (10, 0, ())
    with pytest.raises(Exception):
        storage.append_batch(customers(spark, [1, 9000]), root)


def test_pruning_changes_no_count(spark, tmp_path):
    reports = []
    for prune in (True, False):
        root = str(tmp_path / f"book-{prune}")
        found = []
        for keys in (range(1, 40), range(100, 140), [1, 39, 40, 41, 120, 121, 99], range(30, 110), [7] * 5 + [500] * 3):
            found += [(r.added, r.refused) for r in storage.append_batch(customers(spark, keys), root, prune=prune)]
        stored = storage.read_book(spark, root).customers
        reports.append((found, sorted(r.customer_id for r in stored.collect())))
    assert reports[0] == reports[1]
    assert reports[0][0][2] == (3, 4) and reports[0][0][4] == (1, 7)


def test_repeated_keys_store_the_same_row_each_time(spark, tmp_path):
    names = set()
    for n in range(3):
        rows = customers(spark, [1], name="Ann").customers.unionByName(customers(spark, [1], name="Bob").customers)
        storage.append_batch(LoanBook(customers=rows.repartition(n + 1, "first_name")), str(tmp_path / str(n)))
        names |= {r.first_name for r in storage.read_book(spark, str(tmp_path / str(n))).customers.collect()}
    assert len(names) == 1


def test_rows_without_a_key_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="2 rows without customer_id"):
        storage.append_batch(customers(spark, [1, None, None]), str(tmp_path / "book"))
    assert not (tmp_path / "book" / "loads").exists()


def test_a_batch_is_recognised_whatever_its_order(spark, tmp_path):
    root = str(tmp_path / "book")
    book = customers(spark, range(1, 200))
    storage.append_batch(book, root)
    forget_files(tmp_path / "book", load_ids(spark, root)[1])
    again = LoanBook(customers=book.customers.repartition(7).sort(F.desc("customer_id")))
    assert [(r.added, r.refused, r.opened) for r in storage.append_batch(again, root)] == [(0, 199, ())]


def test_batch_keys_follow_content_alone(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("run"), F.when(F.col("id") % 7 > 0, "x").alias("t"))
    day = dt.date(2001, 8, 15)

    def keys(df):
        return {r.run: r.batch_key for r in batch_keys(df, "run", day).collect()}

    first = keys(rows)
    assert keys(rows.repartition(9).sort(F.desc("id"))) == first
    assert all(k.startswith("20010815-") for k in first.values()) and len(set(first.values())) == 3
    twice = keys(rows.unionByName(rows.where("id = 1")).unionByName(rows.where("id = 1")))
    assert twice[1] != first[1] and twice[0] == first[0]
    assert keys(rows.withColumn("t", F.coalesce("t", F.lit("")))) != first


def test_dense_keys(spark, tmp_path):
    rows = spark.range(1000).repartition(7).withColumn("x", F.col("id") * 2)
    keyed = with_dense_keys(rows, str(tmp_path), "key", first=11)
    found = {r.id: r.key for r in keyed.collect()}
    assert sorted(found.values()) == list(range(11, 1011))
    assert {r.id: r.key for r in keyed.repartition(3).collect()} == found
    assert with_dense_keys(rows.limit(0), str(tmp_path), "key").collect() == []
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Python" not in plan


def test_batches_numbered_alike_are_all_stored(spark, small, tmp_path):
    root, terms = str(tmp_path / "book"), OrdersBook(spark, small).terms
    first = terms.where(F.col(RUN_KEY) == "RUN1").limit(40).withColumn("row_no", F.row_number().over(_by_number()))
    second = terms.where(F.col(RUN_KEY) == "RUN2").limit(30).withColumn("row_no", F.row_number().over(_by_number()))
    first, second = storage.write_table(first, f"{root}/1"), storage.write_table(second, f"{root}/2")
    when = dt.datetime(2001, 8, 15)
    for batch, size in ((first, 40), (second, 30)):
        assert {r.added for r in load_terms(batch, root, when) if r.table != "loan_collateral"} == {size}
    assert {(r.added, r.refused) for r in load_terms(first.repartition(5), root, when) if r.table == "customers"} == {(0, 40)}
    stored = storage.read_book(spark, root)
    assert sorted(r.customer_id for r in stored.customers.collect()) == list(range(1, 71))
    joined = stored.loan_contracts.join(stored.loan_applications, "loan_application_id").join(stored.customers, "customer_id")
    assert joined.count() == 70
    orphans = stored.loan_collateral.join(stored.loan_contracts, "loan_contract_id", "left_anti")
    assert orphans.isEmpty() and stored.loan_collateral.count() > 0


def _by_number():
    from pyspark.sql import Window

    return Window.partitionBy(RUN_KEY).orderBy("row_no")


def test_every_rule_is_at_work(spark, small, tmp_path):
    gated = gate(damaged_book(OrdersBook(spark, small).book), str(tmp_path))
    found = {(r.table_name, rule) for r in gated.quarantine.collect() for rule in r.rules}
    rules = {
        (name, rule)
        for name, t in TABLES.items()
        for rule in [*(c.name for c in t.checks), *(u.name for u in t.uniques), *(r.name for r in t.references)]
    }
    assert rules <= found and len(rules) == 50 + 17 + 11
    assert {rule.split(":")[0] for _, rule in found} >= {"not_null", "width"}
    assert {t for t, rule in found if rule.startswith("width")} <= set(TEXT_LIMITS)


def test_children_follow_their_parents_and_stored_rows_count(spark, tmp_path):
    root = str(tmp_path / "book")
    storage.append_batch(customers(spark, [1]), root)
    book = customers(spark, [2, 3, 3]).with_tables(loan_applications=applications(spark, [(10, 1), (11, 2), (12, 3), (13, 4)]))
    lost = book.customers.withColumn("sex", F.when(F.col("customer_id") != 2, F.col("sex")))
    report, refused = load_batch(book.with_tables(customers=lost), root, storage.read_book(spark, root))
    assert {r.table: r.added for r in report} == {"customers": 1, "loan_applications": 2}
    rows = [(r.table_name, tuple(r.rules), json.loads(r.row)) for r in refused.collect()]
    assert sorted((t, rules, row.get("loan_application_id", row["customer_id"])) for t, rules, row in rows) == [
        ("customers", ("customers_pkey",), 3), ("customers", ("not_null:sex",), 2),
        ("loan_applications", ("fk_loan_application_customer",), 11),
        ("loan_applications", ("fk_loan_application_customer",), 13),
    ]


def test_a_clean_batch_passes_whole(spark, small, tmp_path):
    book = OrdersBook(spark, small).batch
    gated = gate(book, str(tmp_path))
    assert gated.quarantine.isEmpty()
    assert gated.accepted.loan_collateral.exceptAll(book.loan_collateral).isEmpty()
    assert gated.accepted.customers.count() == book.customers.count()


def test_the_gate_broadcasts_no_keys_of_the_batch(spark, small, tmp_path, monkeypatch):
    written = []

    def noted(df, path):
        written.append(inspect.physical_plan(df))
        return storage.write_table(df, path)

    monkeypatch.setattr(loading, "write_table", noted)
    book = damaged_book(OrdersBook(spark, small).batch)
    gated = gate(book, str(tmp_path))
    written += [inspect.physical_plan(df) for df in (gated.quarantine, *gated.accepted.tables().values())]
    assert not any("Broadcast" in plan for plan in written) and any("SortMergeJoin" in plan for plan in written)
    copies = book.customers.unionByName(book.customers)
    rows = gated.accepted.customers.unionByName(gated.accepted.customers)
    twice = gate(LoanBook(customers=copies), str(tmp_path)).accepted.customers
    assert twice.count() * 2 == rows.count() and twice.exceptAll(gated.accepted.customers).isEmpty()


def test_the_gate_leaves_only_judged_tables_and_shuffles_one_rule_at_a_time(spark, small, tmp_path, monkeypatch):
    plans = []

    def noted(df, path):
        plans.append(inspect.physical_plan(df))
        return storage.write_table(df, path)

    monkeypatch.setattr(loading, "write_table", noted)
    book = damaged_book(OrdersBook(spark, small).batch)
    gated = gate(book, str(tmp_path))
    (folder,) = tmp_path.iterdir()
    assert {p.name for p in folder.iterdir()} == {f"judged-{name}" for name in book.tables()}
    # Of a rule, keys and rows; of a table, its rows and the rules that they break.
    assert max(map(inspect.shuffles, plans)) == 2
    assert gated.accepted.customers.count() > 0 and gated.quarantine.count() > 0
