
from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from loanbook.book import LoanBook
from loanbook.functions.calendar import midnight
from loanbook.functions.fingerprint import batch_keys
from loanbook.operators import (
    constraints, lifecycle, monitoring, normalise, payments, quality, segmentation, sketches, summary, validation,
)
from loanbook.operators.rolling import roll_delinquency_events
from loanbook.operators.snapshot import portfolio_snapshot
from loanbook.schemas import RUN_KEY, TABLES
from loanbook.sources.bucketed import write_bucketed
from loanbook.sources.defects import damaged_book, damaged_snapshot
from loanbook.sources.keys import with_dense_keys
from loanbook.sources.loading import gate, load_terms
from loanbook.sources.mart import SOURCES, read_mart, refresh_snapshot
from loanbook.sources.orders_book import AS_OF, OrdersBook
from loanbook.sources.storage import append_batch, file_state, read_book, shared_folder, write_table

try:
    import corpus_pipeline
    from loanbook.llm import queries as llm
except ImportError:  # also where a library that only the subpackage needs is not there
    llm = corpus_pipeline = None

_BOOKS: dict[tuple, OrdersBook] = {}


def _book(spark: SparkSession, sf_dir: str) -> OrdersBook:
    """The book of one folder.  Its stored tables are written once per application and state of its files."""
    key = (spark.sparkContext.applicationId, sf_dir, file_state(spark, sf_dir, ["orders", "lineitem", "customer"]))
    if key not in _BOOKS:
        _BOOKS[key] = OrdersBook(spark, sf_dir)
    return _BOOKS[key]


def entry(spark: SparkSession) -> DataFrame:
    """Headline figures of the smallest book: what is at risk today?"""
    book = _book(spark, "/root/testdata/sf0.001")
    return monitoring.portfolio_kpis(book.snapshot, AS_OF)


@cache
def _damaged(b: OrdersBook) -> LoanBook:
    return damaged_book(b.book)


def _generated_columns(b: OrdersBook) -> DataFrame:
    """Each generated column, computed from the columns it is defined over."""
    generated = [
        ("payment_schedule", "total_due", lifecycle.with_total_due(b.schedule.drop("total_due"))),
        ("payments", "payment_amount", lifecycle.with_payment_amount(b.payments.drop("payment_amount"))),
        (
            "delinquency_events",
            "penalty_amount",
            lifecycle.with_penalty_amount(b.delinquency_events.drop("penalty_amount")),
        ),
    ]
    parts = [
        df.select(
            F.lit(table).alias("table_name"),
            F.lit(column).alias("column_name"),
            F.col(TABLES[table].key).alias("row_id"),
            F.col(column).alias("amount"),
        )
        for table, column, df in generated
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _apply_defaults(b: OrdersBook) -> DataFrame:
    """Contracts that arrive without a number, and half of them without a status."""
    arriving = b.contracts.drop("contract_number").withColumn(
        "contract_status", F.when(F.col("loan_contract_id") % 2 != 0, F.col("contract_status"))
    )
    filled = lifecycle.apply_defaults(arriving, "loan_contracts", midnight(F.lit(AS_OF)))
    return filled.select("loan_contract_id", "contract_number", "contract_status")


def _refreshed_mart(b: OrdersBook) -> DataFrame:
    """The mart after three loads and a refresh behind each: two runs, the others without late facts, and these."""
    root = _folder(b)
    early, late = F.col(RUN_KEY).isin("RUN1", "RUN2"), F.col("payment_schedule_id") % 3 == 0
    tables = {name: df for name, df in b.book.tables().items() if name in SOURCES}
    facts = [name for name in tables if name in ("payments", "delinquency_events")]
    batches = [
        {name: df.where(early) for name, df in tables.items()},
        {name: df.where(~early & ~late if name in facts else ~early) for name, df in tables.items()},
        {name: tables[name].where(~early & late) for name in facts},
    ]
    for batch in batches:
        append_batch(LoanBook(**batch), f"{root}/book")
        refresh_snapshot(b.spark, f"{root}/book", f"{root}/mart", buckets=16)
    return read_mart(b.spark, f"{root}/mart")


@cache
def _bucketed(b: OrdersBook) -> LoanBook:
    """The book with its instalment tables in as many buckets as the session shuffles to."""
    return write_bucketed(b.book, _folder(b), int(b.spark.conf.get("spark.sql.shuffle.partitions")))


def _bucketed_snapshot(b: OrdersBook) -> DataFrame:
    book = _bucketed(b)
    return portfolio_snapshot(
        book.loan_contracts, book.payment_schedule, book.payments, book.delinquency_events, bucketed=True
    )


def _bucketed_events(b: OrdersBook) -> DataFrame:
    book = _bucketed(b)
    return lifecycle.derive_delinquency_events(book.payment_schedule, book.payments, b.as_of).drop(RUN_KEY)


def _bucketed_installments(b: OrdersBook) -> DataFrame:
    book = _bucketed(b)
    return payments.classify_installments(book.payment_schedule, book.payments, b.as_of)


def _roll_events(b: OrdersBook) -> DataFrame:
    """Events of the reporting day, rolled there from half a year before in two steps, each of them stored."""
    root, days = _folder(b), [b.as_of - dt.timedelta(days=n) for n in (180, 60, 0)]
    paid, known = F.col("payment_date"), b.payments.where(F.col("payment_date") <= days[0])
    events = write_table(lifecycle.derive_delinquency_events(b.schedule, known, days[0]), f"{root}/{days[0]}")
    for since, today in zip(days, days[1:]):
        new = b.payments.where((paid > since) & (paid <= today))
        rolled = roll_delinquency_events(events, b.schedule, b.payments.where(paid <= since), new, since, today)
        events = write_table(rolled, f"{root}/{today}")
    return events.drop(RUN_KEY)


def _median_sketches(b: OrdersBook) -> DataFrame:
    """Are the medians merged from the sketches of all runs within their rank error?"""
    medians = sketches.median_resolution(sketches.resolution_sketches(b.delinquency_events))
    errors = sketches.rank_of_median(medians, b.delinquency_events)
    return errors.select("dpd_bucket", "closed_events", (F.col("rank_error") <= 0.015).alias("within_error"))


_DERIVED_TERMS = [
    RUN_KEY, "row_no", "down_payment", "asset_value", "probability_of_default", "months_on_book", "due_installments",
    "maturity_date", "contract_status", "closed_date", "decision_type",
]


def _normalise_batch(b: OrdersBook) -> DataFrame:
    """Rows and key range of every table the batch is split into."""
    parts = [
        df.agg(
            F.count("*").alias("table_rows"),
            F.min(TABLES[name].key).alias("first_key"),
            F.max(TABLES[name].key).alias("last_key"),
        ).select(F.lit(name).alias("table_name"), "table_rows", "first_key", "last_key")
        for name, df in b.batch.tables().items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _folder(b: OrdersBook) -> str:
    root = shared_folder(b.spark)
    if root is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return root


def _append_batch(b: OrdersBook) -> DataFrame:
    """Load one run without most of its payments, then all runs; count what is stored and what was refused."""
    root = _folder(b)
    book = b.book.with_tables(
        **{name: normalise.normalise_table(b.terms, name, b.loaded_at) for name in ("loan_collateral", "loan_disbursements")}
    )
    first = {name: df.where(F.col(RUN_KEY) == "RUN1") for name, df in book.tables().items()}
    first["payments"] = first["payments"].where(F.col("payment_id") % 10 == 2)
    append_batch(LoanBook(**first), root)
    report = append_batch(book, root)
    refused = b.spark.createDataFrame([(r.table, r.refused) for r in report], "table_name string, refused_rows long")
    stored = read_book(b.spark, root).tables()
    parts = [
        df.groupBy(RUN_KEY).agg(F.count("*").alias("stored_rows")).select(F.lit(name).alias("table_name"), RUN_KEY, "stored_rows")
        for name, df in stored.items()
    ]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return counts.join(refused, "table_name")


def _load_two_batches(b: OrdersBook) -> DataFrame:
    """Two batches that both number their rows from 1, and the first of them once more: what is stored, under which keys."""
    root = _folder(b)
    early = F.col(RUN_KEY).isin("RUN1", "RUN2")
    batches = [
        with_dense_keys(part.drop("row_no"), f"{root}/delivered", "row_no")
        for part in (b.terms.where(early), b.terms.where(~early))
    ]
    for batch in [*batches, batches[0].repartition(3)]:
        load_terms(batch, root, b.loaded_at)
    counts, totals = [], []
    for name, df in read_book(b.spark, root).tables().items():
        key, table = F.col(TABLES[name].key), F.lit(name).alias("table_name")
        # Which contracts have collateral depends on the batch, not on its keys.
        low, high = (F.when(F.lit(name != "loan_collateral"), f(key)) for f in (F.min, F.max))
        counts.append(df.groupBy(RUN_KEY).agg(F.count("*").alias("stored_rows")).select(table, RUN_KEY, "stored_rows"))
        totals.append(
            df.agg(
                F.count("*").alias("table_rows"), F.countDistinct(key).alias("table_keys"), low.alias("low_key"),
                high.alias("high_key"),
            ).select(table, "table_rows", "table_keys", "low_key", "high_key")
        )
    return reduce(DataFrame.unionByName, counts).join(reduce(DataFrame.unionByName, totals), "table_name")


def _load_gate(b: OrdersBook) -> DataFrame:
    """What the rules keep out of a damaged batch: rows per table and rule, and how many pass."""
    gated = gate(_damaged(b), _folder(b))
    rules = gated.quarantine.select("table_name", F.explode("rules").alias("rule"))
    counts = rules.groupBy("table_name", "rule").agg(F.count("*").alias("rows"))
    for name, df in gated.accepted.tables().items():
        passed = df.agg(F.count("*").alias("rows"))
        counts = counts.unionByName(passed.select(F.lit(name).alias("table_name"), F.lit("accepted").alias("rule"), "rows"))
    return counts


_QUERIES: dict[str, Callable[[OrdersBook], DataFrame]] = {
    # Mart
    "portfolio_snapshot": lambda b: b.snapshot,
    # Portfolio monitoring
    "portfolio_kpis": lambda b: monitoring.portfolio_kpis(b.snapshot, b.as_of),
    "refreshed_mart": _refreshed_mart,
    "mart_summary": lambda b: summary.mart_summary(b.snapshot, b.as_of),
    "dpd_bucket_summary": lambda b: monitoring.dpd_bucket_summary(b.snapshot),
    # Risk segmentation
    "risk_by_score_band": lambda b: segmentation.risk_by_score_band(b.contracts, b.scores, b.snapshot),
    "risk_by_loan_size": lambda b: segmentation.risk_by_loan_size(b.snapshot),
    "risk_by_months_on_book": lambda b: segmentation.risk_by_months_on_book(b.snapshot, b.as_of),
    "high_risk_watchlist": lambda b: segmentation.high_risk_watchlist(b.snapshot, b.contracts, b.scores),
    "high_risk_watchlist_top": lambda b: segmentation.high_risk_watchlist(b.snapshot, b.contracts, b.scores, top=100),
    # The same on tables in buckets of the instalment key
    "bucketed_snapshot": _bucketed_snapshot,
    "bucketed_events": _bucketed_events,
    "bucketed_installments": _bucketed_installments,
    # Payment behaviour
    "classify_installments": lambda b: payments.classify_installments(b.schedule, b.payments, b.as_of),
    "monthly_payment_performance": lambda b: payments.monthly_payment_performance(b.schedule, b.payments, b.as_of),
    "delinquency_resolution": lambda b: payments.delinquency_resolution(b.delinquency_events, b.as_of),
    "median_resolution_sketch": _median_sketches,
    "early_delinquency_analysis": lambda b: payments.early_delinquency_analysis(
        b.contracts, b.schedule, b.delinquency_events
    ),
    # Quality of the mart
    "dq_balance_consistency": lambda b: quality.balance_consistency(damaged_snapshot(b.snapshot)),
    "dq_contract_status_consistency": lambda b: quality.contract_status_consistency(b.snapshot),
    "dq_snapshot_completeness": lambda b: quality.snapshot_completeness(b.contracts, damaged_snapshot(b.snapshot)),
    "dq_snapshot_grain": lambda b: quality.snapshot_grain(damaged_snapshot(b.snapshot)),
    # Validation of a load
    "batch_entity_counts": lambda b: validation.batch_entity_counts(
        b.contracts, b.schedule, b.payments, b.delinquency_events
    ),
    "contract_status_counts": lambda b: validation.contract_status_counts(b.contracts),
    "open_dpd_distribution": lambda b: validation.open_dpd_distribution(
        b.contracts, b.schedule, b.delinquency_events
    ),
    # Integrity of the tables
    "audit_checks": lambda b: constraints.audit_checks(_damaged(b)),
    "audit_foreign_keys": lambda b: constraints.audit_foreign_keys(_damaged(b)),
    "audit_uniqueness": lambda b: constraints.audit_uniqueness(_damaged(b)),
    "audit_not_null": lambda b: constraints.audit_not_null(_damaged(b)),
    "audit_text_lengths": lambda b: constraints.audit_text_lengths(_damaged(b)),
    # Table lifecycle
    "generated_columns": _generated_columns,
    "apply_defaults": _apply_defaults,
    "build_payment_schedule": lambda b: lifecycle.build_payment_schedule(b.contracts).drop(RUN_KEY),
    "derive_delinquency_events": lambda b: b.delinquency_events.drop(RUN_KEY),
    "roll_events": _roll_events,
    "derive_contract_terms": lambda b: b.terms.select(*_DERIVED_TERMS),
    "normalise_batch": _normalise_batch,
    "append_batch": _append_batch,
    "batch_key": lambda b: batch_keys(b.terms.select(*_DERIVED_TERMS), RUN_KEY, b.as_of),
    "load_two_batches": _load_two_batches,
    "load_gate": _load_gate,
}


def _normalised(table: str) -> Callable[[OrdersBook], DataFrame]:
    return lambda b: normalise.normalise_table(b.terms, table, b.loaded_at).drop(RUN_KEY)


_QUERIES.update(
    {
        f"normalise_{table}": _normalised(table)
        for table in [
            "customers", "customer_income", "income_verifications", "loan_applications", "application_scores",
            "application_decisions", "loan_contracts", "loan_collateral", "loan_disbursements",
        ]
    }
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def registered(build: Callable[[OrdersBook], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            book = _book(spark, sf_dir)
            with book.sized():
                return build(book)

        return query

    found = {name: registered(build) for name, build in _QUERIES.items()}
    if llm is not None:
        found |= llm.QUERIES | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    from oracle.reports import ORACLE

    found = {name: ORACLE[name] for name in _QUERIES if name in ORACLE}
    if llm is not None:
        found |= llm.ORACLE
    return found
