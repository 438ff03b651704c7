"""Instalments, payments and delinquency events laid out in buckets of the instalment key.

The three tables share the number of buckets and the order within them, so that joins and
aggregations on ``payment_schedule_id`` read bucket by bucket and move no row.  The rows of
an instalment lie in one bucket; where single instalments hold a large part of all payments,
plain tables, whose skewed partitions Spark splits, serve better.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from loanbook.book import LoanBook
from loanbook.sources.storage import CODEC

BUCKET_KEY = "payment_schedule_id"
BUCKETED = ("payment_schedule", "payments", "delinquency_events")


def write_bucketed(book: LoanBook, root: str, buckets: int, prefix: str | None = None) -> LoanBook:
    """Store the three tables under ``root`` as tables of the catalog; the others stay as they are.

    Size ``buckets`` so that a bucket of the largest table fits a task, as with shuffle
    partitions.  ``prefix`` begins the tables' names in the catalog; without one it is new,
    so that two books of a session stay apart.
    """
    prefix = prefix or f"book_{uuid.uuid4().hex}_"
    for name in BUCKETED:
        rows = book.tables()[name]
        (
            # One task per bucket writes one file per bucket.
            rows.repartition(buckets, BUCKET_KEY)
            .write.format("parquet")
            .option("compression", CODEC)
            .bucketBy(buckets, BUCKET_KEY)
            .sortBy(BUCKET_KEY)
            .option("path", f"{root.rstrip('/')}/{name}")
            .saveAsTable(prefix + name)
        )
    return read_bucketed(rows.sparkSession, book, prefix)


def read_bucketed(spark: SparkSession, book: LoanBook, prefix: str) -> LoanBook:
    return book.with_tables(**{name: spark.table(prefix + name) for name in BUCKETED})
