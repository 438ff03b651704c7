"""The contract mart kept up to date as loads come in.

The mart lies in buckets of the contract key.  A refresh finds the contracts that new loads
touch, computes the mart rows of these alone and rewrites the buckets that they are in; all
other buckets are carried over unread.  A version of the mart counts once its list of
buckets is written, so readers see the old mart until then, and a refresh that died is
simply done again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loanbook.operators.snapshot import portfolio_snapshot
from loanbook.schemas import TABLES
from loanbook.sources.storage import CODEC, FEW_KEYS, exists, load_rows, loads, read_book, remove, write_table

SOURCES = ("loan_contracts", "payment_schedule", "payments", "delinquency_events")
_VERSIONS = "versions"
_VERSION_SCHEMA = "version long, bucket int, folder string, loads array<string>"


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did: the loads it took in, the contracts it computed, the buckets it rewrote."""

    loads: tuple[str, ...]
    contracts: int
    buckets: tuple[int, ...]


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("loan_contract_id"), F.lit(buckets)).cast("int").alias("bucket")


def _latest(spark: SparkSession, mart: str) -> list:
    """The list of the newest version: one row per bucket with rows."""
    path = f"{mart}/{_VERSIONS}"
    if not exists(spark, path):
        return []
    versions = spark.read.schema(_VERSION_SCHEMA).parquet(path)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == newest).collect()


def read_mart(spark: SparkSession, mart: str) -> DataFrame:
    folders = sorted({row.folder for row in _latest(spark, mart) if row.folder})
    if not folders:
        raise FileNotFoundError(f"{mart} has no mart; refresh it first")
    return spark.read.parquet(*folders)


def refresh_snapshot(spark: SparkSession, root: str, mart: str, buckets: int = 64) -> Refreshed:
    """Bring the mart at ``mart`` up to the loads stored at ``root``.

    ``buckets`` is fixed by the first refresh; later ones must name the same number.
    """
    old = _latest(spark, mart)
    known = set(old[0].loads) if old else set()
    listed = loads(spark, root).where(F.col("table_name").isin(*SOURCES)).select("load_id").distinct()
    new = sorted(row.load_id for row in listed.collect() if row.load_id not in known)
    if not new:
        return Refreshed((), 0, ())
    version = uuid.uuid4().hex
    work = f"{mart}/work/{version}"
    book, added = read_book(spark, root).tables(), load_rows(spark, root, new)
    schedule = book["payment_schedule"].select("payment_schedule_id", "loan_contract_id")
    touched = [added[name].select("loan_contract_id") for name in SOURCES[:2] if name in added]
    facts = [added[name].select("payment_schedule_id") for name in SOURCES[2:] if name in added]
    earlier = load_rows(spark, root, sorted(known)).get("payment_schedule") if known else None
    if facts and earlier is not None:
        # Contracts of new instalments are known; those of earlier ones are looked up once for all new facts.
        instalments = reduce(DataFrame.unionByName, facts).distinct()
        touched.append(earlier.join(instalments, "payment_schedule_id", "left_semi").select("loan_contract_id"))
    if not touched:
        # Facts alone, and no instalments before them.
        touched = [schedule.limit(0).select("loan_contract_id")]
    contracts = reduce(DataFrame.unionByName, touched).where("loan_contract_id IS NOT NULL").distinct()
    contracts = write_table(contracts, f"{work}/contracts")
    many = contracts.count()
    # At most one row per bucket.
    changed = sorted(row.bucket for row in contracts.select(_bucket(buckets)).distinct().collect())

    facts = [book[name] if name in book else spark.createDataFrame([], TABLES[name].schema) for name in SOURCES[2:]]
    if many <= FEW_KEYS // 10:
        # Other rows go before they move; where much is touched, the mart's own joins leave them out.
        schedule = schedule.join(F.broadcast(contracts), "loan_contract_id", "left_semi")
        schedule = write_table(schedule, f"{work}/schedule")
        if schedule.count() <= FEW_KEYS:
            keys = F.broadcast(schedule.select("payment_schedule_id"))
            facts = [df.join(keys, "payment_schedule_id", "left_semi") for df in facts]
    fresh = portfolio_snapshot(book["loan_contracts"].join(contracts, "loan_contract_id", "left_semi"), schedule, *facts)
    written, path = [fresh], f"{mart}/{version}"
    kept = [row.folder for row in old if row.bucket in changed]
    if kept:
        before = spark.read.schema(fresh.schema).parquet(*kept)
        written.append(before.join(contracts, "loan_contract_id", "left_anti"))
    # A bucket is written in as many parts as the session's partitions allow, one file each.
    parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // (len(changed) or 1))
    part = F.pmod(F.xxhash64("loan_contract_id", F.lit(1)), F.lit(parts))
    for rows in written:
        # One after the other, so that the shuffle files of one lie on disk at a time.
        rows = rows.withColumn("bucket", _bucket(buckets)).repartition(parts * (len(changed) or 1), "bucket", part)
        rows.write.mode("append").partitionBy("bucket").parquet(path, compression=CODEC)
    remove(spark, work)

    number, taken = (old[0].version if old else 0) + 1, sorted(known | set(new))
    now = [(number, row.bucket, row.folder, taken) for row in old if row.bucket not in changed]
    # A touched instalment whose contract is not stored yet makes no row, and its bucket no folder.
    now += [(number, b, f"{path}/bucket={b}", taken) for b in changed if exists(spark, f"{path}/bucket={b}")]
    now = now or [(number, None, None, taken)]
    spark.createDataFrame(now, _VERSION_SCHEMA).coalesce(1).write.mode("append").parquet(f"{mart}/{_VERSIONS}")
    return Refreshed(tuple(new), many, tuple(changed))


