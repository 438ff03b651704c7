"""Lending tables as Parquet folders, one per table.

Rows are appended and never rewritten.  Each append is a load with an id of its own and
writes to folders of that id only; it counts once its tables stand in the list of loads,
written last.  Readers read the listed folders and nothing else, so what a load that died
left behind is never seen, and redoing it needs no clean-up.

One job looks at the keys of all offered tables: how many there are, whether they repeat,
their range, and a bitmap of their hashes.  The list keeps range and bitmap per load, so
that rows are compared only with loads that may hold one of their keys, and fresh keys with
none.  Then each table is written in one job, which counts its rows as it goes.  The list
also keeps a key made from the content of the batch, by which a batch that comes again is
recognised without a look at what is stored.

Rows whose key is stored already are refused and reported; all others are accepted,
whether their run is new or known.  Two loads that run at the same time do not see each
other's rows: load one batch from one place.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from loanbook.book import LoanBook, conform
from loanbook.functions.fingerprint import combined, fast_hashes, fingerprint
from loanbook.schemas import RUN_KEY, TABLES

_LOADS = "loads"
_LOAD_SCHEMA = T.StructType(
    [
        T.StructField("load_id", T.StringType(), False),
        T.StructField("table_name", T.StringType(), False),
        T.StructField("folder", T.StringType(), False),
        T.StructField("added", T.LongType(), False),
        T.StructField("low", T.LongType(), False),
        T.StructField("high", T.LongType(), False),
        T.StructField("key_bits", T.BinaryType(), False),
        T.StructField("batch_key", T.StringType(), False),
    ]
)
#: Bits of the map of hashed keys: a filter of a few thousand keys; beyond, ranges decide alone.
_KEY_BITS = 32_768
#: Tables of a load that are written at the same time.
_AT_ONCE = 4
#: Keys that are sent to every task; more are merged.
FEW_KEYS = 500_000
#: How stored tables are compressed: smaller than by default, and as quick to read.
CODEC = "zstd"


@dataclass(frozen=True)
class Appended:
    """What became of one table of a load, and the earlier loads its keys were compared with."""

    table: str
    added: int
    refused: int
    opened: tuple[str, ...] = ()


def stored_schema(table: str) -> T.StructType:
    """Declared columns plus the run key; stored files are read with this, never inferred."""
    columns = [T.StructField(f.name, f.dataType, True) for f in TABLES[table].schema.fields]
    return T.StructType(columns + [T.StructField(RUN_KEY, T.StringType(), True)])


def loads(spark: SparkSession, root: str) -> DataFrame:
    """One row per table of each completed load: its folder, rows, keys and batch key."""
    path = f"{root}/{_LOADS}"
    if not exists(spark, path):
        return spark.createDataFrame([], _LOAD_SCHEMA)
    return spark.read.schema(_LOAD_SCHEMA).parquet(path)


def highest_key(spark: SparkSession, root: str, tables: list[str]) -> int:
    """The highest key stored in any of the tables, 0 without rows; read from the list of loads alone."""
    found = loads(spark, root).where(F.col("table_name").isin(tables)).agg(F.max("high")).first()[0]
    return max(found or 0, 0)


def append_batch(book: LoanBook, root: str, batch_key: str | None = None, prune: bool = True) -> list[Appended]:
    """Store the rows of ``book`` whose keys are not stored yet, and report per table.

    Every row must have its key and name its run; otherwise nothing is stored and an error
    is raised.  Of rows that repeat a key within the batch, the one of the smallest hash is
    stored.  ``batch_key`` names the batch where its keys have no say, as when they are
    given anew on each load.  Without ``prune`` keys are compared with all loads.
    """
    tables = {name: conform(df, name) for name, df in book.tables().items()}
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if RUN_KEY not in df.columns:
            raise ValueError(f"{name} has no column {RUN_KEY}")
    offered = _offered_keys(tables)
    for name, keys in offered.items():
        if keys["unkeyed"]:
            raise ValueError(f"{name} has {keys['unkeyed']} rows without {TABLES[name].key}; nothing was stored")
    batch_key = batch_key or combined({name: (k["rows"], k["mixed"], k["summed"]) for name, k in offered.items()})
    if is_loaded(spark, root, batch_key):
        return [Appended(name, 0, offered[name]["rows"] if name in offered else 0) for name in tables]

    met, load_id = _overlapping(spark, root, offered, prune), uuid.uuid4().hex
    folder = f"load_id={load_id}"

    def write(name: str) -> dict:
        rows, key = tables[name], TABLES[name].key
        if offered[name]["rows"] > offered[name]["different"]:
            first = Window.partitionBy(key).orderBy(F.xxhash64(*rows.columns))
            rows = rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
        if name in met:
            known = _read(spark, root, name, [folder for _, folder in met[name]]).select(key)
            # Keys alone meet what is stored; whole rows move only where many of them are refused.
            again = write_table(rows.select(key).join(known, key, "left_semi").distinct(), f"{root}/_refused/{folder}/{name}")
            refused = again.count()
            if refused:
                again = F.broadcast(again) if refused <= FEW_KEYS else again.hint("merge")
                rows = rows.join(again, key, "left_anti").select(rows.columns)
        seen = Observation()
        metrics = [
            F.count("*").alias("rows"), F.count(RUN_KEY).alias("with_run"), F.min(key).alias("low"),
            F.max(key).alias("high"), F.bitmap_construct_agg(_key_bit(key)).alias("key_bits"),
        ]
        rows.observe(seen, *metrics).write.parquet(f"{root}/{name}/{folder}", compression=CODEC)
        return seen.get

    # Several tables at a time: small writes leave cores idle.
    with ThreadPoolExecutor(_AT_ONCE) as pool:
        written = dict(zip(offered, pool.map(write, offered)))
    remove(spark, f"{root}/_refused/{folder}")
    for name, seen in written.items():
        if seen["with_run"] < seen["rows"]:
            for table in written:
                remove(spark, f"{root}/{table}/{folder}")
            raise ValueError(f"{name} has {seen['rows'] - seen['with_run']} rows without {RUN_KEY}; nothing was stored")
    listed = [
        (load_id, name, folder, seen["rows"], seen["low"], seen["high"], bytearray(seen["key_bits"]), batch_key)
        for name, seen in written.items()
        if seen["rows"]
    ]
    if listed:
        spark.createDataFrame(listed, _LOAD_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/{_LOADS}")
    report = []
    for name in tables:
        added, rows = (written[name]["rows"], offered[name]["rows"]) if name in offered else (0, 0)
        report.append(Appended(name, added, rows - added, tuple(sorted(i for i, _ in met.get(name, [])))))
    return report


def is_loaded(spark: SparkSession, root: str, batch_key: str) -> bool:
    return not loads(spark, root).where(F.col("batch_key") == batch_key).isEmpty()


def _key_bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_KEY_BITS))


def _offered_keys(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """Of each table with rows: how many, without key, of different keys, and what sums the keys up.

    The keys of all tables are counted in one aggregation.
    """
    names = list(tables)
    stacked = [df.select(F.lit(i).alias("table"), F.col(TABLES[n].key).alias("key")) for i, (n, df) in enumerate(tables.items())]
    per_key = reduce(DataFrame.unionByName, stacked).groupBy("table", "key").agg(F.count("*").alias("n"))
    wide, narrow = fast_hashes(["key", "n"])
    found = per_key.groupBy("table").agg(
        F.sum("n").alias("offered"),
        F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("unkeyed"),
        F.count("key").alias("different"),
        F.min("key").alias("low"),
        F.max("key").alias("high"),
        F.bitmap_construct_agg(_key_bit("key")).alias("key_bits"),
        *fingerprint(wide, narrow)[1:],
    )
    rows = {names[r["table"]]: r.asDict() | {"rows": r["offered"]} for r in found.collect()}
    return {name: rows[name] for name in names if name in rows}


def _read(spark: SparkSession, root: str, table: str, folders: list[str]) -> DataFrame:
    return spark.read.schema(stored_schema(table)).parquet(*(f"{root}/{table}/{folder}" for folder in sorted(folders)))


def _overlapping(spark: SparkSession, root: str, offered: dict[str, dict], prune: bool) -> dict[str, list[tuple[str, str]]]:
    """Per table the (load, folder) that may hold one of the offered keys: ranges meet, and a hashed key is in both."""
    wanted = F.lit(False)
    for name, keys in offered.items():
        meets = (F.col("low") <= keys["high"]) & (F.col("high") >= keys["low"])
        wanted = wanted | ((F.col("table_name") == name) & (meets if prune else F.lit(True)))
    found: dict[str, list[tuple[str, str]]] = {}
    # One row per table and load in range, a few KB each.
    for row in loads(spark, root).where(wanted).select("table_name", "load_id", "folder", "key_bits").collect():
        common = int.from_bytes(row.key_bits) & int.from_bytes(offered[row.table_name]["key_bits"])
        if common or not prune:
            found.setdefault(row.table_name, []).append((row.load_id, row.folder))
    return found


def remove(spark: SparkSession, folder: str) -> None:
    path = _path(spark, folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_book(spark: SparkSession, root: str) -> LoanBook:
    """The rows of all completed loads.  A folder without a list of loads is an error."""
    if not exists(spark, f"{root}/{_LOADS}"):
        raise FileNotFoundError(f"{root} has no list of loads; read plain tables with read_tables")
    return LoanBook(**_read_loads(spark, root))


def load_rows(spark: SparkSession, root: str, load_ids: list[str]) -> dict[str, DataFrame]:
    """The rows that some loads added, per table."""
    folders: dict[str, list[str]] = {}
    for row in loads(spark, root).where(F.col("load_id").isin(*load_ids)).select("table_name", "folder").collect():
        folders.setdefault(row.table_name, []).append(row.folder)
    return {name: _read(spark, root, name, folders[name]) for name in TABLES if name in folders}


def read_tables(spark: SparkSession, root: str) -> LoanBook:
    """Plain tables, ``{root}/{table}`` or ``{root}/{table}.parquet``, in their declared types.

    Tables that are not there stay None; a run key is read where the files have one.
    """
    tables = {}
    for name in TABLES:
        for path in (f"{root}/{name}", f"{root}/{name}.parquet"):
            if exists(spark, path):
                tables[name] = conform(spark.read.parquet(path), name)
                break
    return LoanBook(**tables)


def _read_loads(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    # One row per table and load: as many as there were loads, not as there are rows.
    folders: dict[str, list[str]] = {}
    for row in loads(spark, root).select("table_name", "folder").collect():
        folders.setdefault(row.table_name, []).append(row.folder)
    return {name: _read(spark, root, name, folders[name]) for name in TABLES if name in folders}


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Store a frame and read it back, which ends its lineage at the files."""
    df.write.mode("overwrite").parquet(path, compression=CODEC)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str | None:
    """A folder every executor can reach, new on each call.

    It lies under the checkpoint folder the session names.  Where none is named a
    temporary folder serves a local session; a cluster gets None, since its
    machines do not share one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = f"{base.rstrip('/')}/loanbook-{uuid.uuid4().hex}"
        target = _path(spark, path)
        files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
        return path
    if spark.sparkContext.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="loanbook-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        return path
    return None


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = _path(spark, path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def file_state(spark: SparkSession, folder: str, tables: list[str]) -> tuple:
    """Path, size and time of change of the files of some tables: another state means other rows."""
    found = []
    for name in tables:
        table = _path(spark, f"{folder.rstrip('/')}/{name}.parquet")
        files = table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(table):
            found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files.listStatus(table)]
    return tuple(found)
