"""WARC archives of web pages: written once, indexed per record, read back by byte range.

Writing: tasks append gzip members, one per record, to archives of their own in a folder
all executors share and return the index rows (offset, length, URL, digest) of what they
wrote.  Archive names are unique per attempt, and the index is a table that Spark commits:
an archive of a lost or repeated attempt is never listed, so it is never read.

Reading: the selected index rows are sorted by archive and offset, and neighbours are
coalesced into byte ranges of bounded size; each range is one read.

Of records with equal payloads one is a response and the others are revisits that refer to
it and carry no payload.  Short payloads are always stored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loanbook.llm.storage import shared_folder, stored

INDEX_SCHEMA = (
    "page_id long, url string, digest string, record_type string, archive string, `offset` long, `length` long"
)
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload binary, digest string"
_DATE = "2024-01-01T00:00:00Z"
_GZIP = 31  # zlib window bits for a gzip member
_ID = "urn:page:"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; ``refers_to`` makes it a revisit without payload."""
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", _DATE),
        ("Content-Type", "text/html; charset=utf-8"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to is not None:
        payload = b""
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", f"<{_ID}{refers_to}>"))
    fields.append(("Content-Length", str(len(payload))))
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record, checked against its length and digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    payload = rest[:size]
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} has a wrong length")
    if fields["WARC-Type"] == "response":
        if "sha256:" + hashlib.sha256(payload).hexdigest() != fields["WARC-Payload-Digest"]:
            raise ValueError(f"record {fields['WARC-Record-ID']} has a wrong digest")
    return fields, payload


def _page(reference: str | None) -> int | None:
    number = re.fullmatch(rf"<{_ID}(-?\d+)>", reference or "")
    return int(number[1]) if number else None


def decide(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which record each page becomes.

    Only digests that occur more than once are joined back; equal payloads are combined
    before the shuffle, and the join splits a digest that most rows share.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select(F.col("digest").alias("_digest"), "first")
    )
    joined = rows.join(first, rows["digest"] == first["_digest"], "left")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(later, F.col("first")).alias("refers_to"))


def write_archives(
    spark: SparkSession, records: DataFrame, root: str, archive_bytes: int = 256 << 20, level: int = 6
) -> DataFrame:
    """Write (page_id, url, payload, digest, refers_to) rows under ``root``; return the stored index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(root)
        system.create_dir(f"{folder}/archives", recursive=True)
        part = TaskContext.get().partitionId()
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for values in zip(*batch.columns):
                    row = {name: value.as_py() for name, value in zip(batch.schema.names, values)}
                    if out is None or offset >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"archives/{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    packer = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                    data = packer.compress(record(**row)) + packer.flush()
                    out.write(data)
                    kind = "response" if row["refers_to"] is None else "revisit"
                    rows.append((row["page_id"], row["url"], row["digest"], kind, name, offset, len(data)))
                    offset += len(data)
                if rows:
                    yield _batch(rows, _INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    records.mapInArrow(run, INDEX_SCHEMA).write.parquet(f"{root}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{root}/index")


_INDEX_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()),
        ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ]
)
_RECORD_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload", pa.binary()), ("digest", pa.string()),
    ]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(column, type=field.type) for column, field in zip(columns, schema)], schema=schema
    )


def byte_ranges(selected: DataFrame, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """Coalesce index rows into (archive, members) reads.

    Members are the sorted (offset, length) of records less than ``gap`` bytes apart.  A
    read is cut when it would pass a multiple of ``most`` bytes in its archive, so that
    its size is bounded whatever is selected.
    """
    along = Window.partitionBy("archive").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(along)
    last_slice = F.lag(F.floor(F.col("offset") / most)).over(along)
    starts = before.isNull() | (F.col("offset") - before > gap) | (F.floor(F.col("offset") / most) != last_slice)
    return (
        selected.select("archive", "offset", "length")
        .withColumn("starts", starts.cast("int"))
        .withColumn("read", F.sum("starts").over(along))
        .groupBy("archive", "read")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("members"))
        .select("archive", "members")
    )


def read_records(selected: DataFrame, root: str) -> DataFrame:
    """The records of index rows, by coalesced byte-range reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            for archive, members in zip(batch.column("archive"), batch.column("members")):
                wanted = members.as_py()
                first = wanted[0]["offset"]
                with system.open_input_file(f"{folder}/{archive.as_py()}") as file:
                    data = file.read_at(wanted[-1]["offset"] + wanted[-1]["length"] - first, first)
                rows = []
                for member in wanted:
                    at = member["offset"] - first
                    fields, payload = parse(zlib.decompress(data[at : at + member["length"]], _GZIP))
                    kind = fields["WARC-Type"]
                    rows.append(
                        (
                            _page(fields["WARC-Record-ID"]),
                            fields.get("WARC-Target-URI"),
                            kind,
                            _page(fields.get("WARC-Refers-To")),
                            payload if kind == "response" else None,
                            fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                        )
                    )
                yield _batch(rows, _RECORD_ARROW)

    return byte_ranges(selected).mapInArrow(run, RECORD_SCHEMA)


def archive_pages(spark: SparkSession, pages: DataFrame, least_bytes: int = 100) -> tuple[DataFrame, str]:
    """Write every row of ``pages`` (page_id, url, html); return the index and its folder.

    Null html is an empty payload and a null URL a record without target.  A null page_id
    is a record without number: nothing refers to it, and it revisits a numbered one.  Rows
    that repeat the smallest page_id of equal payloads are all responses.  An empty table
    gives an empty index.  Other columns are ignored.
    """
    root = shared_folder(spark, "warc")
    return write_archives(spark, decide(pages, least_bytes), root), root


def page_records(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages, read all records back and resolve revisits to the payload they refer to."""
    index, root = archive_pages(spark, pages)
    read = stored(
        read_records(index, root).select(
            "page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("stored_bytes")
        ),
        "warc-records",
    )
    targets = (
        read.where("record_type = 'response' AND page_id IS NOT NULL")
        .groupBy(F.col("page_id").alias("target"), F.col("digest").alias("target_digest"))
        .agg(F.max("stored_bytes").alias("target_bytes"))
    )
    same = (read["refers_to"] == targets["target"]) & (read["digest"] == targets["target_digest"])
    return read.join(targets, same, "left").select(
        "page_id",
        F.coalesce("stored_bytes", "target_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
first AS (SELECT html, min(page_id) AS first FROM sized WHERE strlen(html) >= 100 GROUP BY html)
SELECT s.page_id, CAST(strlen(s.html) AS BIGINT) AS payload_bytes, sha256(s.html) AS payload_digest,
       CASE WHEN f.first <> s.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> s.page_id THEN f.first END AS refers_to
FROM sized s LEFT JOIN first f ON s.html = f.html
"""
