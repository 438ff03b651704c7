"""Archives: exact round trip, revisits, byte ranges that cover what is selected."""

import hashlib
import zlib

import compare
import duckdb
from pyarrow import fs
from pyspark.sql import functions as F

from loanbook.llm import warc
from loanbook.llm.queries import ORACLE, op4_warc

PAGES = "page_id long, url string, html string"


def test_pages_match_sql(spark, small):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
        assert compare.assert_same(op4_warc(spark, small), c, ORACLE["op4_warc"]) == 50


def test_round_trip(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    copies = pages.withColumn("page_id", F.col("page_id") + 1000)
    index, root = warc.archive_pages(spark, pages.unionByName(copies))
    html = {r.page_id: r.html.encode() for r in pages.collect()}
    got = {r.page_id: r for r in warc.read_records(index, root).collect()}
    assert len(got) == 2 * len(html)
    for page, payload in html.items():
        assert bytes(got[page].payload) == payload and got[page].record_type == "response"
        assert got[page + 1000].refers_to == page and got[page + 1000].payload is None
    # Archives are plain sequences of gzip members at the listed offsets.
    system, folder = fs.FileSystem.from_uri(root)
    for row in index.limit(20).collect():
        with system.open_input_file(f"{folder}/{row.archive}") as file:
            fields, _ = warc.parse(zlib.decompress(file.read_at(row.length, row.offset), 31))
        assert fields["WARC-Payload-Digest"] == "sha256:" + row.digest


def test_selected_ranges(spark, small):
    index, root = warc.archive_pages(spark, spark.read.parquet(f"{small}/pages.parquet"))
    chosen = index.where("page_id % 7 = 0")
    reads = warc.byte_ranges(chosen, gap=1000, most=20000).collect()
    members = sorted((r.archive, m["offset"], m["length"]) for r in reads for m in r.members)
    assert members == sorted((r.archive, r.offset, r.length) for r in chosen.collect())
    assert all(r.members[-1]["offset"] // 20000 == r.members[0]["offset"] // 20000 for r in reads)
    assert {r.page_id for r in warc.read_records(chosen, root).collect()} == {i for i in range(50) if i % 7 == 0}


def test_odd_rows(spark):
    long = "ü" * 200
    rows = [
        (5, "http://a", long), (3, "http://b\r\nX: y", long), (3, None, long), (None, "http://c", long),
        (7, "", None), (8, "u", ""), (9, "u", "short"), (10, "u", "short"), (None, None, None),
        (11, "big", "x\r\n\r\n" * 400000), (5, "other", "z" * 100), (4, "other", "z" * 100), (3, "q", "y" * 99),
    ]
    df = spark.createDataFrame(rows, PAGES).withColumns({"digest": F.lit(1), "archive": F.lit(2), "payload": F.lit(3)})
    got = sorted(map(str, warc.page_records(spark, df).collect()))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [
        (5, 400, digest(long), "revisit", 3), (3, 400, digest(long), "response", None),
        (3, 400, digest(long), "response", None), (None, 400, digest(long), "revisit", 3),
        (7, 0, digest(""), "response", None), (8, 0, digest(""), "response", None),
        (9, 5, digest("short"), "response", None), (10, 5, digest("short"), "response", None),
        (None, 0, digest(""), "response", None),
        (11, 2000000, digest("x\r\n\r\n" * 400000), "response", None), (5, 100, digest("z" * 100), "revisit", 4),
        (4, 100, digest("z" * 100), "response", None), (3, 99, digest("y" * 99), "response", None),
    ]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert got == sorted(f"Row({', '.join(f'{n}={v!r}' for n, v in zip(names, w))})" for w in want)
    assert warc.page_records(spark, df.limit(0)).collect() == []
