"""Licences: variants of known texts are found, changed ones are not; the SQL agrees."""

import compare
import duckdb
from pyspark.sql import functions as F

from loanbook.llm import licences
from loanbook.llm.queries import ORACLE, op6_licences

DOCUMENTS = "doc_id long, text string"
BODY = dict((name, text) for name, text in licences.KNOWN_TEXTS if "\n" in text)


def test_documents_match_sql(spark, small):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
        assert compare.assert_same(op6_licences(spark, small), c, ORACLE["op6_licences"]) == 200


def test_variants(spark):
    mit, bsd = BODY["MIT"], BODY["BSD-3-Clause"]
    rows = [
        (1, mit), (2, mit.upper()), (3, "Copyright (c) 2020 A. Person\n\n" + mit.replace("\n", "\r\n")),
        (4, "  // © 2001-2003 X\n * Copyright 1999 Y\n" + mit.replace("\n", "\n * ")),
        (5, mit.replace("sublicense", "sub-licence").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")),
        (6, mit.replace("free of charge", "for a charge")), (7, mit + "\nNo warranty."),
        (8, "Copyright (c) 2009, Z\nAll rights reserved.\n\n" + bsd.replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS")),
        (9, "Some prose.\nlicensed under the APACHE licence, version 2.0\nMore prose. Released under the MIT License."),
        (10, "All rights reserved.\n  released under the mit licence  \nReleased under the MIT License."),
        (11, "All rights reserved."), (12, None), (13, ""), (14, "\n \n"), (15, "x\n" * 100000), (None, mit), (1, mit),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS).withColumns({"licence": F.lit(1), "line": F.lit(2), "id": F.lit(3)})
    got = licences.scan_licences(df)
    whole = sorted((str(r.doc_id), r.licence) for r in got.collect() if r.licence)
    assert whole == sorted(
        [(str(i), "MIT") for i in (1, 1, 2, 3, 4, 5, None)] + [("8", "BSD-3-Clause"), ("11", "All-Rights-Reserved")]
    )
    named = {r.doc_id: r.line_licences for r in got.collect()}
    assert named[9] == "Apache-2.0" and named[10] == "All-Rights-Reserved MIT" and named[6] == named[12] == ""
    assert got.count() == len(rows)
    digests = {r.doc_id: r.text_digest for r in got.collect()}
    assert digests[12] == digests[13] == digests[14]
    assert licences.scan_licences(df.limit(0)).collect() == []
    with duckdb.connect() as c:
        c.register("documents", df.select("doc_id", "text").toArrow())
        assert compare.assert_same(got, c, licences.oracle()) == len(rows)
