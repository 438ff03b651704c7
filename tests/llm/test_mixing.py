"""Mixing: targets by clamping in rounds, words near them, whole documents, repeatable."""

from collections import Counter, defaultdict
from fractions import Fraction

import compare
import duckdb
from pyspark.sql import functions as F

from loanbook.llm.mixing import mix_documents, mix_table
from loanbook.llm.queries import ORACLE, op3_mixing

DOCUMENTS = "doc_id long, text string, source string"


def clamped_in_rounds(sizes, weights, share, epochs):
    total, fixed = Fraction(share) * sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        targets = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        above = {s for s in open_ if targets[s] > epochs * sizes[s]}
        if not above:
            return {**fixed, **targets}
        fixed |= {s: Fraction(epochs * sizes[s]) for s in above}
        if len(fixed) == len(sizes):
            return fixed


def verify(rows):
    """No source misses its target by more than half its longest document."""
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    expected = clamped_in_rounds(sizes, weights, 1.5, 2)
    for s in sizes:
        assert all(r.source_size == sizes[s] for r in rows if r.source == s)
        assert abs(target[s] - float(expected[s])) < 1e-6 * max(1, sizes[s])
        assert abs(taken[s] - target[s]) <= max(r.size for r in rows if r.source == s) / 2 + 1e-6


def test_documents(spark, small):
    rows = op3_mixing(spark, small).collect()
    verify(rows)
    assert Counter(rows) == Counter(op3_mixing(spark, small).collect())


def test_sql(spark, small):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
        assert compare.assert_same(op3_mixing(spark, small), c, ORACLE["op3_mixing"]) == 200


def test_hot_source_and_odd_rows(spark):
    rows = [(i, "w " * (i % 13), "hot" if i % 3 else f"s{i % 5}") for i in range(40000)]
    rows += [(None, "a b", None), (50000, None, None), (50001, "", "empty"), (7, "w " * 7, "hot")]
    df = spark.createDataFrame(rows, DOCUMENTS).withColumns({"size": F.lit(1), "key": F.lit("x"), "row": F.lit(2)})
    mixed = mix_table(df).collect()
    assert len(mixed) == len(rows)
    verify(mixed)
    copies = mix_documents(df)
    assert copies.columns == df.columns
    taken = {(r.doc_id, r.source): r.taken for r in mixed if r.size and r.doc_id != 7}
    seen = Counter((r.doc_id, r.source) for r in copies.collect())
    size = {(r.doc_id, r.source): r.size for r in mixed}
    assert all(seen[k] * size[k] == v for k, v in taken.items())
    assert mix_table(df.limit(0)).collect() == [] and mix_documents(df.limit(0)).collect() == []


def test_all_sources_clamped(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y")], DOCUMENTS)
    rows = mix_table(df, share=3.0).collect()
    assert all(r.taken == 2 * r.size for r in rows)


def test_repeated_and_null_ids(spark):
    """Sources of one id, or of none, come near their targets as well, with rows alike or not."""
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(i % 9))
    rows = [(7, words(i), "one id") for i in range(1000)] + [(None, words(i), "no id") for i in range(1000)]
    rows += [(i, words(i), f"s{i % 4}") for i in range(3000)] + [(8, "a b c", "one text")] * 900 + [(9, "", "one text")] * 5
    df = spark.createDataFrame(rows, DOCUMENTS).withColumn("row", F.col("doc_id"))
    mixed = mix_table(df).collect()
    assert len(mixed) == len(rows)
    verify(mixed)
    assert Counter(mixed) == Counter(mix_table(df.repartition(5)).collect())
    taken = defaultdict(int)
    for r in mixed:
        taken[r.source] += r.taken
    got, often = defaultdict(int), Counter()
    for r in mix_documents(df).collect():
        got[r.source] += len(r.text.split())
        often[tuple(r)] += 1
    assert {s: n for s, n in got.items() if n} == {s: n for s, n in taken.items() if n}
    given = Counter((*r, r[0]) for r in rows)
    assert all(n <= 2 * given[r] for r, n in often.items())
    one = {r for r in often if r[2] == "one id"}
    assert len(one) > 100
    with duckdb.connect() as c:
        documents = df.toArrow()
        c.register("documents", documents)
        compare.assert_same(mix_table(df), c, ORACLE["op3_mixing"])
