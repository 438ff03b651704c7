"""Hard negatives: bounds that hold, exact results, SQL and odd rows."""

import math

import compare
import duckdb
import numpy as np
from pyspark.sql import functions as F

from loanbook.llm import hard_negatives as H
from loanbook.llm.queries import ORACLE, op12_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10):
    usable = {}
    for vec_id, vector, label in rows:
        if vec_id is not None and label is not None and vector and all(v is not None and math.isfinite(v) for v in vector):
            ints = tuple(math.floor(256 * float(np.float32(v))) for v in vector)
            usable[vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, ints] = 1
    lengths = [len(v) for _, _, v in usable]
    usable = [r for r in usable if len(r[2]) == max(lengths, key=lambda n: (lengths.count(n), n))]
    out = []
    for anchor, label, a in usable:
        if anchor % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v)), i, own == label) for i, own, v in usable if i != anchor]
        for best, positive, _ in sorted(s for s in scored if s[2])[:positives]:
            fits = sorted(s for s in scored if not s[2] and -30 * best <= -100 * s[0] <= -90 * best)[:negatives]
            out += [(anchor, positive, n + 1, i, -best, -s) for n, (s, i, _) in enumerate(fits)]
    return sorted(out)


def got(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert df.columns == names
    return sorted(tuple(r) for r in df.collect())


def test_intervals_hold_and_narrow():
    rng = np.random.default_rng(1)
    for size in (1, 3, 64, 100, 130):
        rows = rng.integers(-200, 200, (500, size))
        rows[:3] = np.array([[0], [1], [-256]])
        anchors = np.concatenate((rng.integers(-200, 200, (20, size)), rows[:5]))
        codes = H.Codes.of(rows)
        for anchor, coded in zip(anchors, H.Anchor.all(anchors)):
            low, high = coded.interval(codes)
            exact = H.scores(rows, anchor)
            assert (low <= exact).all() and (exact <= high).all()
            if size == 64:
                scale = codes.lengths * coded.length
                assert np.median((high - low)[3:] / np.maximum(scale[3:], 1)) < 0.25


def test_scores_beyond_doubles():
    rows = np.array([[(1 << 26) + 1, 3], [-5, 1 << 26]])
    assert H.scores(rows, rows[0]).tolist() == [((1 << 26) + 1) ** 2 + 9, -5 * ((1 << 26) + 1) + 3 * (1 << 26)]


def test_filter_spares_work():
    """Few of the rows are scored as whole numbers."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(rng.standard_normal((20_000, 64)))).astype(np.int64)
    part = H.Part(0)
    ids, labels = np.arange(len(x)), np.sort(np.arange(len(x)) % 10)
    part.chunks = [(ids, labels, x, H.Codes.of(x))]
    scored = []
    plain = H.scores
    pack = H.Pack(ids[:50], ids[:50], labels[:50], x[:50], [], H.Anchor.all(x[:50]))
    try:
        H.scores = lambda rows, a: scored.append(len(rows)) or plain(rows, a)
        list(H.positives_in(part, pack, 5))
    finally:
        H.scores = plain
    assert sum(scored) < 50 * 2_000 * 0.2


def test_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = got(op12_negatives(spark, small))
    assert found == brute(rows) and found
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
        assert compare.assert_same(op12_negatives(spark, small), c, ORACLE["op12_negatives"]) == len(found)


def test_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 5) / 4], int(rng.integers(3))) for i in range(700)]
    rows += [(800, [1.0, 1.0, 1.0, 1.0, 1.0], 1)] * 3 + [(800 + i, [1.0, 1.0, 1.0, 1.0, 0.9], i % 2) for i in range(1, 60)]
    rows += [(900, None, 1), (901, [1.0] * 5, None), (902, [1.0, None, 1.0, 1.0, 1.0], 1), (None, [1.0] * 5, 1)]
    rows += [(1000, [float("nan")] * 5, 1), (1001, [float("inf")] * 5, 0), (1002, [1.0] * 6, 0), (1003, [], 0)]
    rows += [(1100, [0.0] * 5, 1), (1200, [1.0] * 5, 12), (-100, [0.5] * 5, 1), (300, [0.7, 0.1, 0.1, 0.1, 0.0], 2)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit("x"), "kind": F.lit(1), "key": F.lit(None)})
    want = brute(rows)
    assert got(H.mine(frame, "vec_id % 100 = 0")) == want
    monkeypatch.setattr(H, "PART_ROWS", 64)
    monkeypatch.setattr(H, "CHUNK_ROWS", 16)
    monkeypatch.setattr(H, "PACK_ANCHORS", 2)
    assert got(H.mine(frame, "vec_id % 100 = 0")) == want


def test_few_and_no_rows(spark):
    assert got(H.mine(spark.createDataFrame([], SCHEMA), "vec_id % 100 = 0")) == []
    few = [(0, [1.0, 0.0], 1), (100, [0.9, 0.1], 2), (1, [1.0, 0.5], 2), (2, [0.5, 0.5], 1)]
    assert got(H.mine(spark.createDataFrame(few, SCHEMA), "vec_id % 100 = 0")) == brute(few)
