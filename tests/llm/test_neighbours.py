"""Neighbours: recall and exact scores against brute force, heap order, copies, odd rows."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanbook.llm import neighbours
from loanbook.llm.queries import op5_neighbours

VECTORS = "vec_id long, embedding array<float>"


def brute(ids, x, query, top=5):
    x = x.astype(np.float64)
    q = x[list(ids).index(query)]
    score = (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != query][:top]
    return [(int(ids[i]), score[i]) for i in order]


def recall(rows, ids, x, queries, top=5):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(queries)
    hits = total = 0
    exact = {q: brute(ids, x, q, len(ids)) for q in queries}
    for q in queries:
        scores = dict(exact[q])
        assert all(abs(scores[v] - s) < 1e-12 for v, s in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        hits += len({v for v, _ in got[q]} & {v for v, _ in exact[q][:top]})
        total += min(top, len(exact[q]))
    return hits / total


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall(spark, folder):
    path = f"/root/testdata/{folder}"
    table = spark.read.parquet(f"{path}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], dtype=np.float32)
    rows = op5_neighbours(spark, path).collect()
    assert recall(rows, ids, x, [int(i) for i in ids if i % 50 == 0]) >= 0.9


def test_walk_is_by_summed_distance():
    rng = np.random.default_rng(0)
    index = neighbours.MultiIndex(rng.normal(size=(6, 4)), rng.normal(size=(6, 4)))
    a, b = rng.random(6), rng.random(6)
    rows = rng.integers(0, 3, 36)
    visited = index.walk(a, b, rows, 10**9)
    sums = (a[:, None] + b).ravel()
    assert visited == [c for c in np.argsort(sums) if rows[c]]
    some = index.walk(a, b, rows, 7)
    assert visited[: len(some)] == some and rows[some].sum() >= 7 > rows[some[:-1]].sum()


def test_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=8).tolist()
    rows = [(i, hot) for i in range(400)] + [(i, rng.normal(size=8).tolist()) for i in range(400, 900)]
    odd = [
        (1000, None), (1050, []), (1100, [0.0] * 8), (1150, [1.0, None] * 4), (1200, [float("nan")] * 8),
        (1250, [float("inf")] * 8), (1300, [1.0] * 7), (None, hot), (450, rows[450][1]),
    ]
    df = spark.createDataFrame(rows + odd, VECTORS).withColumns({"k1": F.lit(1), "cell": F.lit(2), "score": F.lit("s")})
    got = neighbours.search(df, "vec_id % 50 = 0", share=1.0).collect()
    ids, x = np.arange(900), np.array([r[1] for r in rows], dtype=np.float32)
    assert recall(got, ids, x, list(range(0, 900, 50))) == 1.0
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [1, 2, 3, 4, 5]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 50] == [0, 1, 2, 3, 4]


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], VECTORS)
    got = neighbours.search(df, "vec_id = 0", share=1.0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2]
    assert neighbours.search(df.limit(1), "vec_id = 0").collect() == []
    assert neighbours.search(df.limit(0), "vec_id = 0").collect() == []
    one = spark.createDataFrame([(0, [1.0]), (1, [-2.0]), (2, [3.0])], VECTORS)
    assert [r.vec_id for r in neighbours.search(one, "vec_id = 0", share=1.0).orderBy("rank").collect()] == [2, 1]


def test_small_tables_give_all_candidates(spark):
    for n in (4, 5, 6):
        df = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(n)], VECTORS)
        got = neighbours.search(df, "vec_id = 0").collect()
        assert sorted(r.vec_id for r in got) == list(range(1, n))


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PACK_ROWS", 20)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    got = neighbours.search(df, "vec_id % 50 = 0", share=1.0).collect()
    assert recall(got, np.arange(600), x, list(range(0, 600, 50))) == 1.0


def heap_order(a, b, rows, wanted):
    """Cells with rows in the order in which a heap over pairs of centroids meets them."""
    first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, met = [(a[first[0]] + b[second[0]], 0, 0)], {(0, 0)}, []
    while heap and wanted > 0:
        _, i, j = heapq.heappop(heap)
        cell = int(first[i] * len(second) + second[j])
        if rows[cell]:
            met.append(cell)
            wanted -= int(rows[cell])
        for k, m in ((i + 1, j), (i, j + 1)):
            if k < len(first) and m < len(second) and (k, m) not in seen:
                seen.add((k, m))
                heapq.heappush(heap, (a[first[k]] + b[second[m]], k, m))
    return met


@pytest.mark.parametrize("steps", [3, 10**6])
def test_visited_cells_are_those_of_a_heap(steps):
    """Also where many sums are equal."""
    rng = np.random.default_rng(7)
    index = neighbours.MultiIndex(rng.normal(size=(9, 4)), rng.normal(size=(7, 4)))
    for wanted in (0, 1, 5, 40, 80, 10**9):
        a, b = rng.integers(0, steps, 9) / steps, rng.integers(0, steps, 7) / steps
        rows = rng.integers(0, 4, 63)
        met = heap_order(a, b, rows, wanted)
        assert index.walk(a, b, rows, wanted) == met
        filled = np.flatnonzero(rows)
        assert set(filled[index.visited(a, b, filled, rows[filled], wanted)]) == set(met)


def clustered(spark, many=900, copies=300):
    """Random vectors, and one of them under many more ids: a cell of a third of all rows."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(many, 6)).astype(np.float32)
    x = np.concatenate((x, x[:1] + rng.normal(size=(copies, 6)).astype(np.float32) / 100))
    return np.arange(len(x)), x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)


def test_a_task_is_given_one_vector_a_row(spark, monkeypatch):
    """Queries move once for each part that they visit, not for each cell, and neither they nor rows in packs."""
    ids, x, df = clustered(spark)
    taken, rank = [], neighbours._rank
    monkeypatch.setattr(neighbours, "_rank", lambda moved, *rest: taken.append((moved, rest)) or rank(moved, *rest))
    neighbours.search(df, "vec_id % 2 = 0", share=1.0)
    ((moved, (parts, _)),) = taken
    lists = [f.name for f in moved.schema.fields if f.dataType.typeName() == "array"]
    assert all(moved.agg(F.max(F.size(c))).first()[0] == 6 for c in lists)
    assert moved.count() == len(ids) * (1 + len(parts) / 2) and len(parts) < 2 * neighbours.LEAST_PARTS


def test_only_the_list_of_parts_is_broadcast(spark):
    """Also under a limit that all of this small table is below: estimates of what grows are not relied on."""
    _, _, df = clustered(spark)
    found = neighbours.search(df, "vec_id % 2 = 0")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("BroadcastExchange") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_many_parts_give_what_one_gives(spark, monkeypatch):
    ids, x, df = clustered(spark)
    one = sorted(neighbours.search(df, "vec_id % 40 = 0").collect())
    monkeypatch.setattr(neighbours, "PART_BYTES", 6 * 4 * 50)
    monkeypatch.setattr(neighbours, "PACK_QUERIES", 7)
    monkeypatch.setattr(neighbours, "PACK_ROWS", 9)
    assert sorted(neighbours.search(df, "vec_id % 40 = 0").collect()) == one
    got = neighbours.search(df, "vec_id % 40 = 0", share=1.0).collect()
    assert recall(got, ids, x, list(range(0, 1200, 40))) == 1.0


def test_parts_hold_bounded_rows_and_all_of_them():
    parts = neighbours.Parts.of(np.array([1, 4, 5, 8, 9, 11]), np.array([3, 4, 25, 2, 9, 10]), 10)
    assert parts.first.tolist() == [0, 0, 1, 4, 5, 6] and parts.span.tolist() == [1, 1, 3, 1, 1, 1]
    assert len(parts) == 7 and parts.places() == [(0, 2), (2, 3), (2, 3), (2, 3), (3, 4), (4, 5), (5, 6)]


@pytest.mark.parametrize("few", [0, 100])
def test_repeated_vectors_keep_their_smallest_ids(spark, monkeypatch, few):
    """Merged or sent out; a row that repeats id and vector counts once."""
    monkeypatch.setattr(neighbours, "FEW_KEYS", few)
    rows = [(i % 40, [1.0, float(i % 2)]) for i in range(100)] + [(7, [3.0, 1.0]), (7, [3.0, 1.0]), (8, [5.0, 1.0])]
    kept, total = neighbours._kept(neighbours.usable(spark.createDataFrame(rows, VECTORS)), 4)
    got = sorted((r.vec_id, r.embedding) for r in kept.collect())
    assert got == sorted([(i, [1.0, float(i % 2)]) for i in range(8)] + [(7, [3.0, 1.0]), (8, [5.0, 1.0])])
    assert total == len(got)
