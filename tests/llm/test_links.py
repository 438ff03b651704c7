"""Components and bucket links against brute force on random graphs."""

from itertools import combinations

import numpy as np
import pytest

from pyspark.sql import functions as F

from loanbook.llm.links import components, link_buckets


def brute(nodes, edges):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(1)
    edges = {
        "random": [tuple(map(int, rng.integers(0, 120, 2))) for _ in range(80)],
        "chain": [(i, i + 1) for i in range(60)] + [(9, 9)],
        "star": [(500, i) for i in range(200)],
        "none": [],
    }[shape]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == brute({n for e in real for n in e}, real)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def run(spark, rows, sets, similarity, shown):
    """link_buckets over sets of numbers with their Jaccard similarity."""
    table = spark.createDataFrame([(n, sorted(s)) for n, s in sets.items()], "node long, parts array<long>")

    def verify(pairs):
        shown.append(pairs.count())
        one, other = table.toDF("a", "left"), table.toDF("b", "right")
        common = F.size(F.array_intersect("left", "right")) / F.size(F.array_union("left", "right"))
        return pairs.join(one, "a").join(other, "b").where(common >= similarity).select("a", "b")

    def features(nodes):
        return nodes.join(table, "node").select("node", F.explode("parts").alias("feature"), F.lit(1).alias("weight"))

    members = spark.createDataFrame(rows, "bucket long, node long")
    return {r.node: r.component for r in link_buckets(members, verify, features, similarity, "t").collect()}


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_bucket_links_lose_nothing(spark, similarity):
    """Every similar pair that shares a bucket ends in one component, and only similar ones do."""
    rng = np.random.default_rng(2)
    sets = {}
    for n in range(120):
        base = set(map(int, rng.integers(0, 3000, 40))) if n % 12 == 0 else sets[n - int(rng.integers(1, n % 12 + 1))]
        sets[n] = set(list(base)[int(rng.integers(0, 9)) :]) | set(map(int, rng.integers(0, 3000, rng.integers(0, 6))))
    rows = [(int(b), int(n)) for b in range(6) for n in rng.integers(0, 120, 80)] + [(7, 3), (8, 5)]
    rows += [(int(b), int(n)) for b in range(10, 20) for n in rng.integers(0, 120, 9)]
    got = run(spark, rows, sets, similarity, [])
    together = {tuple(sorted(p)) for b in range(20) for p in combinations({n for k, n in rows if k == b}, 2)}
    edges = {p for p in together if jaccard(sets[p[0]], sets[p[1]]) >= similarity}
    every = {p for p in combinations(range(120), 2) if jaccard(sets[p[0]], sets[p[1]]) >= similarity}
    want, most = brute({n for e in edges for n in e}, edges), brute(range(120), every)
    assert all(got[a] == got[b] for a, b in edges) and set(want) <= set(got)
    assert all(most[n] == most[c] for n, c in got.items())


def test_large_group_costs_few_comparisons(spark):
    """Copies with parts of their own: most near the original, the others near nothing."""
    rng = np.random.default_rng(4)
    base = list(range(100))
    sets = {0: set(base)}
    for n in range(1, 1500):
        gone = int(rng.integers(2, 9) if n % 3 else rng.integers(22, 40))
        sets[n] = set(rng.permutation(base)[gone:].tolist()) | {1000 * n + k for k in range(gone)}
    rows = [(b, n) for b in range(4) for n in sets] + [(100 + n, k) for n in range(1, 40) for k in (0, n)]
    shown = []
    got = run(spark, rows, sets, 0.8, shown)
    near = {n for n in sets if jaccard(sets[0], sets[n]) >= 0.8}
    assert near <= set(got) and {got[n] for n in near} == {0}
    assert shown[0] < 2 * 1500 and shown[1] <= 10 * 1500


def test_families_just_under_the_threshold_meet_seldom(spark):
    """Copies of one text that are far from each other, and some that are near another far one."""
    rng = np.random.default_rng(6)
    base, sets, families = list(range(100)), {0: set(range(100))}, {}
    for n in range(1, 1200):
        changed = int(rng.integers(6, 11) if n % 3 == 0 else rng.integers(12, 16))
        if n % 20 == 7:  # a later copy of a copy that is not linked to the original
            parent = n - 3 if n > 3 else 0
            kept = sorted(sets[parent])
            gone = set(rng.choice(kept, 4, replace=False).tolist())
            families[n] = parent
            sets[n] = (sets[parent] - gone) | {10_000 * n + k for k in range(4)}
        else:
            gone = rng.permutation(base)[:changed].tolist()
            sets[n] = (set(base) - set(gone)) | {10_000 * n + k for k in range(changed)}
    rows = [(b, n) for b in range(3) for n in sets] + [(100 + n, k) for n in range(1, 40) for k in (0, n)]
    shown = []
    got = run(spark, rows, sets, 0.8, shown)
    edges = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = brute(range(1200), edges)
    assert {n: c for n, c in want.items() if any(n in e for e in edges)} == got
    assert any(jaccard(sets[0], sets[n]) < 0.8 <= jaccard(sets[n], sets[p]) for n, p in families.items())
    # All pairs would be 720,000; those of nodes that are not linked to the original over 300,000.
    assert shown[1] <= 3 * 1200


def test_meetings_grow_with_the_group(spark):
    """Rows of the join itself, before equal pairs are merged, for a group and one twice as large."""
    from loanbook.llm.links import differences, meetings

    made = []
    for size in (400, 800):
        rng, rows = np.random.default_rng(7), [(0, f) for f in range(100)]
        for n in range(1, size):
            gone = set(rng.permutation(100)[:13].tolist())
            rows += [(n, f) for f in range(100) if f not in gone] + [(n, 1000 * n + k) for k in range(13)]
        weights = spark.createDataFrame(rows, "node long, feature long").withColumn("weight", F.lit(1))
        placed = spark.createDataFrame([(0, n, n) for n in range(size)], "leader long, node long, component long")
        made.append(meetings(differences(placed, weights, "t"), 0.8, "t").count())
    assert made[1] <= 2 * 800


def test_features_of_one_node_make_no_rows(spark):
    """Copies with many parts of their own: each such part was a row before, once for each leader."""
    from loanbook.llm.links import across_components, differences

    def group(size, own):
        rows = [(n, f) for n in (0, 1) for f in range(100)] + [(1, 99_999)]
        for n in range(2, size):
            gone = n % 3
            rows += [(n, f) for f in range(gone, 100)] + [(n, 1000 * n + k) for k in range(own)]
        placed = [(leader, n, n) for leader in (0, 1) for n in range(size)]
        weights = spark.createDataFrame(rows, "node long, feature long").withColumn("weight", F.lit(1))
        return spark.createDataFrame(placed, "leader long, node long, component long"), weights

    for size in (100, 200):
        assert differences(*group(size, 15), "t", 0.8).count() <= 4 * size
    # A fifth of a node or more that no other has: it is similar to none.
    assert differences(*group(100, 30), "t", 0.8).where("node > 1").isEmpty()
    placed, weights = group(60, 4)
    got = {(r.a, r.b) for r in across_components(placed, lambda nodes: weights, 0.8, "t").collect()}
    sets = {}
    for r in weights.collect():
        sets.setdefault(r.node, set()).add(r.feature)
    near = {(a, b) for a, b in combinations(range(2, 60), 2) if jaccard(sets[a], sets[b]) >= 0.8}
    met = {p for p in near if any(f < 100 for f in sets[p[0]] ^ sets[0] if f in sets[p[1]] ^ sets[0])}
    assert met and met <= got
