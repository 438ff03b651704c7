"""Near duplicates: the estimate, exact similarity, classes against brute force, odd rows."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loanbook.llm import near_duplicates as near
from loanbook.llm.text import blocks

DOCUMENTS = "doc_id long, text string"


def bag(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def exact(a, b):
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a[x] / a[d], b[x] / b[d]) for x in a.keys() | b.keys())
    return total


def vary(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


VOCABULARY = [f"w{i}" for i in range(3000)]


def corpus(n, seed):
    rng, texts = random.Random(seed), []
    while len(texts) < n:
        words = rng.choices(VOCABULARY, k=rng.randint(1, 150))
        if rng.random() < 0.2:
            words *= 3
        texts.append(words)
        for _ in range(rng.choice([0, 0, 0, 1, 2, 6])):
            texts.append(vary(rng, words, rng.choice([0, 0.005, 0.01, 0.02, 0.05])))
    return [" ".join(t) for t in texts[:n]]


def test_similarity_is_exact():
    texts = corpus(120, 1) + ["", "a b", "a b c d e a b c d e a b c d e", "a b c d e f a b c d e"]
    pairs = list(combinations(range(len(texts)), 2))[::7] + [(i, i) for i in range(len(texts))]
    got = near.similarities(pa.array([texts[a] for a, _ in pairs]), pa.array([texts[b] for _, b in pairs]))
    want = [exact(bag(texts[a]), bag(texts[b])) for a, b in pairs]
    assert np.abs(got - want).max() < 1e-9


def test_signature_estimates_it():
    rng = random.Random(3)
    words = rng.choices(VOCABULARY, k=400)
    texts = [" ".join(words * 2)] + [" ".join(vary(rng, words * 2, s)) for s in (0.0, 0.01, 0.03, 0.08)]
    block = next(blocks(pa.array(texts, pa.large_string())))
    signature = near.signatures(*near.weighted_shingles(block), block.texts)
    for i, t in enumerate(texts):
        similarity = exact(bag(texts[0]), bag(t))
        assert abs((signature[0] == signature[i]).mean() - similarity) < 4 * (0.25 / signature.shape[1]) ** 0.5


def classes_by_brute_force(texts):
    label = list(range(len(texts)))
    bags = [bag(t) for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        if (texts[a] or "") == (texts[b] or "") or bags[a].keys() & bags[b].keys() and exact(bags[a], bags[b]) >= 0.8:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    return label


def test_classes_match_brute_force(spark):
    texts = corpus(400, 7)
    df = spark.createDataFrame(list(enumerate(texts)), DOCUMENTS)
    got = {r.doc_id: r.class_id for r in near.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_brute_force(texts)


def test_odd_rows(spark):
    base = " ".join(VOCABULARY[:60])
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "a b"), (6, "a  b"), (7, base), (8, base), (8, base),
        (9, base.replace("w30 ", "")), (None, base), (None, "no id"), (None, "no id"),
        (10, "x " * 200000), (11, "x " * 200001), (12, "é ü " * 9),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS).withColumns({"node": F.lit(1), "class_id": F.lit("c"), "keys": F.lit(2)})
    got = near.near_duplicates(df).collect()
    assert len(got) == len(rows)
    classes = defaultdict(set)
    for r in got:
        classes[r.doc_id].add(r.class_id)
    assert classes[1] == classes[2] == {1} and classes[3] == {3}
    assert classes[4] == classes[5] == classes[6] == {4}
    assert classes[7] == classes[8] == classes[9] == {7} and classes[None] == {7, None}
    assert classes[10] == classes[11] == {10} and classes[12] == {12}
    kept = near.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "7", "None", "10", "12"])
    assert near.near_duplicates(df.limit(0)).collect() == [] and near.keep_first(df.limit(0)).collect() == []


def test_large_groups(spark):
    """A third of the rows are copies and another third near copies of one text."""
    rng, rows = random.Random(5), []
    one, other = rng.choices(VOCABULARY, k=80), rng.choices(VOCABULARY, k=300)
    for i in range(900):
        if i % 3 == 0:
            rows.append((i, " ".join(one)))
        elif i % 3 == 1:
            at = rng.randrange(300)
            rows.append((i, " ".join(other[:at] + [f"n{i}"] + other[at + 1 :])))
        else:
            rows.append((i, " ".join(rng.choices(VOCABULARY, k=40))))
    got = {r.doc_id: r.class_id for r in near.near_duplicates(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert {got[i] for i in range(0, 900, 3)} == {0}
    assert {got[i] for i in range(1, 900, 3)} == {1}
    assert all(got[i] == i for i in range(2, 900, 3))


def test_large_group_with_other_weights(spark):
    """Near copies of a text that repeats itself: some lose a repetition, some only words, some gain a part twice."""
    rng = random.Random(8)
    part, rest = rng.choices(VOCABULARY, k=30), rng.choices(VOCABULARY, k=90)
    texts = [" ".join(part + rest + part)]
    for i in range(1, 160):
        words = part * rng.choice((1, 2, 2, 2, 3)) + rest + part * (i % 5 == 0)
        for _ in range(rng.choice((0, 1, 2, 3, 4))):
            words[rng.randrange(len(words))] = f"n{i}"
        if i % 7 == 0:
            words += words[-12:]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), DOCUMENTS)
    got = {r.doc_id: r.class_id for r in near.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_brute_force(texts)
