"""Exact repeats against brute force over all strings, the interval tree, odd rows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loanbook.llm import repeats
from loanbook.llm.queries import op7_repeats
from loanbook.llm.text import blocks

DOCUMENTS = "doc_id long, text string"
SHA = lambda b: hashlib.sha256(b).hexdigest()


def brute(texts):
    """texts: {doc_id: text}; rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), []
    for doc in sorted(texts, key=lambda d: (d is not None, d)):
        data = (texts[doc] or "").encode()
        gone = np.zeros(len(data) + 1, dtype=bool)
        for i in range(len(data) - 99):
            piece = data[i : i + 100]
            if piece in seen:
                gone[i : i + 100] = True
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(data) else 0
        out.append((doc, len(data), int(gone.sum()), spans, SHA(kept)))
    return out


def test_documents(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = sorted(map(tuple, op7_repeats(spark, small).collect()))
    assert got == brute(texts)
    assert sum(r[2] for r in got) > 10_000


def random_texts(seed, n=150):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcdé ", k=rng.randint(60, 400))) for _ in range(12)]
    texts = {}
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) // 2)
                p = p[a : rng.randint(a, len(p))]
                if rng.random() < 0.3 and p:
                    at = rng.randrange(len(p))
                    p = p[:at] + "#" + p[at + 1 :]
                parts.append(p)
            else:
                parts.append("".join(rng.choices("abcdefgh", k=rng.randint(0, 200))))
        texts[i * 3 % 401] = "".join(parts) * rng.choice([1, 1, 1, 2])
    return texts


def test_random(spark):
    for seed in (1, 2):
        texts = random_texts(seed)
        got = sorted(map(tuple, repeats.repeat_table(spark.createDataFrame(list(texts.items()), DOCUMENTS)).collect()))
        assert got == brute(texts)


def test_odd_rows(spark, monkeypatch):
    base = "".join(random.Random(4).choices("abcdefghijklmnop", k=150))
    texts = {
        1: None, 2: "", 3: base[:99], 4: base[:100], 5: base, 6: "x" + base[20:] + "y", 7: "z" * 5000, 8: "z" * 130,
        9: "\x00" * 300, 10: base[:50] + "\x00" * 120 + base[50:], 11: "é" * 120, 12: "ab" * 300, 13: base * 3, None: base[10:130],
        14: "".join(random.Random(9).choices("abcdefgh ", k=1_300_000)),
    }
    texts[15] = texts[14][524_200:524_500] + texts[14][1_000_000:1_100_000]
    df = spark.createDataFrame(list(texts.items()), DOCUMENTS)
    df = df.withColumns({"id": F.lit("i"), "version": F.lit("v"), "first": F.lit(1), "anchor": F.lit(2)})
    got = repeats.repeat_table(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(texts)))
    # Equal rows are not earlier than one another.
    twice = repeats.repeat_table(df.where("doc_id = 5").unionByName(df.where("doc_id IN (5, 6)"))).collect()
    assert sorted((r.doc_id, r.n_removed) for r in twice) == [(5, 0), (5, 0), (6, 130)]
    assert repeats.repeat_table(df.limit(0)).collect() == []


def test_anchors_depend_on_content_only():
    rng = random.Random(7)
    shared = "".join(rng.choices("abcd", k=500))
    texts = ["".join(rng.choices("abcd", k=n)) + shared + "tail" * n for n in (0, 3, 70)]
    found = []
    for text in texts:
        block = next(blocks(pa.array([text], pa.large_string())))
        _, start, strings, offset, anchor, _ = repeats.runs_of(block)
        at = text.index(shared)
        covered = np.repeat(start, strings) + np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
        assert (covered == np.arange(len(text) - 99)).all()
        whole = np.repeat(anchor, strings)[at : at + 401]
        place = np.repeat(start + offset, strings)[at : at + 401] - at
        found.append((whole.tolist(), place.tolist()))
    assert found[0] == found[1] == found[2]


def test_maximal_repeats():
    rng = random.Random(3)
    core = bytes(rng.choices(b"abc", k=120))
    contexts = [b"x" + core + b"u", b"y" + core + b"v", b"x" + core[:110] + b"w", core]
    array = repeats.SuffixArray(contexts)
    found = defaultdict(set)
    for length, first, last in array.maximal_repeats():
        where = zip(array.row[first : last + 1], array.place[first : last + 1])
        r, p = array.row[first], array.place[first]
        found[contexts[r][p : p + length]] |= {(int(a), int(b)) for a, b in where}
    assert found[core] == {(0, 1), (1, 1), (3, 0)}
    assert found[core[:110]] == {(0, 1), (1, 1), (2, 1), (3, 0)}
    assert found[b"x" + core[:110]] == {(0, 0), (2, 0)}
    assert set(found) == {core, core[:110], b"x" + core[:110]}


def test_contexts_of_one_anchor_are_split(spark, monkeypatch):
    """A passage that many texts share between different surroundings: no bucket holds all contexts."""
    rng = random.Random(11)
    passage = "".join(rng.choices("abcdefghijklmnopé", k=110))
    texts = {i: "".join(rng.choices("abcdefgh", k=80)) + passage + "".join(rng.choices("abcdefgh", k=80)) for i in range(120)}
    texts |= {200 + k: v for k, v in random_texts(3, 60).items()} | {None: passage[3:] + "x" * 130, 900: passage * 3}
    df = spark.createDataFrame(list(texts.items()), DOCUMENTS)
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", 5, raising=False)
    with_contexts, seen = repeats._with_contexts, []
    monkeypatch.setattr(repeats, "_with_contexts", lambda docs, firsts: seen.append(firsts) or with_contexts(docs, firsts))
    got = sorted(map(tuple, repeats.repeat_table(df).collect()), key=str)
    assert got == sorted(brute(texts), key=str)
    scanned, *_ = seen
    assert max(r["count"] for r in scanned.groupBy("anchor").count().collect()) <= 5


def test_texts_are_shuffled_once(spark, monkeypatch):
    """Contexts, strings of crowded anchors and the result read one shuffle of the texts."""
    rng = np.random.default_rng(8)
    core = "".join(chr(c) for c in rng.integers(97, 123, 150))
    texts = [core + "".join(chr(c) for c in rng.integers(97, 123, 60)) for _ in range(40)]
    other = "".join(chr(c) for c in rng.integers(65, 91, 140))
    texts += [other + "x" * 30, other + "y" * 30]
    plans, real = [], repeats.stored

    def spy(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(repeats, "stored", spy)
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        got = {r.doc_id: len(r.kept) for r in found.collect()}
        final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got[0] == 210 and all(got[n] <= 60 for n in range(1, 40)) and got[41] <= 30
    assert not any("wanted" in plan for plan in plans)
    assert sum("ReusedExchange" in line and "text#" in line for line in final) >= 2
    assert sum("MapInArrow" in line and "string#" in line for line in final) == 1
