"""Toxicity: exact gradients, whole texts, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loanbook.llm import toxicity
from loanbook.llm.queries import op1_toxicity
from loanbook.llm.text import blocks


def block(texts):
    return next(blocks(pa.array(texts, pa.large_string())))


def test_gradients_match_differences():
    r = toxicity.read(block(["one two three " * 9, "idiot four", "x"]))
    net = toxicity.Network({k: v.astype(np.float64) for k, v in toxicity.Network.fresh().p.items()})
    label, share = np.arange(len(r.text)) % 2, np.linspace(0.5, 1.5, len(r.text))

    def loss():
        p = toxicity._sigmoid(net.forward(net.inputs(r)[0], r.windows))
        return -(share * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum()

    found = net.gradients(r, r.windows, label, share)
    rng = np.random.default_rng(0)
    for name, values in net.p.items():
        places = np.argwhere(found[name] != 0)
        for at in map(tuple, rng.permutation(places)[:4]):
            before, slopes = values[at], []
            for d in (1e-6, -1e-6):
                values[at] = before + d
                slopes.append(loss())
            values[at] = before
            assert abs((slopes[0] - slopes[1]) / 2e-6 - found[name][at]) < 1e-4 * max(1, abs(found[name][at])), name


def test_windows_cover_every_word_and_overlap():
    for n in (1, 15, 16, 17, 32, 33, 48, 49, 400):
        r = toxicity.read(block([" ".join(f"w{i}" for i in range(n))]))
        seen = np.bincount(r.windows[r.windows >= 0], minlength=n)
        assert (seen >= 1).all() and (seen == 2).sum() >= n - 32


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    for i in range(n):
        words = [f"w{rng.integers(200)}" for _ in range(rng.integers(1, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words.insert(rng.integers(len(words) + 1), f"Vile{rng.integers(30)}!")
        yield i, " ".join(words), toxic


def test_held_out_accuracy_and_odd_rows(spark):
    rows = list(_rows(900, 5))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    df = df.withColumns({"score": F.lit("clash"), "toxic": F.lit(1), "_toxicity": F.lit(2)})
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    odd = spark.createDataFrame(
        [(9001, None), (9002, ""), (9003, "..."), (None, "w1 w2"), (9004, "w1 " * 60000 + "vile7 " + "w2 " * 60000),
         (9005, "w5 w6 w7"), (9005, "w5 w6 w7")],
        "doc_id long, text string",
    )
    both = df.select("doc_id", "text").unionByName(odd).withColumn("held_out", F.lit(0))
    got = toxicity.score_table(both, labels).collect()
    assert len(got) == 907
    score = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in score.items() if k is not None)
    assert score[9001].score == score[9002].score == score[9003].score == 0 and score[9001].predicted == 0
    assert score[9004].predicted == 1 and score[9005].predicted == 0 and score[None].held_out is False
    test = [(score[i].predicted, t) for i, _, t in rows if score[i].held_out]
    assert np.mean([p == t for p, t in test]) > 0.95
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns and 0 < kept.count() < 900
    assert toxicity.score_table(both.limit(0), labels).collect() == []
    assert {r.score for r in toxicity.score_table(odd, labels.limit(0)).collect()} == {0.0}


def test_documents(spark):
    got = op1_toxicity(spark, "/root/testdata/sf0.1").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id"
    )
    tested = [(r.predicted, r.toxic) for r in got.where("held_out").collect()]
    assert np.mean([p == t for p, t in tested]) > 0.95
