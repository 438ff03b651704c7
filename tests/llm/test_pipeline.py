"""The pipeline, stage by stage, against plain versions of each decision on its own input."""

import sys
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from loanbook.llm import mixing, toxicity
from loanbook.llm.storage import stored

sys.path.insert(0, str(Path(__file__).parent))
import test_lines
import test_near_duplicates


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small), name)
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxic_documents_go(spark, small, stages):
    net = toxicity.fit(stages[0], spark.read.parquet(f"{small}/labels.parquet"))
    score = {r.doc_id: r._s for r in toxicity.score_texts(stages[0], net, "text", "_s").collect()}
    assert {r.doc_id for r in stages[1].collect()} == {d for d, s in score.items() if s < 0.7}


def test_line_stage(stages):
    before = sorted(stages[1].collect())
    removed = test_lines.brute([r.text for r in before])
    want = {}
    for row, gone in zip(before, removed):
        text = "\n".join(line for n, line in enumerate(row.text.split("\n")) if n not in set(gone))
        if not gone or text.strip():
            want[row.doc_id] = text if gone else row.text
    got = {r.doc_id: r.text for r in stages[2].collect()}
    assert sum(got.get(k) != v for k, v in want.items()) + len(got.keys() - want.keys()) <= 2


def test_near_duplicate_stage(stages):
    before = sorted(stages[2].collect())
    classes = test_near_duplicates.classes_by_brute_force([r.text for r in before])
    want = sorted(before[i].doc_id for i, c in enumerate(classes) if i == c)
    assert sorted(r.doc_id for r in stages[3].collect()) == want


def test_mixing_stage(stages):
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix_table(stages[3]).collect()}
    copies = Counter(r.doc_id for r in stages[4].collect())
    assert all(copies[d] * size == t for d, (t, size) in taken.items() if size)


def test_packing_stage(stages):
    lengths = Counter()
    for r in stages[5].collect():
        lengths[r.doc_id] += r.length
    total = Counter()
    for r in stages[5].dropDuplicates(["doc_id"]).collect():
        total[r.doc_id] = r.doc_tokens
    copies = Counter(r.doc_id for r in stages[4].collect())
    assert {d: n * copies[d] for d, n in total.items()} == dict(lengths)
