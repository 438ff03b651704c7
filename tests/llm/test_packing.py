"""Packing: exact ids, every id in one piece, all limits kept, no padding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loanbook.llm.packing import Limits, Packer, pack_sequences
from loanbook.llm.queries import op10_packing, vocabulary


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, expected, limits):
    """texts: {doc_id: text}, ids unique."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids, at = expected(texts[doc]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limits.tokens and len(pieces) <= limits.segments
        assert sum(p.loss_tokens for p in pieces) <= limits.loss_tokens
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding


def test_documents(spark, small, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert check(op10_packing(spark, small).collect(), texts, reference, Limits()) == 0


def test_odd_rows(spark, reference):
    texts = {1: None, 2: "", 3: "a<|endoftext|>b <|endoftext|>", 4: "ü\x00 \n\n x" * 5000, 5: "a", None: "null id"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("length", F.lit("clash"))
    assert check(pack_sequences(df, vocabulary()).collect(), texts, reference, Limits()) == 0
    twice = pack_sequences(df.where("doc_id = 5").unionAll(df.where("doc_id = 5")), vocabulary()).collect()
    assert sum(r.length for r in twice) == 4
    assert pack_sequences(df.limit(0), vocabulary()).collect() == []


def test_limits(spark):
    limits = Limits(tokens=64, segments=3, loss_tokens=40)
    df = spark.createDataFrame(
        [(i, "the cat " * (i % 9), "sat on the mat " * (i % 7)) for i in range(300)], "doc_id long, prompt string, text string"
    )
    rows = pack_sequences(df, vocabulary(), limits, prompt_column="prompt", pool=50).collect()
    encode = vocabulary().encode
    expected = {i: [*encode("the cat " * (i % 9))[:-1], *encode("sat on the mat " * (i % 7))] for i in range(300)}
    check(rows, {i: i for i in range(300)}, lambda i: expected[i], limits)
    quiet = {i: sum(r.length - r.loss_tokens for r in rows if r.doc_id == i) for i in range(300)}
    assert all(quiet[i] == len(encode("the cat " * (i % 9))) - 1 for i in range(300))


def test_dot_product_prefers_the_scarce_room():
    # Loss-bearing room is scarce after the first piece: the quiet piece goes in, not the longer loud one.
    pieces = [(0, 0, 60, 0), (1, 0, 30, 0), (2, 0, 36, 36)]
    placed = list(Packer(Limits(128, 8, 64), 0).pack(pieces))
    first = [p[0] for p in placed if p[4] == placed[0][4]]
    assert first[:2] == [0, 2]
