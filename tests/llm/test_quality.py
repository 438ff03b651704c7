"""Quality: counts against plain Python, the estimate against known shapes, odd rows."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loanbook.llm import quality
from loanbook.llm.queries import op2_quality

DOCUMENTS = "doc_id long, text string, lang string, source string"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    threes = list(zip(words, words[1:], words[2:]))
    often = Counter(threes)
    marked = {i + k for i, three in enumerate(threes) if often[three] > 1 for k in range(3)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(marked))


def verify(rows, texts):
    for r in rows:
        n, chars, symbols, twice, marked = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, twice, marked)
        assert r.base_failed == (n < 50 or 100 * marked > 50 * n)
        assert not (r.base_failed and r.kept)


def test_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = op2_quality(spark, folder).collect()
    assert len(rows) == 1000
    verify(rows, {r.doc_id: r.text for r in docs.collect()})
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_odd_rows(spark):
    texts = {
        1: None, 2: "", 3: "\n\n", 4: "a b c a b c", 5: "\na\na\n a", 6: "é ü\x0b\x1c x\x85y z", 7: "# *|<>\n#\n#",
        8: "word " * 40000, 9: " ".join(f"w{i}" for i in range(70000)), 10: "x\r\nx\r\n x",
    }
    rows = [(k, t, None if k % 2 else "en", None if k % 3 else "s") for k, t in texts.items()]
    df = spark.createDataFrame(rows, DOCUMENTS).withColumns({"x": F.lit(1), "group": F.lit(2), "n_words": F.lit("z")})
    got = quality.judge_texts(df.unionByName(df)).collect()
    assert len(got) == 20
    verify(got, texts)
    assert all(r.kept for r in got if r.doc_id == 9)  # too few rows for an estimate
    assert quality.judge_texts(df.limit(0)).collect() == []


def test_outliers_of_a_hot_group(spark):
    """A third of a group is far away; the estimate still follows the rest."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        n = int(rng.integers(60, 300))
        far = i % 5 == 0 and i < 2500
        words = [f"{'%%%' if far else ''}w{rng.integers(5000)}" for _ in range(n)]
        rows.append((i, " ".join(words), "en", "hot" if i < 2500 else f"s{i % 10}"))
    got = quality.judge_texts(spark.createDataFrame(rows, DOCUMENTS), lang_column="lang").collect()
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in range(0, 2500, 5))
    assert np.mean([kept[i] for i in range(3000) if i >= 2500 or i % 5]) > 0.995


def test_concentrate_ignores_a_far_quarter():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (1000, 5))
    x[:230] += 30
    mean, covariance, _ = quality.concentrate(x)
    assert np.abs(mean).max() < 0.2 and (np.diag(covariance) < 2).all()


def test_chi2():
    assert abs(quality.chi2_quantile(0.975, 5) - 12.8325) < 1e-3
    assert abs(quality.chi2_cdf(5.0, 2) - (1 - np.exp(-2.5))) < 1e-12
