"""Personal data: base spans as the patterns say, labelers' reliabilities, added spans, odd rows."""

import hashlib
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from loanbook.llm import personal as P
from loanbook.llm.queries import op11_personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [
        (kind, m.start(), m.end())
        for kind, p in PATTERNS.items()
        for m in re.finditer(p, text)
        if holds(kind, m.group())
    ]


def listing(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def parsed(spans):
    return [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)]


def check(row, text):
    want = base(text or "")
    assert row.base_sha256 == hashlib.sha256(listing(want).encode()).hexdigest()
    for kind in PATTERNS:
        assert row[f"n_{kind}"] == sum(k == kind for k, _, _ in want)
    spans = parsed(row.spans)
    assert set(want) <= set(spans) and len(set(spans)) == len(spans)
    assert spans == sorted(spans, key=lambda s: (list(PATTERNS).index(s[0]), s[1]))


def test_base_spans_as_the_patterns_say():
    draw = random.Random(5)
    alphabet = "0123456789" * 3 + "..--@@++ab_% ()é\n"
    for _ in range(4000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(60)))
        found, _ = P.base_spans(text)
        assert [(P.KINDS[k], *s) for k in range(4) for s in found[k]] == base(text), text


def test_time_grows_with_length_only():
    for piece in ("a", "1", "1.", "1 ", "+1", "a.", "@", "a@", ":", "1:", "::", " at ", "(", "1-", "00"):
        started = time.perf_counter()
        P.candidates(piece * (400_000 // len(piece)))
        assert time.perf_counter() - started < 8, piece


def test_candidates_do_not_overlap():
    text = "x 1.2.3.4 and 10[.]0[.]0[.]1 or a (at) b.com, +1 (743) 555-3824, 378282246310005, 743 555 3824, 1.2.3.999"
    found = P.candidates(text)
    spans = sorted((s, e) for _, s, e, _ in found)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert {text[s:e] for _, s, e, is_base in found if not is_base} == {
        "10[.]0[.]0[.]1", "a (at) b.com", "378282246310005", "743 555 3824", "1.2.3.999",
    }


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(0)
    true = rng.random(40_000) < 0.3
    right, speaks = [0.95, 0.85, 0.9, 0.8, 0.7], [1.0, 0.9, 0.5, 0.6, 1.0]
    given = np.zeros((len(true), 5), dtype=int)
    for n in range(5):
        correct = rng.random(len(true)) < right[n]
        given[:, n] = np.where(rng.random(len(true)) < speaks[n], np.where(correct == true, 1, -1), 0)
    codes, counts = np.unique([P.vote_code(list(g)) for g in given], return_counts=True)
    found = P.estimate(codes, counts.astype(float))
    assert abs(found.share - 0.3) < 0.02
    for n in range(5):
        for truth in (0, 1):
            said = found.says[n][truth]
            assert abs(said[2 if truth else 0] / (said[0] + said[2]) - right[n]) < 0.03
    posterior = dict(zip(codes, found.posterior(codes)))
    guess = np.array([posterior[P.vote_code(list(g))] >= 0.5 for g in given])
    assert (guess == true).mean() > (np.sign(given.sum(axis=1)) == np.where(true, 1, -1)).mean()


def test_training_follows_the_probabilities():
    rows = [[1, 2], [1, 3]] * 200
    weights = P.train(rows, np.array([0.95, 0.05] * 200))
    assert P.accepted(weights, [[1, 2], [1, 3]], 0.5) == [True, False]


def test_whole_table(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = op11_personal(spark, small)
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for row in rows:
        check(row, texts[row.doc_id])


def test_added_spans(spark):
    """Hidden spellings are added where they look like what the labelers agree on; near misses in other uses are not."""
    draw = random.Random(7)

    def card(n):
        head = "4" + "".join(draw.choice("0123456789") for _ in range(n - 2))
        return head + next(d for d in "0123456789" if P.luhn(head + d))

    rows, hidden, other = [], {}, {}
    for i in range(600):
        name, number = f"user{i}", f"{draw.randrange(200, 999)} 555 {draw.randrange(1000, 9999)}"
        octets = [str(draw.randrange(1, 255)) for _ in range(4)]
        plain = draw.choice([f"mail {name}@host{i}.org now", f"from {'.'.join(octets)} it", f"card {card(16)} paid", f"call +1 {number} now"])
        if i % 6 == 0:
            span = draw.choice([f"{name} [at] host.com", f"{name} (at) mail (dot) org", "[.]".join(octets)])
            hidden[i] = span
            plain = f"contact {span} , {plain}"
        elif i % 6 == 1:
            span = draw.choice([f"{'9' * 3}.{octets[0]}.{octets[1]}.700", card(16)[:-1] + draw.choice("xyz")])
            other[i] = span
            plain = f"version {span} , {plain}"
        rows.append((i, plain))
    got = {r.doc_id: [t[s:e] for _, s, e in parsed(r.spans)] for (i, t), r in zip(rows, sorted(P.span_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()))}
    assert sum(span in got[i] for i, span in hidden.items()) >= 0.9 * len(hidden)
    assert not any(span in got[i] for i, span in other.items())


def test_odd_rows(spark):
    rows = [(None, "a@b.co"), (1, None), (2, ""), (3, "a@b.co"), (3, "a@b.co"), (4, "é" * 50_000 + " 1.2.3.4"), (5, "no data")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"id": F.lit("x"), "base": F.lit(1), "spans": F.lit(None), "candidates": F.lit(2)}
    )
    found = P.span_table(frame).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for row in found:
        check(row, texts[row.doc_id])
    assert next(r.spans for r in found if r.doc_id == 4) == "ip:50001:50008"
    assert P.span_table(frame.limit(0)).collect() == []
    clean = P.span_table(frame.where("doc_id = 5")).collect()
    assert [(r.doc_id, r.spans) for r in clean] == [(5, "")]
