"""Toxicity of whole texts: a bidirectional GRU with attention pooling, written in numpy.

A text is read as words of letters and digits, ASCII letters in lower case.  Each word
enters as a hashed word vector and as the maximum over hashed vectors of its character
3- to 5-grams (byte n-grams with marked ends), so unseen forms of known stems are
recognised.  The network reads windows of 32 words that overlap by half, runs a gated
recurrent unit in both directions, pools the states by attention and ends in a logit.
The score of a text is that of its most toxic window; every window of every text counts.

Training takes labels of texts, not of windows: each epoch picks, in every sampled text,
the window that scores highest now (in clean texts also one at random) and learns the
text's label on it.  The first dimension of
every vector starts from the smoothed log-odds of its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loanbook.llm.text import Block, blocks, mix, runs

WINDOW = 32
STRIDE = 16
HIDDEN = 8
ATTENTION = 8
DIMENSIONS = 6
BUCKETS = 1 << 15
NGRAMS = (3, 4, 5)
SAMPLE_PER_CLASS = 3000
SAMPLE_TEXT_CHARS = 200_000
SAMPLE_BYTES = 96 << 20
REJECT = 0.7
RARE = 4
"""Texts that a bucket must be seen in, in the smaller class, to tell much."""

_SEPARATORS = np.ones(256, dtype=bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARKS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


@dataclass
class Reading:
    """A block as word types and windows over them."""

    word: np.ndarray  # bucket of each type
    grams: np.ndarray  # buckets of all n-grams of all types
    first_gram: np.ndarray  # where the n-grams of each type start
    windows: np.ndarray  # types per window, -1 beyond the text's end
    text: np.ndarray  # the text each window is in
    texts: int


def read(block: Block) -> Reading:
    lower = Block(_LOWER[block.data], block.bounds, block.first)
    words = lower.words(_SEPARATORS)
    sums = lower.prefix_hash()
    hashes = lower.slice_hash(sums, words.starts, words.ends)
    types, sample, kind = np.unique(hashes, return_index=True, return_inverse=True)
    starts, ends = words.starts[sample], words.ends[sample]
    grams, first_gram = _grams(lower, sums, starts, ends)

    counts = words.counts
    per_text = np.where(counts > 0, np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE)), 0)
    text = np.repeat(np.arange(lower.texts), per_text)
    first_window = np.cumsum(per_text) - per_text
    first_word = np.cumsum(counts) - counts
    place = (np.arange(len(text)) - first_window[text]) * STRIDE
    at = place[:, None] + np.arange(WINDOW)
    inside = at < counts[text][:, None]
    at = np.where(inside, at + first_word[text][:, None], 0)
    windows = np.where(inside, kind[at] if len(kind) else 0, -1)
    return Reading((types % BUCKETS).astype(np.int32), grams, first_gram, windows.astype(np.int32), text, lower.texts)


def _grams(block: Block, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each type's n-grams; those at a word's start and end are marked as such.

    Every type also has its whole self as one gram, so that none is without.
    """
    owners, codes = [np.arange(len(starts))], [mix(block.slice_hash(sums, starts, ends))]
    for n in NGRAMS:
        many = np.maximum(ends - starts - n + 1, 0)
        owner = np.repeat(np.arange(len(starts)), many)
        at = starts[owner] + np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
        code = block.slice_hash(sums, at, at + n)
        owners += [owner, owner[at == starts[owner]], owner[at + n == ends[owner]]]
        codes += [code, mix(code[at == starts[owner]] ^ _MARKS[0]), mix(code[at + n == ends[owner]] ^ _MARKS[1])]
    owner, code = np.concatenate(owners), np.concatenate(codes)
    order = np.argsort(owner, kind="stable")
    return (code[order] % BUCKETS).astype(np.int32), runs(owner[order])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Parameters by name; all arrays are float32."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        size, put = 2 * DIMENSIONS, lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
        p = {"words": 0.1 * put(BUCKETS, DIMENSIONS), "grams": 0.1 * put(BUCKETS, DIMENSIONS)}
        for way in "fb":
            p |= {f"W{way}": put(size, 3 * HIDDEN), f"U{way}": put(HIDDEN, 3 * HIDDEN)}
            p |= {f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"A": put(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": put(ATTENTION, 1)}
        p |= {"o": put(2 * HIDDEN, 1), "b": np.zeros(1, np.float32)}
        return cls(p)

    def inputs(self, r: Reading) -> tuple[np.ndarray, np.ndarray]:
        grams = self.p["grams"][r.grams]
        most = np.maximum.reduceat(grams, r.first_gram, axis=0) if len(r.first_gram) else grams
        return np.concatenate([self.p["words"][r.word], most], axis=1), grams

    def forward(self, x: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Logit of each window; with ``keep`` also what the backward pass needs."""
        p, mask = self.p, (windows >= 0).astype(x.dtype)
        states = np.zeros((WINDOW, len(windows), 2 * HIDDEN), x.dtype)
        steps: dict[tuple[str, int], tuple[np.ndarray, ...]] = {}
        for way, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            gates_of = np.concatenate([x @ p[f"W{way}"] + p[f"c{way}"], np.zeros((1, 3 * HIDDEN), x.dtype)])
            U, h = p[f"U{way}"], np.zeros((len(windows), HIDDEN), x.dtype)
            for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
                gx, hu, m = gates_of[windows[:, t]], h @ U, mask[:, t : t + 1]
                zr = _sigmoid(gx[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r, q = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN :]
                n = np.tanh(gx[:, 2 * HIDDEN :] + r * q)
                after = h + m * (1 - z) * (n - h)
                if keep:
                    steps[way, t] = (h, z, r, q, n, m)
                h = after
                states[t, :, half] = h
        u = np.tanh(states @ p["A"] + p["a"])
        weight = np.where(mask.T > 0, (u @ p["v"])[..., 0], -1e9)
        weight = np.exp(weight - weight.max(axis=0)) * mask.T
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tw,twh->wh", weight, states)
        logit = (pooled @ p["o"])[:, 0] + p["b"][0]
        return (logit, (states, steps, u, weight, pooled)) if keep else logit

    def gradients(self, r: Reading, windows: np.ndarray, label: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy over some windows."""
        p = self.p
        x, grams = self.inputs(r)
        logit, (states, steps, u, weight, pooled) = self.forward(x, windows, keep=True)
        out = (_sigmoid(logit) - label) * share
        g = {"o": pooled.T @ out[:, None], "b": np.array([out.sum()], x.dtype)}
        d_pooled = out[:, None] * p["o"][:, 0]
        d_weight = np.einsum("wh,twh->tw", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_u = d_score[..., None] * p["v"][:, 0] * (1 - u * u)
        g |= {"v": np.einsum("twa,tw->a", u, d_score)[:, None], "a": d_u.sum(axis=(0, 1))}
        g["A"] = np.einsum("twh,twa->ha", states, d_u)
        d_states = weight[..., None] * d_pooled + d_u @ p["A"].T
        d_x = np.zeros_like(x)
        for way, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            U, d_U = p[f"U{way}"], np.zeros_like(p[f"U{way}"])
            d_gates_of = np.zeros((len(x) + 1, 3 * HIDDEN), x.dtype)
            d_h = np.zeros((len(windows), HIDDEN), x.dtype)
            for t in range(WINDOW - 1, -1, -1) if way == "f" else range(WINDOW):
                h, z, gate, q, n, m = steps[way, t]
                d_h = d_h + d_states[t, :, half]
                d_after = d_h * m
                d_n = d_after * (1 - z) * (1 - n * n)
                d_gate = d_n * q * gate * (1 - gate)
                d_z = d_after * (h - n) * z * (1 - z)
                d_hu = np.concatenate([d_z, d_gate, d_n * gate], axis=1)
                d_U += h.T @ d_hu
                np.add.at(d_gates_of, windows[:, t], np.concatenate([d_z, d_gate, d_n], axis=1))
                d_h = d_h * (1 - m) + d_after * z + d_hu @ U.T
            d_gates_of = d_gates_of[:-1]
            g |= {f"U{way}": d_U, f"W{way}": x.T @ d_gates_of, f"c{way}": d_gates_of.sum(axis=0)}
            d_x += d_gates_of @ p[f"W{way}"].T
        g["words"] = np.zeros_like(p["words"])
        np.add.at(g["words"], r.word, d_x[:, :DIMENSIONS])
        g["grams"] = np.zeros_like(p["grams"])
        owner = np.repeat(np.arange(len(x)), np.diff([*r.first_gram, len(r.grams)]))
        largest = grams == x[owner, DIMENSIONS:]
        np.add.at(g["grams"], r.grams, largest * d_x[owner, DIMENSIONS:])
        return g

    def scores(self, block: Block) -> np.ndarray:
        """Of each text the score of its most toxic window; 0 for a text without words."""
        r = read(block)
        best = np.zeros(r.texts)
        if len(r.text):
            # float64 from here on, so that equal windows score equally in any block
            logit = self.forward(self.inputs(r)[0], r.windows).astype(np.float64)
            first = runs(r.text)
            best[r.text[first]] = np.maximum.reduceat(_sigmoid(logit), first)
        return best


def train(texts: list[str], labels: list[int], epochs: int = 8, batch: int = 64, rate: float = 0.01) -> Network:
    """Fit the network to labelled texts; the same input gives the same network."""
    net, rng = Network.fresh(), np.random.default_rng(11)
    label = np.array(labels, dtype=np.float32)
    readings = []
    for block in blocks(pa.array(texts, pa.large_string())):
        r = read(block)
        readings.append((r, label[block.first : block.first + block.texts]))
    _start_from_log_odds(net, readings)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, positive = 0, max(label.mean(), 1e-6)
    for epoch in range(epochs):
        now = rate * (1 - 0.8 * epoch / epochs)
        for r, own in readings:
            if not len(r.text):
                continue
            logit = net.forward(net.inputs(r)[0], r.windows)
            first = runs(r.text)
            many = np.diff([*first, len(r.text)])
            order = np.lexsort((logit, r.text))
            best = order[first + many - 1]
            other = first + rng.integers(0, many)
            other = other[own[r.text[other]] == 0]
            chosen = rng.permutation(np.concatenate([best, other]))
            for at in range(0, len(chosen), batch):
                few = chosen[at : at + batch]
                y = own[r.text[few]]
                share = np.where(y > 0, 0.5 / positive, 0.5 / (1 - positive)).astype(np.float32) / len(few)
                step += 1
                for k, g in net.gradients(_only(r, few), _renumbered(r, few), y, share).items():
                    m, s = moments[k]
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    net.p[k] -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def _used(r: Reading, few: np.ndarray) -> np.ndarray:
    used = np.unique(r.windows[few])
    return used[used >= 0]


def _renumbered(r: Reading, few: np.ndarray) -> np.ndarray:
    windows = r.windows[few]
    return np.where(windows >= 0, np.searchsorted(_used(r, few), windows), -1)


def _only(r: Reading, few: np.ndarray) -> Reading:
    """The reading with only the types that some windows hold."""
    used = _used(r, few)
    last = np.append(r.first_gram, len(r.grams))
    many = (last[1:] - last[:-1])[used]
    first = np.cumsum(many) - many
    at = np.repeat(r.first_gram[used] - first, many) + np.arange(many.sum())
    return Reading(r.word[used], r.grams[at], first, r.windows[few], r.text[few], r.texts)


def _start_from_log_odds(net: Network, readings: list[tuple[Reading, np.ndarray]]) -> None:
    """First dimension of each vector: log-odds that a text with this bucket is toxic."""
    seen = {name: np.zeros((2, BUCKETS)) for name in ("words", "grams")}
    totals = np.zeros(2)
    for r, own in readings:
        for y in (0, 1):
            totals[y] += (own == y).sum()
        window, place = np.nonzero(r.windows >= 0)
        pairs = np.unique(np.stack([r.text[window], r.windows[window, place]]), axis=1)
        last = np.append(r.first_gram, len(r.grams))
        many = (last[1:] - last[:-1])[pairs[1]]
        at = np.repeat(r.first_gram[pairs[1]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        for name, text, bucket in (
            ("words", pairs[0], r.word[pairs[1]]),
            ("grams", np.repeat(pairs[0], many), r.grams[at]),
        ):
            once = np.unique(text * BUCKETS + bucket)
            np.add.at(seen[name], (own[once // BUCKETS].astype(int), once % BUCKETS), 1)
    for name, (clean, toxic) in seen.items():
        # Rare buckets stay near 0: their odds would give each training text away.
        share = np.stack([clean / max(totals[0], 1), toxic / max(totals[1], 1)]) + RARE / max(totals.min(), 1)
        net.p[name][:, 0] = np.log(share[1]) - np.log(share[0])


def held_out(id_column: str = "doc_id"):
    """Rows whose labels are kept for testing: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Network | None:
    """Train on at most ``SAMPLE_PER_CLASS`` labelled texts of each class.

    The sample is the rows that are not held out with the smallest hashes of their ids;
    texts of over ``SAMPLE_TEXT_CHARS`` characters are left out of it, and what goes beyond
    ``SAMPLE_BYTES`` together.  One task trains on it and returns the parameters, which are
    all that the driver sees.  None if a class has no rows.
    """
    own = labels.where(~held_out(id_column) & F.col("toxic").isNotNull() & F.col(id_column).isNotNull())
    own = own.groupBy(F.col(id_column).alias("_id")).agg(F.max("toxic").alias("_toxic"))
    picked = None
    for y in (0, 1):
        few = own.where(F.col("_toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_PER_CLASS)
        picked = few if picked is None else picked.unionByName(few)
    rows = (
        documents.select(F.col(id_column).alias("_id"), F.coalesce(text_column, F.lit("")).alias("_text"))
        .where(F.length("_text") <= SAMPLE_TEXT_CHARS)
        .join(F.broadcast(picked), "_id")
        .groupBy("_id", "_toxic")
        .agg(F.min("_text").alias("_text"))
    )
    # At most two classes' samples.
    so_far = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_bytes", F.sum(F.octet_length("_text")).over(so_far)).where(F.col("_bytes") <= SAMPLE_BYTES)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        if {toxic for _, toxic, _ in sample} != {0, 1}:
            return
        for name, values in train([text for _, _, text in sample], [toxic for _, toxic, _ in sample]).p.items():
            shape = pa.array([list(values.shape)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([name]), shape, pa.array([values.tobytes()])], ["name", "shape", "data"])

    sample = rows.select(F.col("_id").cast("string"), F.col("_toxic").cast("int"), "_text").repartition(1)
    found = sample.mapInArrow(learn, "name string, shape array<int>, data binary").collect()
    if not found:
        return None
    return Network({r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]).copy() for r in found})


def score_texts(documents: DataFrame, network: Network | None, text_column: str = "text", name: str = "score") -> DataFrame:
    """Add the score to every row; all columns are kept as they are."""
    schema = documents.withColumn(name, F.lit(0.0)).schema
    at = documents.columns.index(text_column)
    shared = documents.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            score = np.zeros(len(batch))
            if net is not None:
                for block in blocks(batch.column(at)):
                    score[block.first : block.first + block.texts] = net.scores(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])

    return documents.mapInArrow(run, schema)


def score_table(
    documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per document: its id, whether its label was held out, the score and the verdict.

    A null or empty text, or one without a letter or digit, scores 0.  Repeated rows score
    alike; a null id is never trained on and not held out.  Without labels of both classes
    every text scores 0.  An empty table gives no rows.  Other columns are ignored.
    """
    rows = documents.select(F.col(id_column), F.col(text_column).alias("_text"))
    scored = score_texts(rows, fit(documents, labels, id_column, text_column), "_text")
    return scored.select(
        id_column, held_out(id_column).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted")
    )


def keep_clean(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that are not toxic, with the columns they came with."""
    network, name = fit(documents, labels, id_column, text_column), "_toxicity"
    while name in documents.columns:
        name += "_"
    return score_texts(documents, network, text_column, name).where(F.col(name) < REJECT).drop(name)
