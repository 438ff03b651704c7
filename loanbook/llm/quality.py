"""Quality rules: counts per text, and robust multivariate outliers among them.

Every text gets a vector of transformed counts.  Per language and source the centre and
spread of ordinary texts are estimated by minimum covariance determinant: the mean and
covariance of the three quarters of the texts whose covariance has the smallest
determinant.  Texts at a large Mahalanobis distance from it are rejected.

The estimate follows the algorithm for large tables: each block of about a thousand texts
of a group is searched from several starts, the best block estimate starts the group, and
concentration steps over all texts of the group finish it.  Each such step is one
aggregation by group and distance class; rows of a group never meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loanbook.llm.storage import stored
from loanbook.llm.text import Block, blocks, mix

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SUBSET = 0.75
LEAST_ROWS = 50
BLOCK_ROWS = 1000
STEPS = 3
CUTOFF = 1 - 1e-6
_SIZE = 5
# Spread that a group without any variation in a dimension is given.
_FLOOR = np.array([0.10, 0.03, 0.05, 0.40, 0.15])
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PAIRS = [(i, j) for i in range(_SIZE) for j in range(i, _SIZE)]


def counts(block: Block) -> np.ndarray:
    """The five counts of each text, one row per text."""
    words, data, n = block.words(), block.data, block.texts
    starts_char = (data & 0xC0) != 0x80
    white = (data == 32) | ((data >= 9) & (data <= 13))

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[block.bounds[1:]] - sums[block.bounds[:-1]]

    sums = block.prefix_hash()
    hashes = block.slice_hash(sums, words.starts, words.ends)
    repeated = np.zeros(n, dtype=np.int64)
    if len(hashes) > 2:
        three = hashes[:-2] * np.uint64(3) + mix(hashes[1:-1]) * np.uint64(5) + mix(hashes[2:] + np.uint64(1))
        within = words.text[:-2] == words.text[2:]
        at = np.flatnonzero(within)
        key = mix(three[at] + mix(words.text[at].astype(np.uint64)))
        _, kind, many = np.unique(key, return_inverse=True, return_counts=True)
        at = at[many[kind] > 1]
        marked = np.zeros(len(hashes), dtype=bool)
        for k in range(3):
            marked[at + k] = True
        repeated = np.bincount(words.text[marked], minlength=n)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate((block.bounds[:-1], breaks + 1)))
    line_text = np.sort(np.concatenate((np.arange(n), np.searchsorted(block.bounds[1:], breaks, side="right"))))
    line_ends = np.sort(np.concatenate((block.bounds[1:], breaks)))
    solid = np.concatenate(([0], np.cumsum(~white)))
    line_ends = np.maximum(line_ends, line_starts)
    filled = solid[line_ends] > solid[line_starts]
    line_text, line_starts, line_ends = line_text[filled], line_starts[filled], line_ends[filled]
    key = mix(block.slice_hash(sums, line_starts, line_ends) + mix(line_text.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    twice = np.bincount(line_text, minlength=n) - np.bincount(line_text[first], minlength=n)
    return np.stack(
        [words.counts, per_text(starts_char & ~white), per_text(_SYMBOL[data]), twice, repeated], axis=1
    ).astype(np.int64)


def text_counts(df: DataFrame, text_column: str) -> DataFrame:
    """Replace the text column by the five counts."""
    at = df.columns.index(text_column)
    rest = [c for c in df.columns if c != text_column]
    schema = df.drop(text_column).withColumns({c: F.lit(0).cast("long") for c in COUNTS}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(block) for block in blocks(batch.column(at))]
            values = np.concatenate(found) if found else np.zeros((0, _SIZE), np.int64)
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c) for c in values.T)], names=[*rest, *COUNTS])

    return df.mapInArrow(run, schema)


def vector() -> list[Column]:
    """Transformed counts, about as spread in long texts as in short ones."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.log1p("n_dup_lines"),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-squared with k degrees of freedom, by its series."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, 500):
        term *= half / (k / 2 + i)
        total += term
    return total * math.exp(-half + k / 2 * math.log(half) - math.lgamma(k / 2 + 1))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 1e-9, 200.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < q else (low, middle)
    return low


def spread(covariance: np.ndarray) -> np.ndarray:
    """Scale the covariance of the subset to that of the whole, and give flat dimensions their floor."""
    consistency = SUBSET / chi2_cdf(chi2_quantile(SUBSET, _SIZE), _SIZE + 2)
    return covariance * consistency + np.diag(_FLOOR**2)


def distances(x: np.ndarray, mean: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    centred = x - mean
    return (centred @ np.linalg.inv(covariance) * centred).sum(axis=1)


def concentrate(x: np.ndarray, starts: int = 8, steps: int = 6) -> tuple[np.ndarray, np.ndarray, float]:
    """Minimum covariance determinant of some rows: mean, covariance, log-determinant."""
    rng, most = np.random.default_rng(len(x)), max(math.ceil(SUBSET * len(x)), _SIZE + 1)
    best = None
    for start in range(starts):
        if start:
            few = x[rng.choice(len(x), min(len(x), 2 * _SIZE), replace=False)]
            mean, cov = few.mean(axis=0), spread(np.cov(few.T, bias=True))
        else:
            mean = np.median(x, axis=0)
            cov = np.diag((1.4826 * np.median(np.abs(x - mean), axis=0)) ** 2 + _FLOOR**2)
        for _ in range(steps):
            near = x[np.argsort(distances(x, mean, cov), kind="stable")[:most]]
            mean, cov = near.mean(axis=0), spread(np.cov(near.T, bias=True))
        size = float(np.linalg.slogdet(cov)[1])
        if best is None or size < best[2]:
            best = mean, cov, size
    return best


_ESTIMATE = "group string, mean array<double>, precision array<double>, log_det double"


def _estimate_row(group: str, mean: np.ndarray, cov: np.ndarray, log_det: float) -> dict:
    inverse = np.linalg.inv(cov)
    return {
        "group": group,
        "mean": mean.tolist(),
        "precision": [float(inverse[i, j] * (1 if i == j else 2)) for i, j in _PAIRS],
        "log_det": log_det,
    }


def _block_estimate(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(rows["x"].to_numpy())
    return pd.DataFrame([_estimate_row(key[0], *concentrate(x[np.lexsort(x.T)]))])


def _distance() -> Column:
    d = [F.col("x")[i] - F.col("mean")[i] for i in range(_SIZE)]
    total = F.lit(0.0)
    for place, (i, j) in enumerate(_PAIRS):
        total = total + F.col("precision")[place] * d[i] * d[j]
    return F.greatest(total, F.lit(0.0))


def _step(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step: estimates from the nearest three quarters of each group.

    Distances are classed on a logarithmic scale, about one percent wide; the subset ends
    with the class in which the three quarters are reached.
    """
    x = [F.col("x")[i] for i in range(_SIZE)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i, j in _PAIRS]
    names = ["n", *(f"s{i}" for i in range(_SIZE)), *(f"p{i}{j}" for i, j in _PAIRS)]
    classed = (
        rows.join(estimates, "group")
        .withColumn("class", F.floor(F.log2(_distance() + 1e-9) * 64))
        .groupBy("group", "class")
        .agg(F.count("*").alias("n"), *sums, *products)
    )
    along = Window.partitionBy("group").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("group")
    nearest = (
        classed.withColumn("_before", F.coalesce(F.sum("n").over(along), F.lit(0)))
        .withColumn("_all", F.sum("n").over(whole))
        .where(F.col("_before") < F.col("_all") * SUBSET)
        .groupBy("group")
        .agg(*(F.sum(c).alias(c) for c in names))
    )

    def finish(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            out = []
            for row in table.to_dict("records"):
                mean = np.array([row[f"s{i}"] for i in range(_SIZE)]) / row["n"]
                cov = np.zeros((_SIZE, _SIZE))
                for i, j in _PAIRS:
                    cov[i, j] = cov[j, i] = row[f"p{i}{j}"] / row["n"] - mean[i] * mean[j]
                cov = spread(cov)
                out.append(_estimate_row(row["group"], mean, cov, float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(out, columns=["group", "mean", "precision", "log_det"])

    return nearest.mapInPandas(finish, _ESTIMATE)


def robust_outliers(rows: DataFrame) -> DataFrame:
    """Add ``distance`` to (lang, source, x, ...) rows: squared Mahalanobis, null without an estimate.

    Groups of under ``LEAST_ROWS`` rows are estimated together per language; where even
    those are too few there is no estimate.
    """
    size = rows.groupBy("lang", "source").agg(F.count("*").alias("_rows"))
    size = size.withColumn("_small", F.col("_rows") < LEAST_ROWS)
    own = F.to_json(F.array("lang", "source"))
    shared = F.to_json(F.array("lang"))
    size = size.withColumn("group", F.when(F.col("_small"), shared).otherwise(own))
    total = size.groupBy("group").agg(F.sum("_rows").alias("_total"))
    size = size.join(total, "group").select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), "group", "_total"
    )
    size = stored(size, "quality-groups")
    named = rows.join(
        size, rows["lang"].eqNullSafe(size["_lang"]) & rows["source"].eqNullSafe(size["_source"]), "left"
    ).drop("_lang", "_source")
    ready = named.where(F.col("_total") >= LEAST_ROWS).select("group", "x", "_total", "_spread")
    blocked = ready.withColumn(
        "block", F.pmod(F.col("_spread"), F.greatest(F.floor(F.col("_total") / BLOCK_ROWS), F.lit(1)))
    )
    estimates = (
        blocked.select("group", "block", "x")
        .groupBy("group", "block")
        .applyInPandas(_block_estimate, _ESTIMATE)
        .groupBy("group")
        .agg(F.min_by(F.struct("mean", "precision", "log_det"), F.struct("log_det", "mean")).alias("best"))
        .select("group", "best.*")
    )
    for step in range(STEPS):
        estimates = stored(_step(ready.select("group", "x"), estimates), f"quality-{step}")
    return named.drop("_total").join(estimates, "group", "left").withColumn("distance", _distance()).drop(
        "mean", "precision", "log_det", "group"
    )


def judge_texts(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
) -> DataFrame:
    """Per document the counts, the base rules' verdict, the distance and the final verdict.

    ``base_failed``: under 50 words, or more than half of the words in repeated three-word
    windows.  Those rows are not part of any estimate.  ``kept``: passed the base rules
    and is no outlier in its group; without an estimate it stays.

    A null text is empty.  Null languages and sources form groups of their own.  Repeated
    rows count as often as they come.  An empty table gives no rows.  Other columns are
    ignored.
    """
    texts = df.select(
        F.col(id_column).alias("_id"),
        F.col(lang_column).cast("string").alias("lang"),
        F.col(source_column).cast("string").alias("source"),
        F.col(text_column).alias("_text"),
    )
    counted = stored(
        text_counts(texts, "_text")
        .withColumn(
            "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        )
        .withColumn("x", F.array(*vector()))
        .withColumn("_spread", F.xxhash64("_id", *COUNTS)),
        "quality-counts",
    )
    fair = robust_outliers(counted.where("NOT base_failed"))
    limit = chi2_quantile(CUTOFF, _SIZE)
    rest = counted.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    return fair.unionByName(rest).select(
        F.col("_id").alias(id_column),
        *COUNTS,
        "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))).alias("kept"),
        "distance",
    )
