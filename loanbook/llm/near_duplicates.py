"""Near-duplicate documents by ProbMinHash over weighted five-word shingles.

The weight of a shingle is how often its text has it.  Every shingle is a Poisson process
whose rate is its weight: its arrivals come at exponential distances drawn from its hash
and fall into random slots of the signature, which keep their earliest arrival.  A
process ends once its next arrival is later than the latest slot.  Two signatures agree in
a slot with the probability Jaccard similarity of the texts.

Bands of slots make buckets; candidates of a bucket are compared by the exact probability
Jaccard of their shingles, and links make classes.  Equal texts are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from loanbook.llm.links import link_buckets
from loanbook.llm.storage import stored
from loanbook.llm.text import Block, blocks, mix, runs, shingles

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 24
BAND_SLOTS = 6
_SLOTS = BANDS * BAND_SLOTS
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD1342543DE82EF95)


def weighted_shingles(block: Block, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and weight of the distinct shingles, sorted by text and hash."""
    words = block.words()
    hashes = block.slice_hash(block.prefix_hash(), words.starts, words.ends)
    codes, text = shingles(words, hashes, size)
    order = np.lexsort((codes, text))
    codes, text = codes[order], text[order]
    first = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])))[: len(codes)])
    return text[first], codes[first], np.diff(np.append(first, len(codes)))


def signatures(text: np.ndarray, codes: np.ndarray, weights: np.ndarray, texts: int) -> np.ndarray:
    """The shingle in each slot of each text; texts without shingles have zeros."""
    earliest = np.full(texts * _SLOTS, np.inf)
    kept = np.zeros(texts * _SLOTS, dtype=np.uint64)
    # A single shingle ends up in every slot.
    alone = np.bincount(text, minlength=texts) == 1
    single = alone[text]
    kept.reshape(texts, _SLOTS)[text[single]] = codes[single, None]
    text, codes, weights = text[~single], codes[~single], weights[~single]
    arrival, count = np.zeros(len(codes)), np.zeros(len(codes), dtype=np.uint64)
    latest = np.full(texts, np.inf)
    while len(codes):
        count = count + np.uint64(1)
        draw = mix(codes + count * _STEP)
        arrival = arrival - np.log(((draw >> np.uint64(11)) + 0.5) * 2.0**-53) / weights
        active = arrival < latest[text]
        text, codes, weights, arrival, count = (v[active] for v in (text, codes, weights, arrival, count))
        if not len(codes):
            break
        slot = (mix(codes ^ (count * _TURN)) % np.uint64(_SLOTS)).astype(np.int64) + text * _SLOTS
        np.minimum.at(earliest, slot, arrival)
        won = earliest[slot] == arrival
        kept[slot[won]] = codes[won]
        there = text[runs(text)]
        latest[there] = earliest.reshape(texts, _SLOTS)[there].max(axis=1)
    return kept.reshape(texts, _SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and text."""
    keys = np.zeros((len(signature), BANDS), dtype=np.uint64)
    parts = signature.reshape(len(signature), BANDS, BAND_SLOTS)
    for k in range(BAND_SLOTS):
        keys = mix(keys * _STEP + parts[:, :, k])
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * _TURN).view(np.int64)


def probability_jaccard(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Exact similarity of two texts given the weights that each has of their shingles."""
    both = (a > 0) & (b > 0)
    if not both.any():
        return 0.0
    if (a[both] == b[both]).all():
        return float(a[both].sum() / np.maximum(a, b).sum())
    total, ratios = 0.0, a[both] / b[both]
    for ratio in np.unique(ratios):
        total += a[both][ratios == ratio].sum() / np.maximum(a, ratio * b).sum()
    return float(total)


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Probability Jaccard of the texts side by side in two columns."""
    out = np.zeros(len(left))
    both = pa.concat_arrays([left.fill_null(""), right.fill_null("")])
    order = np.arange(len(both)).reshape(2, -1).T.ravel()
    for block in _pairs(both.take(pa.array(order))):
        text, codes, weights = weighted_shingles(block)
        pair, side = text // 2, text % 2
        order = np.lexsort((codes, pair))
        pair, side, codes, weights = pair[order], side[order], codes[order], weights[order].astype(np.float64)
        new = np.concatenate(([True], (codes[1:] != codes[:-1]) | (pair[1:] != pair[:-1])))[: len(codes)]
        place = np.cumsum(new) - 1
        a, b = np.zeros(new.sum()), np.zeros(new.sum())
        a[place[side == 0]] = weights[side == 0]
        b[place[side == 1]] = weights[side == 1]
        owner, codes = pair[new], codes[new]
        first = runs(owner)
        for start, end in zip(first, np.append(first[1:], len(owner))):
            out[block.first // 2 + owner[start]] = probability_jaccard(codes[start:end], a[start:end], b[start:end])
    return out


def _pairs(texts: pa.Array) -> Iterator[Block]:
    """Blocks that hold both texts of each pair."""
    sizes = texts.cast(pa.large_string())
    for start in range(0, len(sizes), 128):
        for block in blocks(sizes.slice(start, 128), limit=1 << 62):
            yield Block(block.data, block.bounds, block.first + start)


def text_node(text: Column) -> Column:
    """128 bits that stand for a text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sketch(documents: DataFrame) -> DataFrame:
    """(id, node, keys) of (id, node, text) rows; no keys for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for block in blocks(batch.column(2)):
                text, codes, weights = weighted_shingles(block)
                found = band_keys(signatures(text, codes, weights, block.texts))
                filled = np.bincount(text, minlength=block.texts) > 0
                keys += [k if f else None for k, f in zip(found, filled)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["id", "node", "keys"]
            )

    schema = StructType([*documents.select("id", "node").schema, StructField("keys", ArrayType(LongType()))])
    return documents.select("id", "node", "text").mapInArrow(run, schema)


def _verifier(texts: DataFrame, similarity: float):
    """Keep the pairs of nodes whose texts are similar enough."""

    def verify(pairs: DataFrame) -> DataFrame:
        one = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
        other = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = pa.array(similarities(batch.column(2), batch.column(3)) >= similarity)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(kept)

        joined = pairs.join(one, "a").join(other, "b").select("a", "b", "left", "right")
        return joined.mapInArrow(run, pairs.select("a", "b").schema)

    return verify


def _shingle_weights(texts: DataFrame):
    """(node, feature, weight) of nodes: their shingles and how often they have each."""

    def features(nodes: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch.column(1)):
                    text, codes, weights = weighted_shingles(block)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(text + block.first)),
                            pa.array(codes.view(np.int64)),
                            pa.array(weights.astype(np.int64)),
                        ],
                        names=["node", "feature", "weight"],
                    )

        kinds = [StructField("feature", LongType()), StructField("weight", LongType())]
        rows = texts.select("node", "text").join(nodes, "node")
        return rows.mapInArrow(run, StructType([*nodes.select("node").schema, *kinds]))

    return features


def duplicate_classes(
    df: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, node, class_id) per row: the class is named by its smallest id."""
    rows = df.select(
        F.col(id_column).alias("id"), text_node(F.col(text_column)).alias("node"), F.col(text_column).alias("text")
    )
    sketched = stored(sketch(rows), "near-sketches")
    members = sketched.select(F.explode("keys").alias("bucket"), "node")
    ends = members.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y")
    involved = members.join(ends.select("bucket"), "bucket", "left_semi").select("node").distinct()
    texts = stored(
        rows.select("node", "text").join(involved, "node", "left_semi").dropDuplicates(["node"]), "near-texts"
    )
    linked = link_buckets(members, _verifier(texts, similarity), _shingle_weights(texts), similarity, "near")
    smallest = sketched.groupBy("node").agg(F.min("id").alias("least"))
    named = smallest.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = named.groupBy("component").agg(F.min("least").alias("class_id"))
    of_node = named.join(classes, "component").select("node", "class_id")
    return sketched.select("id", "node").join(of_node, "node")


def near_duplicates(
    df: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per document its id and ``class_id``, the smallest id of its class.

    Two texts are linked when the probability Jaccard similarity of their five-word
    shingles is at least ``similarity``; classes are what links connect.  Equal texts are
    always in one class, all null and empty texts in one.  A text of under five words has
    one shingle, all its words; of texts without words only equal ones are linked.  A
    class without any id has none.  Repeated rows each get their class.  An empty table
    gives no rows.  Other columns are ignored.
    """
    return duplicate_classes(df, similarity, id_column, text_column).select(F.col("id").alias(id_column), "class_id")


def keep_first(
    df: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row of each class, with the columns it came with: that with the smallest id.

    Rows that repeat this id and text are kept once; without ids one row per text is kept.
    """
    classes = duplicate_classes(df, similarity, id_column, text_column)
    kept = classes.where(F.col("id").eqNullSafe(F.col("class_id"))).select(
        F.col("id").alias("_id"), F.col("node").alias("_kept")
    )
    node = "_node"
    while node in df.columns:
        node += "_"
    rows = df.withColumn(node, text_node(F.col(text_column)))
    same = (rows[node] == kept["_kept"]) & rows[id_column].eqNullSafe(kept["_id"])
    return rows.join(kept, same, "left_semi").dropDuplicates([id_column, node]).drop(node)
