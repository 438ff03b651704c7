"""Hard negatives by rotated one-bit codes with exact integer scores.

A vector's components are whole numbers.  Its direction is rotated by a seeded orthogonal
matrix and coded by signs: a code ``s`` stands for the unit vector ``s / sqrt(d)``, and the
stored alignment is the direction's product with it.  What the code leaves over is rotated
and coded again, ``LEVELS`` times.  An anchor's direction is rotated alike and rounded to
``PLANES`` bits a component, so its product with a code is a weighted sum of popcounts.

The estimate's error is bounded without chance: the part left after the last code is at
right angles to that code, so by Cauchy and Schwarz it adds at most its length times the
part of the anchor at right angles to the same code; rounding the anchor adds at most its
error times the alignment, level by level.  The rows of the best estimates are scored as
whole numbers; rows whose interval of scores cannot reach what these reach are left out,
and all others are scored as well.  Results are exact.

Anchors are a stated query set: rows stay in parts of at most ``PART_ROWS`` rows, and packs
of anchors pass through every part.  A part returns only its best rows for each anchor.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loanbook.llm.storage import stored

LEVELS, PLANES = 5, 7
CHUNK_ROWS, PACK_ANCHORS = 4096, 256
PART_ROWS, LEAST_PARTS = 1 << 17, 16
TOO_LARGE = 1 << 27
"""Vectors with a component of this size take no part: their scores might not fit a long."""
_SLACK = 1e-5


@cache
def rotation(size: int, level: int, seed: int = 11) -> np.ndarray:
    """An orthogonal matrix of ``size`` rows and the next multiple of 64 columns."""
    width = -(-size // 64) * 64
    turned, _ = np.linalg.qr(np.random.default_rng((seed, level)).standard_normal((width, width)))
    return turned[:size]


def _directions(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = ints.astype(np.float64)
    lengths = np.sqrt((x * x).sum(axis=1))
    return x / np.where(lengths, lengths, 1)[:, None], lengths


def _words(bits: np.ndarray) -> np.ndarray:
    """The bits of each row as 64-bit words, one array of words after another."""
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T)


@dataclass
class Codes:
    """Sign codes of some rows: words [level][word][row], alignments [level][row], and the length left over."""

    words: np.ndarray
    ones: np.ndarray
    align: np.ndarray
    rest: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, ints: np.ndarray) -> Codes:
        left, lengths = _directions(ints)
        words, align = [], []
        for level in range(LEVELS):
            left = left @ rotation(left.shape[1], level)
            side = left.shape[1] ** 0.5
            bits = left >= 0
            share = np.abs(left).sum(axis=1) / side
            words.append(_words(bits))
            align.append(share)
            left = left - np.where(bits, share[:, None], -share[:, None]) / side
        words = np.stack(words)
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        return cls(words, ones, np.stack(align), np.sqrt((left * left).sum(axis=1)), lengths)

    def part(self, some: slice) -> Codes:
        return Codes(
            self.words[:, :, some], self.ones[:, some], self.align[:, some], self.rest[some], self.lengths[some]
        )


@dataclass
class Anchor:
    """An anchor's direction, rotated for each level, in bit planes."""

    planes: list[np.ndarray]
    low: list[float]
    step: list[float]
    total: list[int]
    error: list[float]
    length: float

    @classmethod
    def all(cls, ints: np.ndarray) -> list[Anchor]:
        x, lengths = _directions(ints)
        out = [cls([], [], [], [], [], float(length)) for length in lengths]
        for level in range(LEVELS):
            x = x @ rotation(x.shape[1], level)
            low = x.min(axis=1, keepdims=True)
            step = np.maximum((x.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-12)
            whole = np.rint((x - low) / step).astype(np.uint8)
            error = np.sqrt(((x - (low + step * whole)) ** 2).sum(axis=1))
            for a, anchor in enumerate(out):
                anchor.planes.append(_words((whole[a][None, :] >> np.arange(PLANES)[:, None] & 1).astype(bool)))
                anchor.low.append(float(low[a, 0]))
                anchor.step.append(float(step[a, 0]))
                anchor.total.append(int(whole[a].sum()))
                anchor.error.append(float(error[a]))
        return out

    def interval(self, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of the coded rows with this anchor."""
        levels, words, many = codes.words.shape
        width = words * 64
        estimate, bound = np.zeros(many), np.full(many, _SLACK)
        weights = (1 << np.arange(PLANES, dtype=np.uint16))[:, None]
        for level in range(levels):
            on = np.zeros(many, dtype=np.int64)
            for w in range(words):
                both = np.bitwise_count(codes.words[level, w][None, :] & self.planes[level][w][:, None])
                on += (both * weights).sum(axis=0, dtype=np.uint16)
            product = self.step[level] * (2 * on - self.total[level])
            product = (product + self.low[level] * (2 * codes.ones[level] - width)) / width**0.5
            estimate += codes.align[level] * product
            bound += codes.align[level] * self.error[level]
        aside = np.maximum(np.abs(product) - self.error[-1], 0)
        bound += codes.rest * np.sqrt(np.clip(1 - aside * aside, 0, 1))
        scale = codes.lengths * self.length
        return scale * (estimate - bound), scale * (estimate + bound)


def scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(anchor).max(initial=0)) * len(anchor)
    if most < 2**53:  # every partial sum is a whole number that a double holds
        return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return rows @ anchor


def _best(score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores, ties to smaller ids."""
    if len(score) > 4 * top:
        some = np.flatnonzero(score >= np.partition(score, -top)[-top])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:top]]


def _likely(estimate: np.ndarray, many: int) -> np.ndarray:
    """Places of the highest estimates."""
    return np.argpartition(estimate, -many)[-many:] if len(estimate) > many else np.arange(len(estimate))


# Tables -----------------------------------------------------------------------------


def whole_rows(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(vec_id, label, ints, key): usable rows, each once, with components as floor(256 x)."""
    parts = F.col("x")
    rows = vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{label_column}`").cast("long").alias("label"),
        F.col(f"`{vector_column}`").alias("x"),
    )
    whole = F.transform(parts, lambda v: F.floor(v.cast("double") * 256))
    fits = F.forall(parts, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * 256) < TOO_LARGE))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(parts) > 0) & fits)
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), whole.alias("ints"))
    return rows.withColumn("key", F.xxhash64("vec_id", "label", "ints")).dropDuplicates(["vec_id", "label", "key"])


def _packed(rows: DataFrame, most: int, parts: int | None, extra: list[str] = []) -> DataFrame:
    """Rows as packs of at most ``most``, sorted by label: bytes of their ids, keys, labels and components."""
    names = ["vec_id", "key", "label", "ints", *extra]
    schema = "part int, kind int, many int, ids binary, keys binary, labels binary, ints binary, aims binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, labels = (batch.column(i).to_numpy() for i in range(3))
            ints = batch.column(3).flatten().to_numpy().reshape(len(batch), -1)
            for start in range(0, len(batch), most):
                order = start + np.argsort(labels[start : start + most], kind="stable")
                data = [np.ascontiguousarray(c[order]).tobytes() for c in (ids, keys, labels, ints)]
                aims = batch.column(4).take(pa.array(order)) if extra else None
                part = zlib.crc32(data[1]) % parts if parts else 0
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([v], pa.int32()) for v in (part, 0 if parts else 1, len(order))),
                        *(pa.array([d], pa.binary()) for d in (*data, _aims(aims))),
                    ],
                    names=[c.split()[0] for c in schema.split(", ")],
                )

    return rows.select(*names).mapInArrow(run, schema)


def _aims(lists: pa.Array | None) -> bytes:
    """Per anchor, (place, id, score) of its positives, behind how many there are."""
    if lists is None:
        return b""
    out = []
    for some in lists.to_pylist():
        out += [len(some), *(v for one in some for v in (one["place"], one["vec_id"], one["score"]))]
    return np.array(out, dtype=np.int64).tobytes()


def _read_aims(data: bytes, many: int) -> list[np.ndarray]:
    flat, at, out = np.frombuffer(data, dtype=np.int64), 0, []
    for _ in range(many):
        size = int(flat[at])
        out.append(flat[at + 1 : at + 1 + 3 * size].reshape(size, 3))
        at += 1 + 3 * size
    return out


@dataclass
class Part:
    """The rows of one part, chunk by chunk: ids, labels, components and codes."""

    number: int
    chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray, Codes]] = field(default_factory=list)

    def add(self, row: dict) -> None:
        ids, labels = (np.frombuffer(row[n], dtype=np.int64) for n in ("ids", "labels"))
        ints = np.frombuffer(row["ints"], dtype=np.int64).reshape(row["many"], -1)
        self.chunks.append((ids, labels, ints, Codes.of(ints)))


@dataclass
class Pack:
    """Some anchors."""

    ids: np.ndarray
    keys: np.ndarray
    labels: np.ndarray
    ints: np.ndarray
    aims: list[np.ndarray]
    coded: list[Anchor]

    @classmethod
    def read(cls, row: dict) -> Pack:
        ids, keys, labels = (np.frombuffer(row[n], dtype=np.int64) for n in ("ids", "keys", "labels"))
        ints = np.frombuffer(row["ints"], dtype=np.int64).reshape(row["many"], -1)
        aims = _read_aims(row["aims"], row["many"]) if row["aims"] else []
        return cls(ids, keys, labels, ints, aims, Anchor.all(ints))


def positives_in(part: Part, pack: Pack, top: int) -> Iterator[tuple]:
    """(anchor, key, id, score): an anchor's best rows of its label in the part."""
    for a, anchor in enumerate(pack.coded):
        best, own = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for ids, labels, ints, codes in part.chunks:
            first, last = np.searchsorted(labels, [pack.labels[a], pack.labels[a] + 1])
            if first == last:
                continue
            low, high = anchor.interval(codes.part(slice(first, last)))
            open_ = ids[first:last] != pack.ids[a]
            for some in (_likely(np.where(open_, low + high, -np.inf), top), None):
                if some is None:
                    some = np.flatnonzero(open_ & (high >= (best[-1] if len(best) == top else -np.inf)))
                some = some[open_[some]]
                open_[some] = False
                score = np.concatenate((best, scores(ints[first + some], pack.ints[a])))
                names = np.concatenate((own, ids[first + some]))
                kept = _best(score, names, top)
                best, own = score[kept], names[kept]
        for score, name in zip(best, own):
            yield pack.ids[a], pack.keys[a], name, score


def negatives_in(part: Part, pack: Pack, top: int) -> Iterator[tuple]:
    """(anchor, key, place, positive, its score, id, score): per positive, the best fitting rows of other labels."""
    for a, anchor in enumerate(pack.coded):
        aims = pack.aims[a]
        least, most = -(-30 * aims[:, 2] // 100), 90 * aims[:, 2] // 100
        bands = np.flatnonzero(least <= most)
        if not len(bands):
            continue
        found = {b: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for b in bands}
        for ids, labels, ints, codes in part.chunks:
            low, high = anchor.interval(codes)
            open_ = labels != pack.labels[a]
            for likely in (True, False):
                wanted = np.zeros(len(ids), dtype=bool)
                for b in bands:
                    if likely:
                        below = open_ & (low + high <= 2 * most[b])
                        wanted[_likely(np.where(below, low + high, -np.inf), 2 * top)] = True
                    else:
                        floor = max(least[b], found[b][0][-1]) if len(found[b][0]) == top else least[b]
                        wanted |= (high >= floor) & (low <= most[b])
                some = np.flatnonzero(wanted & open_)
                open_[some] = False
                score, names = scores(ints[some], pack.ints[a]), ids[some]
                for b in bands:
                    fits = (score >= least[b]) & (score <= most[b])
                    both = np.concatenate((found[b][0], score[fits])), np.concatenate((found[b][1], names[fits]))
                    kept = _best(*both, top)
                    found[b] = both[0][kept], both[1][kept]
        for b in bands:
            place, positive, aim = aims[b]
            for score, name in zip(*found[b]):
                yield pack.ids[a], pack.keys[a], place, positive, aim, name, score


def _passed(chunks: DataFrame, packs: DataFrame, parts: int, find: Callable, top: int, schema: str) -> DataFrame:
    """What ``find`` gives for every part and every pack of anchors."""
    everywhere = packs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(int(parts) - 1))))
    both = chunks.unionByName(everywhere).repartition(2 * parts, "part").sortWithinPartitions("part", "kind")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if part is None or part.number != row["part"]:
                    part = Part(row["part"])
                if row["kind"] == 0:
                    part.add(row)
                    continue
                found = list(find(part, Pack.read(row), top))
                if found:
                    columns = [pa.array(np.array(c, dtype=np.int64)) for c in zip(*found)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(run, schema)


def mine(
    vectors: DataFrame,
    is_anchor: str,
    positives: int = 5,
    negatives: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``vec_id``.  Of an anchor's other rows of its label the
    ``positives`` of highest score are its positives; for each of them the ``negatives``
    rows of other labels of highest score between 30 % and 90 % of the positive's score are
    returned.  Ties go to the smaller id.

    Defined cases: rows with a null id, label, vector or component, a non-finite component,
    no components, a component of 2**19 or more, or another length than most rows have (of
    equally common lengths, the longest counts) take no part.  Rows that repeat an id, label
    and vector count once; where an id has several vectors, each is a row, and none of them
    is another's "other row".  A positive of negative score has no negatives.  An empty
    table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = stored(whole_rows(vectors, id_column, vector_column, label_column), "mined-rows")
    lengths = rows.groupBy(F.size("ints").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    rows = rows.where(F.size("ints") == lengths["n"])
    parts = max(LEAST_PARTS, -(-lengths["count"] // PART_ROWS))
    chunks = stored(_packed(rows, CHUNK_ROWS, parts), "mined-chunks")
    anchors = rows.where(is_anchor)

    schema = "anchor_id long, key long, vec_id long, score long"
    near = _passed(chunks, _packed(anchors, PACK_ANCHORS, None), parts, positives_in, positives, schema)
    first = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    aims = near.groupBy("anchor_id", "key").agg(F.collect_list(F.struct("place", "vec_id", "score")).alias("aims"))
    aimed = anchors.join(aims, (F.col("vec_id") == F.col("anchor_id")) & (anchors["key"] == aims["key"])).select(
        "vec_id", anchors["key"], "label", "ints", "aims"
    )
    packs = stored(_packed(aimed, PACK_ANCHORS, None, ["aims"]), "mined-anchors")

    schema = (
        "anchor_id long, key long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    )
    hard = _passed(chunks, packs, parts, negatives_in, negatives, schema)
    best = Window.partitionBy("anchor_id", "key", "place").orderBy(F.desc("negative_score"), "negative_id")
    return (
        hard.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


ORACLE = """
WITH usable AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS ints
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same,
         CAST(list_dot_product(a.ints, r.ints) AS BIGINT) AS score
  FROM usable a JOIN usable r ON r.vec_id <> a.vec_id
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
