"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each half is quantised by its own centroids, and a
row's cell is the pair of its nearest centroids.  A query walks centroid pairs by the sum
of the two distances with a heap until the cells it has met hold a share of all rows, and
those rows are ranked by their exact cosine.

Centroids come from a bounded sample; every row is indexed.  Equal vectors are kept only
as often as a result can hold them, which loses nothing, and equal queries are searched
once.  Neighbouring cells make up parts of bounded size, large cells several of them.  Rows
move once, to their part; queries pass one by one through the parts that they visit, and a
part returns only its best rows for each.  So no task holds more than a part and some
queries, and nothing that grows with the table is sent to the driver or to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loanbook.llm.storage import stored

SAMPLE_ROWS = 20_000
#: Rows and queries of one matrix product, and what the vectors of a part may take in memory.
PACK_ROWS, PACK_QUERIES = 2048, 1024
PART_BYTES, LEAST_PARTS = 64 << 20, 16
#: Repeated vectors that are sent to every task; more are merged.
FEW_KEYS = 100_000
_KEY = ["k1", "k2"]


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) that can have a cosine: finite, not zero, of the usual length."""
    parts = F.col("embedding")
    finite = F.forall(parts, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    good = vectors.where(
        F.col("vec_id").isNotNull() & parts.isNotNull() & finite & F.exists(parts, lambda v: v != 0)
    )
    return good.select(
        "vec_id", "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2")
    )


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class MultiIndex:
    """Centroids of both halves; a cell's number is first * centroids + second."""

    first: np.ndarray
    second: np.ndarray

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, half = _unit(x), self.first.shape[1]
        return tuple(
            (c * c).sum(axis=1) - 2 * part @ c.T + (part * part).sum(axis=1, keepdims=True)
            for c, part in ((self.first, x[:, :half]), (self.second, x[:, half:]))
        )

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def visited(self, a: np.ndarray, b: np.ndarray, filled: np.ndarray, rows: np.ndarray, wanted: int) -> np.ndarray:
        """Which of the ``filled`` cells come first in order of summed distance, until they hold as many rows as wanted.

        ``rows`` has the rows of each of them.  Equal sums go by the order of the centroids
        of the first half, then of the second.
        """
        many = len(self.second)
        first, second = filled // many, filled % many
        sums = a[first] + b[second]
        low, high = sums.min(initial=np.inf), sums.max(initial=-np.inf)
        # Sums are sorted in the one of 1,024 equal steps alone in which the wanted number is reached.
        step = np.zeros(len(sums), np.int64)
        if high > low:
            step = ((sums - low) * (1023 / (high - low))).astype(np.int64)
        upto = np.cumsum(np.bincount(step, weights=rows))
        last = int(np.searchsorted(upto, wanted))
        seen = step < last
        at = np.flatnonzero(step == last)
        if len(at):
            places = (np.argsort(np.argsort(x, kind="stable")) for x in (a, b))
            i, j = (place[some[at]] for place, some in zip(places, (first, second)))
            at = at[np.lexsort((j, i, sums[at]))]
            before = np.cumsum(rows[at]) - rows[at] + rows[seen].sum()
            seen[at[before < wanted]] = True
        return seen

    def walk(self, a: np.ndarray, b: np.ndarray, rows: np.ndarray, wanted: int) -> list[int]:
        """Cells with rows in order of summed distance, until they hold as many as wanted."""
        filled = np.flatnonzero(rows)
        cells = filled[self.visited(a, b, filled, rows[filled], wanted)]
        first, second = (np.argsort(np.argsort(x, kind="stable")) for x in (a, b))
        i, j = cells // len(self.second), cells % len(self.second)
        return cells[np.lexsort((second[j], first[i], a[i] + b[j]))].tolist()


def centroids(x: np.ndarray, many: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm from rows drawn at random; an empty centroid stays where it is."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), many, replace=len(x) < many)].copy()
    for _ in range(rounds):
        nearest = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=many)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return c


def fit(sample: np.ndarray, rows: int, cell_rows: int = 128, most: int = 256) -> MultiIndex:
    """Centroids so that a cell holds about ``cell_rows`` rows, within 6 and ``most`` a half."""
    x = _unit(sample)
    many = int(min(max(round((rows / cell_rows) ** 0.5), 6), most))
    half = x.shape[1] // 2
    return MultiIndex(centroids(x[:, :half], many), centroids(x[:, half:], many))


def _with_cells(rows: DataFrame, index: MultiIndex) -> DataFrame:
    at = rows.columns.index("embedding")
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cells = pa.array(shared.value.cells(_matrix(batch.column(at))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cell"])

    return rows.mapInArrow(run, rows.withColumn("cell", F.lit(0)).schema)


@dataclass
class Parts:
    """Cells with rows, in order, and the first part of each and how many it takes; a part's cells follow one another."""

    cells: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    span: np.ndarray

    @classmethod
    def of(cls, cells: np.ndarray, rows: np.ndarray, most: int) -> Parts:
        """Parts of at most ``most`` rows; a cell of more is dealt out to several."""
        first, span = np.zeros(len(cells), np.int64), np.ones(len(cells), np.int64)
        part, held = 0, 0
        for i, n in enumerate(rows.tolist()):
            if held and held + n > most:
                part, held = part + 1, 0
            first[i], span[i], held = part, -(-n // most), held + n
            if n > most:
                part, held = part + int(span[i]), 0
        return cls(cells, rows, first, span)

    def __len__(self) -> int:
        return int((self.first + self.span).max(initial=0))

    def places(self) -> list[tuple[int, int]]:
        """Of each part, where its cells begin and end."""
        numbers = np.arange(len(self))
        return list(zip(np.searchsorted(self.first + self.span, numbers, "right").tolist(), np.searchsorted(self.first, numbers, "right").tolist()))

    def table(self, spark: SparkSession) -> DataFrame:
        """(cell, place, first, span): one row per cell with rows, 256 x 256 at most."""
        columns = [self.cells.astype(np.int32), np.arange(len(self.cells)), self.first, self.span]
        return spark.createDataFrame(pa.table([pa.array(c) for c in columns], names=["cell", "place", "first", "span"]))


def _visits(queries: DataFrame, index: MultiIndex, parts: Parts, wanted: int, pack: int = 256) -> DataFrame:
    """(part, kind, a, b, embedding, seen): each query in each part that it visits.

    ``a`` and ``b`` are its key, and ``seen`` has a bit for each cell of the part.
    """
    shared = queries.sparkSession.sparkContext.broadcast((index, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, met = shared.value
        places = met.places()
        for batch in batches:
            for start in range(0, len(batch), pack):
                few = batch.slice(start, pack)
                a, b = own.distances(_matrix(few.column(2)))
                seen = np.stack([own.visited(a[q], b[q], met.cells, met.rows, wanted) for q in range(len(few))])
                for part, (low, high) in enumerate(places):
                    here = seen[:, low:high]
                    some = np.flatnonzero(here.any(axis=1))
                    if len(some):
                        bits = [row.tobytes() for row in np.packbits(here[some], axis=1)]
                        k1, k2, vectors = (c.take(pa.array(some)) for c in few.columns)
                        numbers = (pa.array(np.full(len(some), n, np.int32)) for n in (part, 1))
                        yield pa.RecordBatch.from_arrays([*numbers, k1, k2, vectors, pa.array(bits, pa.binary())], names=_PASSING)

    of = queries.select(*_KEY, "embedding")
    kind = of.schema["embedding"].dataType.simpleString()
    return of.mapInArrow(run, f"part int, kind int, a long, b long, embedding {kind}, seen binary")


_PASSING = ["part", "kind", "a", "b", "embedding", "seen"]


class Chunk:
    """Some rows of a part in order of their cells; ``places`` count the part's cells."""

    def __init__(self, ids: np.ndarray, places: np.ndarray, rows: np.ndarray):
        self.ids, self.places, self.rows = ids, places, rows
        self._scale = 1 / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)

    def unit(self) -> np.ndarray:
        return (self.rows * self._scale).astype(np.float32)


class Best:
    """The best rows so far of some queries that pass through a part."""

    def __init__(self, queries: np.ndarray, seen: np.ndarray, top: int):
        self.queries, self.seen, self.top = queries, seen, top
        self._unit = _unit(queries).astype(np.float32)
        self._least = np.full(len(queries), -np.inf)
        self._found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self._more: list[tuple[np.ndarray, ...]] = []
        #: Twice what a product of unit vectors in single precision can be off.
        self._slack = (queries.shape[1] + 8) * 2.0**-23

    def meet(self, chunk: Chunk) -> None:
        first, last = int(chunk.places[0]), int(chunk.places[-1])
        who = np.flatnonzero(self.seen[:, first : last + 1].any(axis=1))
        if not len(who):
            return
        near = self._unit[who] @ chunk.unit().T
        low = self._least[who] - self._slack
        fresh = np.flatnonzero(np.isneginf(low))
        if len(fresh):
            low[fresh] = -1.5
            if len(chunk.ids) > self.top:
                some = np.where(self.seen[who[fresh]][:, chunk.places], near[fresh], np.float32(-2))
                low[fresh] = np.maximum(np.partition(some, -self.top, axis=1)[:, -self.top] - self._slack, -1.5)
        hits = np.flatnonzero(near >= low.astype(np.float32)[:, None])
        q, r = who[hits // len(chunk.ids)], hits % len(chunk.ids)
        kept = self.seen[q, chunk.places[r]]
        q, r = q[kept], r[kept]
        query, rows = self.queries[q], chunk.rows[r].astype(np.float64)
        # Summed row by row in one order, so that equal vectors get equal scores.
        score = (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum(axis=1)))
        self._more.append((q, chunk.ids[r], score))
        if len(fresh) or sum(len(m[0]) for m in self._more) > len(self.queries):
            self.found()

    def found(self) -> tuple[np.ndarray, ...]:
        """(query, id, score) of the best rows, ties to smaller ids."""
        q, ids, score = (np.concatenate(c) for c in zip(self._found, *self._more))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        self._least[q[place == self.top - 1]] = score[place == self.top - 1]
        self._found, self._more = tuple(c[place < self.top] for c in (q, ids, score)), []
        return self._found


def _is_single(vectors: DataFrame) -> bool:
    return vectors.schema["embedding"].dataType.elementType.simpleString() == "float"


def _rank(passing: DataFrame, parts: Parts, top: int) -> DataFrame:
    """(k1, k2, vec_id, score): the best of each query among the cells of a part that it visits.

    The rows of a part come before its queries, in order of their cells.
    """
    shared = passing.sparkSession.sparkContext.broadcast(parts)
    kept_as = np.float32 if _is_single(passing) else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value.places()
        number, chunks = None, []
        for batch in batches:
            part, kind = (batch.column(i).to_numpy() for i in range(2))
            # Runs of one part and kind.
            ends = np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for low, high in zip([0, *ends], [*ends, len(batch)]):
                if low == high:
                    continue
                if part[low] != number:
                    number, chunks = part[low], []
                first, last = places[number]
                most = PACK_QUERIES if kind[low] else PACK_ROWS
                for start in range(low, high, most):
                    some = batch.slice(start, min(most, high - start))
                    a, b = (some.column(i).to_numpy() for i in (2, 3))
                    if not kind[low]:
                        chunks.append(Chunk(a.copy(), b - first, _matrix(some.column(4), kept_as).copy()))
                        continue
                    bits = np.frombuffer(b"".join(some.column(5).to_pylist()), np.uint8).reshape(len(some), -1)
                    best = Best(_matrix(some.column(4)), np.unpackbits(bits, axis=1, count=last - first).view(bool), top)
                    for chunk in chunks:
                        best.meet(chunk)
                    q, ids, score = best.found()
                    if len(q):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c) for c in (a[q], b[q], ids, score)], names=[*_KEY, "vec_id", "score"]
                        )

    return passing.mapInArrow(run, "k1 long, k2 long, vec_id long, score double")


def _kept(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Each vector under its ``most`` smallest ids, and how many rows that makes.

    Keys alone are compared; vectors move only where more repeat than can be sent out.
    """
    per_id = rows.groupBy("vec_id", *_KEY).agg(F.count("*").alias("n"))
    own = Window.partitionBy(*_KEY).orderBy("vec_id")
    per_key = per_id.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.count("*").alias("ids"))
    sizes = per_key.agg(F.sum(F.least("ids", F.lit(most))), F.count_if(F.col("n") > 1)).first()
    if not sizes[1]:
        return rows, sizes[0]
    again = per_key.where("n > 1").select(*_KEY)
    again = F.broadcast(again) if sizes[1] <= FEW_KEYS else again.hint("merge")
    chosen = per_id.join(again, _KEY, "left_semi").withColumn("copy", F.row_number().over(own)).where(F.col("copy") <= most)
    listed = stored(chosen.groupBy(*_KEY).agg(F.collect_list("vec_id").alias("ids")), "ann-repeats")
    listed = F.broadcast(listed) if sizes[1] <= FEW_KEYS else listed.hint("merge")
    met = rows.join(listed, _KEY, "left")
    repeated = met.where(F.array_contains("ids", F.col("vec_id"))).dropDuplicates(["vec_id", *_KEY])
    return met.where("ids IS NULL").select(rows.columns).unionByName(repeated.select(rows.columns)), sizes[0]


def _sample(kept: DataFrame, total: int) -> np.ndarray:
    """Vectors of the smallest hashed ids, at most ``SAMPLE_ROWS``."""
    place = F.xxhash64("vec_id")
    wanted = min(SAMPLE_ROWS, total)
    # Only rows of small hashes are put in order; where ids repeat that may be too few.
    bound = -(2**63) + min(2**64 - 1, 2**64 * 2 * SAMPLE_ROWS // total)
    for some in (kept.where(place <= bound), kept):
        found = some.orderBy(place, "vec_id").limit(SAMPLE_ROWS).select("embedding").toArrow()
        if len(found) >= wanted:
            break
    return _matrix(found.column(0).combine_chunks())


def search(
    vectors: DataFrame,
    is_query: str,
    top: int = 5,
    share: float = 0.75,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of every query row.

    ``is_query`` is a condition on ``vec_id``.  ``share`` of all distinct rows is ranked
    for a query: vectors without clusters, as in the test data, need a large one for a
    recall over 0.9, clustered ones a small one.

    Null ids and vectors that are null, zero, or hold null or non-finite components take
    no part, nor do vectors of another length than most rows have (of equally common
    lengths, the longest counts).  Rows that repeat an id and vector count as one.  A
    query is not its own neighbour.  Ties go to the smaller id.  Without usable rows the
    result is empty.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("embedding")))
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    rows = rows.where(F.size("embedding") == lengths["n"])
    if lengths["n"] == 1:  # a single component has no halves
        rows = rows.withColumn("embedding", F.concat("embedding", F.array(F.lit(0).cast("float"))))
    kept, total = _kept(rows, top + 1)
    index = fit(_sample(kept, total), total)
    cells = stored(_with_cells(kept.select("vec_id", "embedding"), index), "ann-cells")

    # One row per cell: at most 256 x 256.
    per_cell = cells.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").toArrow()
    width = lengths["n"] * (4 if _is_single(cells) else 8)
    most = max(min(-(-total // LEAST_PARTS), PART_BYTES // width), 1)
    parts = Parts.of(*(per_cell.column(i).to_numpy().astype(np.int64) for i in range(2)), most)
    piece = F.when(F.col("span") > 1, F.pmod(F.xxhash64("vec_id", "embedding"), F.col("span"))).otherwise(0)
    part = (F.col("first") + piece).cast("int")
    members = cells.join(F.broadcast(parts.table(spark)), "cell").select(
        part.alias("part"), F.lit(0).alias("kind"), F.col("vec_id").alias("a"), F.col("place").alias("b"), "embedding",
        F.lit(None).cast("binary").alias("seen"),
    )
    queries = rows.where(is_query)
    # By number, since little data is much work here, which adaptive execution would put in one task.
    spread = queries.repartition(max(len(parts), LEAST_PARTS), *_KEY)
    visits = _visits(
        spread.groupBy(*_KEY).agg(F.first("embedding").alias("embedding")), index, parts,
        max(int(np.ceil(share * total)), top + 1),
    )
    passing = members.unionByName(visits).repartition(2 * len(parts), "part").sortWithinPartitions("part", "kind", "b")
    ranked = _rank(passing, parts, top + 1)
    best = Window.partitionBy(*_KEY).orderBy(F.desc("score"), "vec_id")
    found = ranked.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top + 1)
    # Either side grows with the table, whatever its estimate says.
    answers = queries.select(F.col("vec_id").alias("query_id"), *_KEY).distinct().join(found.hint("merge"), _KEY)
    own = Window.partitionBy("query_id", *_KEY).orderBy(F.desc("score"), "vec_id")
    return (
        answers.where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )
