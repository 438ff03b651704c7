"""Exact repeats between and within texts, found by distributed suffix arrays.

Every string of ``LENGTH`` bytes has an anchor, the 32-byte gram in it with the smallest
hash; equal strings have equal anchors.  Successive strings with one anchor are a run, and
its bytes are the run's context.  Suffixes that share ``LENGTH`` bytes thus meet by their
anchor, wherever they are, and no others need to:

1. Anchors that occur once are dropped.
2. Runs of an anchor with equal contexts are one class; of its members only the first can
   hold the first occurrence of anything.
3. Where an anchor has several classes, the contexts of their first members go into an
   enhanced suffix array.  A stack scan over its common-prefix lengths walks the interval
   tree; intervals whose left extensions differ are the maximal repeats, each with all its
   occurrences, and all but the earliest lose the bytes.

   An anchor of more than ``MOST_CONTEXTS`` classes has no such array: its strings of
   ``LENGTH`` bytes are grouped by their hashes, and all but the earliest of each are later.

All steps but the scan of one bucket of contexts are joins and aggregations that combine
before they shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from loanbook.llm.storage import stored
from loanbook.llm.text import Block, blocks, mix

LENGTH = 100
GRAM = 32
_GRAMS = LENGTH - GRAM + 1
_PLACE_BITS = 20
_PLACES = np.uint64((1 << _PLACE_BITS) - 1)
_PIECE = 1 << 19
_STRING_ROWS = 1 << 10
BUCKET_CONTEXTS = 20_000
MOST_CONTEXTS = 2_000
"""Anchors of more different contexts than this are not scanned in one task."""


def _pieces(block: Block) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """The block, or parts of an over-long text, small enough to number their bytes in 20 bits.

    Parts overlap so that every string lies in one and starts in one only.
    """
    if len(block.data) < (1 << _PLACE_BITS):
        yield block, np.arange(block.texts), block.bounds[:-1] * 0
        return
    for text in range(block.texts):
        start, end = block.bounds[text], block.bounds[text + 1]
        for first in range(start, max(end - LENGTH + 1, start + 1), _PIECE):
            last = min(first + _PIECE + LENGTH - 1, end)
            part = Block(block.data[first:last], np.array([0, last - first]), block.first)
            yield part, np.array([text]), np.array([first - start])


def runs_of(block: Block) -> tuple[np.ndarray, ...]:
    """(text, start, length in strings, anchor offset, anchor hash, context hash) of all runs."""
    found = [_runs_of(part, text, shift) for part, text, shift in _pieces(block)]
    return tuple(np.concatenate(columns) for columns in zip(*found))


def _runs_of(block: Block, text: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, ...]:
    n, data = len(block.data), block.data
    strings = n - LENGTH + 1
    if strings <= 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty, empty, empty
    sums, place = block.prefix_hash(), np.arange(n - GRAM + 1)
    gram = block.slice_hash(sums, place, place + GRAM)
    # The place in the low bits picks the last of equal grams.
    low = (gram & ~_PLACES) | (_PLACES - place.astype(np.uint64))
    reach = 1
    while reach * 2 <= _GRAMS:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: len(low) - (_GRAMS - reach)], low[_GRAMS - reach :])[:strings]
    anchor = (_PLACES - (low & _PLACES)).astype(np.int64)
    owner = np.repeat(np.arange(block.texts), np.diff(block.bounds))[:strings]
    inside = np.arange(strings) + LENGTH <= block.bounds[owner + 1]
    change = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]))
    first = np.flatnonzero(inside & change)
    last = np.flatnonzero(inside & np.concatenate((change[1:] | ~inside[1:], [True])))
    context = block.slice_hash(sums, first, last + LENGTH)
    offset = anchor[first] - first
    context = mix(context + offset.astype(np.uint64))
    own = owner[first]
    return (
        text[own], first - block.bounds[own] + shift[own], last - first + 1, offset,
        gram[anchor[first]].view(np.int64), context.view(np.int64),
    )


class SuffixArray:
    """Suffixes of some contexts in order, with the common prefixes of neighbours.

    The suffixes are those that start a string of ``LENGTH`` bytes.  Contexts are laid out
    in rows padded with zeros, so that a suffix ends with its context; of suffixes that the
    padding makes equal the shorter comes first.
    """

    def __init__(self, contexts: list[bytes]) -> None:
        sizes = np.array([len(c) for c in contexts], dtype=np.int64)
        longest = int(sizes.max())
        table = np.zeros((len(contexts), 2 * longest), dtype=np.uint8)
        for row, context in zip(table, contexts):
            row[: len(context)] = np.frombuffer(context, dtype=np.uint8)
        many = sizes - LENGTH + 1
        row = np.repeat(np.arange(len(contexts)), many)
        place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        room = sizes[row] - place
        shorter = np.argsort(room, kind="stable")
        row, place, room = row[shorter], place[shorter], room[shorter]
        flat = table.ravel()
        start = row * (2 * longest) + place
        whole = np.ndarray((len(flat) - longest + 1,), dtype=f"V{longest}", buffer=flat, strides=(1,))
        order = np.argsort(whole[start], kind="stable")
        self.row, self.place, start, room = row[order], place[order], start[order], room[order]
        self.before = np.where(self.place > 0, flat[np.maximum(start - 1, 0)].astype(np.int64), -1)
        self.common = np.zeros(len(start), dtype=np.int64)
        heads = np.ndarray((len(flat) - LENGTH + 1,), dtype=f"V{LENGTH}", buffer=flat, strides=(1,))
        step = 1 << 14
        for at in range(1, len(start), step):
            a, b = start[at - 1 : at - 1 + step], start[at : at + step]
            a = a[: len(b)]
            most = np.minimum(room[at - 1 : at - 1 + len(b)], room[at : at + step])
            same = np.flatnonzero(heads[a] == heads[b])
            length = np.zeros(len(b), dtype=np.int64)
            length[same] = LENGTH
            while len(same):
                same = same[length[same] < most[same]]
                same = same[flat[a[same] + length[same]] == flat[b[same] + length[same]]]
                length[same] += 1
            self.common[at : at + step] = length

    def maximal_repeats(self) -> Iterator[tuple[int, int, int]]:
        """(length, first, last) of each repeat of at least ``LENGTH`` bytes that no byte before
        or after extends in all its occurrences, which are the suffixes ``first`` to ``last``."""
        stack: list[list[int]] = []  # length, first, byte before (-1: several, or unknown)
        common, before = self.common.tolist(), self.before.tolist()
        for i in range(1, len(common) + 1):
            length = common[i] if i < len(common) else 0
            if not length and not stack:
                continue
            first, symbol = i - 1, before[i - 1]
            while stack and stack[-1][0] > length:
                top = stack.pop()
                symbol = top[2] if top[2] == symbol else -1
                first = top[1]
                if symbol == -1:
                    yield top[0], first, i - 1
            if stack and stack[-1][0] == length:
                if stack[-1][2] != symbol:
                    stack[-1][2] = -1
            elif length:
                stack.append([length, first, symbol])


def _anchored(documents: DataFrame) -> DataFrame:
    """(id, version, start, strings, anchor, context) of every run of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                text, start, strings, _, anchor, context = runs_of(block)
                if not len(text):
                    continue
                rows = pa.array(text + block.first)
                small = [pa.array(v.astype(np.int32)) for v in (start, strings)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), *small, pa.array(anchor), pa.array(context)],
                    names=["id", "version", "start", "strings", "anchor", "context"],
                )

    keys = documents.select("id", "version").schema
    numbers = [StructField(n, IntegerType()) for n in ("start", "strings")]
    hashes = [StructField(n, LongType()) for n in ("anchor", "context")]
    return documents.select("id", "version", "text").mapInArrow(run, StructType([*keys, *numbers, *hashes]))


def _with_contexts(documents: DataFrame, firsts: DataFrame) -> DataFrame:
    """Add the bytes of the runs ``firsts`` to them."""
    schema = StructType(
        [
            StructField("anchor", LongType()), StructField("context", LongType()), *documents.select("id", "version").schema,
            StructField("start", IntegerType()), StructField("strings", IntegerType()), StructField("data", BinaryType()),
        ]
    )
    return _wanted(documents, firsts).mapInArrow(_cut, schema)


def _wanted(documents: DataFrame, firsts: DataFrame) -> DataFrame:
    """(id, version, text, wanted): the documents that hold runs of ``firsts``, with these."""
    wanted = firsts.groupBy(F.col("id").alias("_id"), F.col("version").alias("_version")).agg(
        F.collect_list(F.struct("anchor", "context", "start", "strings")).alias("wanted")
    )
    same = documents["id"].eqNullSafe(wanted["_id"]) & (documents["version"] == wanted["_version"])
    return documents.join(wanted, same).select("id", "version", F.col("text").cast("binary").alias("text"), "wanted")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted runs and their bytes."""
    for batch in batches:
        wanted = batch.column(3)
        rows = pa.array(np.repeat(np.arange(len(batch)), wanted.value_lengths().to_numpy()))
        parts = wanted.flatten()
        anchor, context, start, strings = (parts.field(i) for i in range(4))
        texts, row = batch.column(2), rows.to_numpy()
        at, end = start.to_numpy(), start.to_numpy() + strings.to_numpy() + LENGTH - 1
        views = {int(r): memoryview(texts[int(r)].as_buffer()) for r in np.unique(row)}
        data = [bytes(views[int(r)][a:b]) for r, a, b in zip(row, at, end)]
        yield pa.RecordBatch.from_arrays(
            [anchor, context, batch.column(0).take(rows), batch.column(1).take(rows), start, strings,
             pa.array(data, pa.binary())],
            names=["anchor", "context", "id", "version", "start", "strings", "data"],
        )


def _scan_contexts(rows: pd.DataFrame) -> list[tuple[int, int, int]]:
    """(row, first, end) of the strings, numbered within their context, that occur earlier.

    Rows are in the order of the documents and starts, so of the occurrences of a repeat
    the one with the smallest (document, start) is the earliest.
    """
    contexts = rows["data"].tolist()
    array = SuffixArray(contexts)
    document, start = rows["document"].to_numpy(), rows["start"].to_numpy()
    # +1 where a range begins and -1 where it ends; repeats within repeats overlap.
    edges = np.zeros((len(contexts), max(map(len, contexts)) - LENGTH + 2), dtype=np.int64)
    for length, first, last in array.maximal_repeats():
        row, place = array.row[first : last + 1], array.place[first : last + 1]
        own, at = document[row], start[row] + place
        earliest = np.lexsort((at, own))[0]
        later = (own != own[earliest]) | (at != at[earliest])
        np.add.at(edges, (row[later], place[later]), 1)
        np.add.at(edges, (row[later], place[later] + length - LENGTH + 1), -1)
    inside = np.cumsum(edges, axis=1) > 0
    change = np.diff(np.pad(inside, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(change == 1)
    _, end = np.nonzero(change == -1)
    return list(zip(row.tolist(), first.tolist(), end.tolist()))


def _strings(documents: DataFrame, firsts: DataFrame) -> DataFrame:
    """(id, version, run, anchor, string, start): the strings of the runs ``firsts`` and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _cut(batches):
            for at in range(0, len(whole), _STRING_ROWS):
                batch = whole.slice(at, _STRING_ROWS)
                data = batch.column(batch.schema.get_field_index("data")).to_pylist()
                many = np.array([len(d) for d in data], dtype=np.int64) - LENGTH + 1
                bounds = np.concatenate(([0], np.cumsum(many + LENGTH - 1)))
                block = Block(np.frombuffer(b"".join(data), dtype=np.uint8), bounds, 0)
                row = np.repeat(np.arange(len(data)), many)
                place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                first = bounds[row] + place
                string = block.slice_hash(block.prefix_hash(), first, first + LENGTH)
                rows = pa.array(row)
                own = [batch.column(batch.schema.get_field_index(n)).take(rows) for n in ("id", "version", "start", "anchor")]
                start = own[2].to_numpy() + place
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(string.view(np.int64)), pa.array(start.astype(np.int32))],
                    names=["id", "version", "run", "anchor", "string", "start"],
                )

    numbers = [
        StructField("run", IntegerType()), StructField("anchor", LongType()),
        StructField("string", LongType()), StructField("start", IntegerType()),
    ]
    return _wanted(documents, firsts).mapInArrow(run, StructType([*documents.select("id", "version").schema, *numbers]))


def _later_strings(strings: DataFrame) -> DataFrame:
    """(id, version, first, end): ranges of the strings that are not the earliest of their kind."""
    place = F.struct("id", "start", "version", "run")
    earliest = (
        strings.groupBy("anchor", "string")
        .agg(F.min(place).alias("earliest"), F.max(place).alias("last"))
        .where("earliest <> last")
        .select(F.col("anchor").alias("_a"), F.col("string").alias("_s"), "earliest")
    )
    same = (strings["anchor"] == earliest["_a"]) & (strings["string"] == earliest["_s"])
    later = strings.join(earliest, same).where(
        ~(F.col("id").eqNullSafe(F.col("earliest.id")) & (F.col("start") == F.col("earliest.start")))
    )
    # A run has at most ``_GRAMS`` strings; successive ones are one range.
    runs = later.groupBy("id", "version", "run", "anchor").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    firsts = F.filter("starts", lambda at: ~F.array_contains("starts", at - 1))
    lasts = F.filter("starts", lambda at: ~F.array_contains("starts", at + 1))
    ranges = F.arrays_zip(firsts.alias("first"), lasts.alias("last"))
    return runs.select("id", "version", F.explode(ranges).alias("range")).select(
        "id", "version", F.col("range.first").alias("first"), (F.col("range.last") + 1).alias("end")
    )


def repeated_strings(documents: DataFrame) -> DataFrame:
    """(id, version, first, end): ranges of starts of strings that also occur earlier."""
    runs = _anchored(documents)
    often = stored(
        runs.select("anchor").groupBy("anchor").count().where("count > 1").select("anchor"), "repeat-anchors"
    )
    shared = stored(runs.join(often, "anchor"), "repeat-runs")
    place = F.struct("id", "start", "version", "strings")
    classes = shared.groupBy("anchor", "context").agg(F.min(place).alias("first"), F.count("*").alias("members"))
    classes = stored(classes, "repeat-classes")

    # Members of a class beyond its first: all their strings occur earlier.
    firsts = classes.where("members > 1").select(
        F.col("anchor").alias("_a"), F.col("context").alias("_c"), "first"
    )
    later = shared.join(firsts, (shared["anchor"] == firsts["_a"]) & (shared["context"] == firsts["_c"])).where(
        ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("start") == F.col("first.start")))
    )
    copied = later.select("id", "version", F.col("start").alias("first"), (F.col("start") + F.col("strings")).alias("end"))

    # First members of the classes of an anchor that has several.
    several = classes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    edges = stored(classes.join(several, "anchor").select("anchor", "context", "first.*", "n"), "repeat-edges")
    crowded, edges = edges.where(F.col("n") > MOST_CONTEXTS).drop("n"), edges.where(F.col("n") <= MOST_CONTEXTS).drop("n")
    buckets = max(1, -(-edges.count() // BUCKET_CONTEXTS))
    id_field = documents.schema["id"]
    schema = StructType(
        [
            StructField("id", id_field.dataType), documents.schema["version"],
            StructField("first", IntegerType()), StructField("end", IntegerType()),
        ]
    )
    id_type = to_arrow_type(id_field.dataType)
    version_type = to_arrow_type(documents.schema["version"].dataType)

    def scan(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        rank = ids.dictionary_encode()
        names = rank.dictionary.to_pylist()
        order = sorted(range(len(names)), key=lambda i: names[i])
        position = np.empty(len(names) + 1, dtype=np.int64)
        position[order] = np.arange(len(names))
        position[-1] = -1  # null comes first
        code = rank.indices.fill_null(len(names)).to_numpy()
        rows = pd.DataFrame(
            {"data": table.column("data").to_pylist(), "document": position[code], "start": table.column("start").to_numpy()}
        )
        lost = _scan_contexts(rows)
        row = pa.array([r for r, _, _ in lost], pa.int64())
        start = rows["start"].to_numpy()
        return pa.table(
            [
                ids.take(row).cast(id_type),
                table.column("version").combine_chunks().take(row).cast(version_type),
                pa.array([int(start[r]) + a for r, a, _ in lost], pa.int32()),
                pa.array([int(start[r]) + b for r, _, b in lost], pa.int32()),
            ],
            names=["id", "version", "first", "end"],
        )

    contexts = _with_contexts(documents, edges).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    found = contexts.groupBy("bucket").applyInArrow(scan, schema)
    found = copied.unionByName(found)
    if crowded.isEmpty():
        return found
    # Not stored: within one query, all joins with the documents read the same shuffle of the texts.
    # The strings are cut once, as both sides of their join read all columns of one shuffle.
    return found.unionByName(_later_strings(_strings(documents, crowded).repartition("anchor", "string")))


def _documents(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return df.select(F.col(id_column).alias("id"), F.hash(text).alias("version"), text.alias("text"))


def covered(ranges: np.ndarray) -> np.ndarray:
    """Merge (first, end) ranges of string starts into sorted byte ranges that they cover."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    start, end = ranges[:, 0], np.maximum.accumulate(ranges[:, 1] + LENGTH - 1)
    new = np.concatenate(([True], start[1:] > end[:-1]))
    first = np.flatnonzero(new)
    return np.stack([start[first], end[np.append(first[1:], len(start)) - 1]], axis=1)


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document its bytes, the bytes and spans removed, and what is kept.

    A byte goes if a string of ``LENGTH`` bytes over it also starts earlier: in a document
    with a smaller id (null first) or earlier in its own.  ``kept`` is the rest as bytes,
    ``spans`` the removed (start, end) ranges.  A null or short text loses nothing.  Rows
    that share an id are not earlier than one another, unless at an earlier start.  An
    empty table gives no rows.  Other columns are ignored.
    """
    documents = _documents(df, id_column, text_column)
    ranges = (
        repeated_strings(documents)
        .groupBy(F.col("id").alias("_id"), F.col("version").alias("_version"))
        .agg(F.collect_set(F.struct("first", "end")).alias("ranges"))
    )
    same = documents["id"].eqNullSafe(ranges["_id"]) & (documents["version"] == ranges["_version"])
    joined = documents.join(ranges, same, "left").select("id", F.col("text").cast("binary").alias("text"), "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for text, found in zip(batch.column(1), batch.column(2)):
                data, own = text.as_buffer().to_pybytes(), []
                if found.is_valid:
                    pairs = found.values
                    both = np.stack([pairs.field(0).to_numpy(), pairs.field(1).to_numpy()], axis=1).astype(np.int64)
                    own = covered(both).tolist()
                edges = [0, *(edge for span in own for edge in span), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "end": b} for a, b in own])
            sizes = batch.column(1).cast(pa.large_binary())
            lengths = pa.array([len(v.as_buffer()) for v in sizes], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lengths, pa.array(spans, _SPANS), pa.array(kept, pa.binary())],
                names=[id_column, "n_bytes", "spans", "kept"],
            )

    fields = joined.select(F.col("id").alias(id_column)).schema
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    kinds = [("n_bytes", LongType()), ("spans", ArrayType(span)), ("kept", BinaryType())]
    return joined.mapInArrow(run, StructType([*fields, *(StructField(name, kind) for name, kind in kinds)]))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def repeat_table(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts of ``remove_repeats`` and the digest of what it keeps."""
    sizes = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return remove_repeats(df, id_column, text_column).select(
        id_column,
        "n_bytes",
        sizes.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
