"""Vector bin packing: examples into training sequences under several limits at once.

A sequence has room for so many tokens, so many segments (pieces of examples) and so
many loss-bearing tokens.  An open sequence takes, among the pieces that fit in every
dimension, the one whose demands have the largest dot product with the room that is
left.  When nothing fits, the piece with the largest product is cut so that it fills
the sequence.  A sequence that ends short is dealt out over lengths that are powers of
two, which need no padding.

Each task packs the rows it reads, a pool of pieces at a time: nothing is shuffled, and
memory is bounded by the pool and the longest example.  A retried task packs again.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

SPECIAL = "<|endoftext|>"
END_OF_EXAMPLE = 0
_TASK_SHIFT = 40
_COLUMNS = ["start", "length", "loss_tokens", "ids_crc32", "doc_tokens", "sequence_id", "segment", "offset"]


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments and loss-bearing tokens of a sequence."""

    tokens: int = 1024
    segments: int = 128
    loss_tokens: int = 1024


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary: its rank file and the pattern that splits text."""

    ranks: str
    pattern: str

    def encode(self, text: str) -> np.ndarray:
        parts = [_encoding(self).encode_to_numpy(part, disallowed_special=()) for part in text.split(SPECIAL)]
        ids = parts[:1]
        for part in parts[1:]:
            ids += [np.array([len(_encoding(self)._mergeable_ranks)], dtype=np.uint32), part]
        return np.concatenate([*ids, [END_OF_EXAMPLE]]).astype("<u4")


@cache
def _encoding(vocabulary: Vocabulary):
    import tiktoken

    with open(vocabulary.ranks, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})


class Packer:
    """Packs a pool of pieces.  A piece is (example, start, length, prompt tokens in it)."""

    def __init__(self, limits: Limits, first_sequence: int) -> None:
        self.limits = limits
        self.sequence = first_sequence
        self.full = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=float)

    def pack(self, pieces: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """Yield (example, start, length, prompt tokens, sequence, segment, offset)."""
        length = np.array([p[2] for p in pieces], dtype=np.int64)
        prompt = np.array([p[3] for p in pieces], dtype=np.int64)
        start = np.array([p[1] for p in pieces], dtype=np.int64)
        left = len(pieces)
        while left:
            room = self.full.copy()
            taken: list[tuple[int, int, int, int]] = []
            while room[0] >= 1 and room[1] >= 1 and left:
                weight = room / self.full**2
                loss = length - prompt
                product = np.where(length > 0, length * weight[0] + weight[1] + loss * weight[2], -1.0)
                fits = (length <= room[0]) & (loss <= room[2]) & (length > 0)
                best = int(np.argmax(np.where(fits, product, -1.0)))
                size = int(length[best])
                if not fits[best]:  # nothing fits whole
                    best = int(np.argmax(product))
                    size = int(min(length[best], room[0], prompt[best] + room[2]))
                    if size < 1:
                        break
                quiet = int(min(prompt[best], size))
                taken.append((pieces[best][0], int(start[best]), size, quiet))
                start[best] += size
                length[best] -= size
                prompt[best] -= quiet
                left -= length[best] == 0
                room -= (size, 1, size - quiet)
            yield from self.close(taken)

    def close(self, taken: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """Lay pieces out in one sequence, or in several whose lengths are powers of two."""
        total = sum(p[2] for p in taken)
        sizes = [total] if total == self.limits.tokens else [1 << b for b in range(total.bit_length())[::-1] if total >> b & 1]
        rest = list(reversed(taken))
        for size in sizes:
            offset = segment = 0
            while offset < size:
                example, start, length, quiet = rest.pop()
                now = min(length, size - offset)
                if now < length:
                    rest.append((example, start + now, length - now, max(quiet - now, 0)))
                yield example, start, now, min(quiet, now), self.sequence, segment, offset
                offset += now
                segment += 1
            self.sequence += 1


def pack_sequences(
    df: DataFrame,
    vocabulary: Vocabulary,
    limits: Limits = Limits(),
    id_column: str = "doc_id",
    text_column: str = "text",
    prompt_column: str | None = None,
    pool: int = 2048,
) -> DataFrame:
    """One row per piece: where it lies in its example and in its sequence.

    An example is the ids of its prompt (which bear no loss) and text, then id 0.  Each
    id lies in exactly one piece.  ``ids_crc32`` is over the ids as little-endian
    unsigned 32-bit numbers, ``doc_tokens`` the length of the example.

    Null or empty text: the example is the id 0 alone.  Repeated rows, also with equal
    ids, are examples of their own; a null id stays null.  Very long texts are cut over
    as many sequences as they need.  An empty table gives no rows.  Other columns are
    ignored.
    """
    if limits.tokens & (limits.tokens - 1):
        raise ValueError("the token limit must be a power of two")
    texts = df.select(
        F.col(id_column),
        F.coalesce(F.col(prompt_column) if prompt_column else F.lit(""), F.lit("")).alias("_prompt"),
        F.coalesce(F.col(text_column), F.lit("")).alias("_text"),
    )
    id_field = StructField(id_column, texts.schema[id_column].dataType)
    key_type = to_arrow_type(id_field.dataType)
    schema = StructType([id_field, *(StructField(name, LongType()) for name in _COLUMNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, TaskContext.get().partitionId() << _TASK_SHIFT)
        waiting = _Pool(limits, vocabulary)
        for batch in batches:
            ids, prompts, texts = (batch.column(i) for i in range(3))
            for row in range(len(batch)):
                waiting.add(ids[row].as_py(), prompts[row].as_py(), texts[row].as_py())
                if len(waiting.pieces) >= pool:
                    yield waiting.flush(packer, key_type, id_column)
        if waiting.pieces:
            yield waiting.flush(packer, key_type, id_column)

    return texts.mapInArrow(run, schema)


class _Pool:
    """Examples whose pieces are not yet packed."""

    def __init__(self, limits: Limits, vocabulary: Vocabulary) -> None:
        self.limits, self.vocabulary = limits, vocabulary
        self.examples: list[tuple[object, np.ndarray]] = []
        self.pieces: list[tuple[int, int, int, int]] = []

    def add(self, key: object, prompt: str, text: str) -> None:
        ids = self.vocabulary.encode(text)
        quiet = 0
        if prompt:
            before = self.vocabulary.encode(prompt)[:-1]
            quiet, ids = len(before), np.concatenate([before, ids])
        example = len(self.examples)
        self.examples.append((key, ids))
        for start in range(0, len(ids), self.limits.tokens):
            length = min(self.limits.tokens, len(ids) - start)
            self.pieces.append((example, start, length, min(max(quiet - start, 0), length)))

    def flush(self, packer: Packer, key_type: pa.DataType, key_name: str) -> pa.RecordBatch:
        keys: list[object] = []
        rows: list[tuple[int, ...]] = []
        for example, start, length, quiet, sequence, segment, offset in packer.pack(self.pieces):
            key, ids = self.examples[example]
            crc = zlib.crc32(ids[start : start + length].tobytes())
            keys.append(key)
            rows.append((start, length, length - quiet, crc, len(ids), sequence, segment, offset))
        self.examples, self.pieces = [], []
        columns = np.array(rows, dtype=np.int64).T
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, type=key_type), *(pa.array(c) for c in columns)], names=[key_name, *_COLUMNS]
        )
