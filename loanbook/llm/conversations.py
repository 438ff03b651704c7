"""Repair of conversation structure by lightest derivations.

A sound conversation is empty, or an optional system turn and then pairs of user and
assistant turns.  A repair keeps, reroles and deletes turns and inserts empty ones.  Its
items are prefixes: ``(i, q)`` says that the first ``i`` turns are edited and leave the
grammar in state ``q``.  A deduction takes such a prefix and one edit (or, for parts of a
long conversation, one span of edits) to a further prefix, and the goal follows from the
prefixes of all turns that end in an accepting state.  Weights are (cost, audit), the audit
being the initials of the edits.  Appending edits never makes a weight smaller and keeps
the order of two weights of one item: of equal costs, neither audit begins the other, as
what it has more would be inserts, which cost.  So Knuth's agenda applies: an item popped
first has its final weight, and the goal's is the cheapest repair, ties by its audit.

No task holds a whole long conversation.  Rows become one byte each (initial and fault),
are put in order by ranges of (conversation, turn) and cut into blocks of at most
``BLOCK`` bytes.  The first block of a conversation is solved from the start, the others
from every state, and spans of neighbouring blocks are merged ``FAN`` at a time by the same
agenda until one is left.  Texts move once, to be written out under the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loanbook.llm.storage import stored

BLOCK = 256
FAN = 8
OUT_ROWS = 2048

WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3

START, SYSTEM, USER, ASSISTANT, GOAL = range(5)
NEXT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
"""The state after a turn whose role has initial s (0), u (1) or a (2)."""
FORWARD = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
"""The state after the turn that an insert or a new role makes."""
ROLES = {USER: "user", ASSISTANT: "assistant"}
ACCEPTING = (START, ASSISTANT)
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)

Item = tuple[int, int]
Weight = tuple[int, str]


def lightest(
    axiom: Item, deductions: Callable[[Item], Iterable[tuple[Item, int, str]]], goal: Item | None = None
) -> dict[Item, Weight]:
    """Final weights of the items that follow from ``axiom``, in the order they are popped.

    ``deductions`` gives for an item each head that it and one edit or span lead to, with
    the weight of that edit or span.  With a ``goal``, items that weigh more are left out.
    """
    agenda, final = [(0, "", axiom)], {}
    while agenda:
        cost, audit, item = heappop(agenda)
        if item in final:
            continue
        final[item] = cost, audit
        if item == goal:
            break
        for head, more, edits in deductions(item):
            if head not in final:
                heappush(agenda, (cost + more, audit + edits, head))
    return final


def _edits(codes: bytes, goal: Item | None) -> Callable[[Item], Iterator[tuple[Item, int, str]]]:
    def deductions(item: Item) -> Iterator[tuple[Item, int, str]]:
        i, q = item
        if i == len(codes) and goal and q in ACCEPTING:
            yield goal, 0, ""
        yield (i, FORWARD[q]), INSERT, "I"
        if i < len(codes):
            fault, initial = divmod(codes[i] - 65, 4)
            yield (i + 1, q), DELETE, "D"
            if fault in (NO_FAULT, TRUNCATED):
                more = CUT_OFF if fault == TRUNCATED else 0
                if (q, initial) in NEXT:
                    yield (i + 1, NEXT[q, initial]), KEEP + more, "K"
                yield (i + 1, FORWARD[q]), REROLE + more, "R"

    return deductions


@lru_cache(1 << 14)
def solve(codes: bytes, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """Spans (state before, state after, cost, audit) of a block; up to the goal if it is the last."""
    goal = (len(codes) + 1, GOAL) if last else None
    spans = []
    for start in (START,) if first else (START, SYSTEM, USER, ASSISTANT):
        final = lightest((0, start), _edits(codes, goal), goal)
        spans += [(start, q, *w) for (i, q), w in final.items() if i == len(codes) + last]
    return spans


def merge(parts: list[list[tuple[int, int, int, str]]], first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """Spans over neighbouring parts from the spans of each, as ``solve`` gives them."""
    goal = (len(parts) + 1, GOAL) if last else None
    starts = {}
    for i, spans in enumerate(parts):
        for before, after, cost, audit in spans:
            starts.setdefault((i, before), []).append(((i + 1, after), cost, audit))

    def deductions(item: Item) -> Iterator[tuple[Item, int, str]]:
        if item[0] == len(parts) and item[1] == GOAL or item == goal:
            return
        if item[0] == len(parts) and goal and item[1] in ACCEPTING:
            yield goal, 0, ""
        yield from starts.get(item, ())

    out = []
    for start in (START,) if first else (START, SYSTEM, USER, ASSISTANT):
        final = lightest((0, start), deductions, goal)
        out += [(start, q, *w) for (i, q), w in final.items() if i == len(parts) + last]
    return out


# Rows -------------------------------------------------------------------------------


def rows_of(
    df: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> DataFrame:
    """(conv_id, turn, role, text, copies) rows; a null role or text is one space."""
    return df.select(
        F.col(f"`{conv_column}`").alias("conv_id"),
        F.col(f"`{turn_column}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_column}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text_column}`"), F.lit(" ")).alias("text"),
        F.lit(1).alias("copies"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """Rows with seeded faults: of twenty draws by ``conv_id:turn`` (null: one space), five do damage.

    0 drops the row (``copies`` becomes 0), 1 empties its text, 2 takes its ``.!?`` away,
    3 repeats it, 4 makes its role user.
    """
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    draw = F.crc32(named.cast("binary")) % 20
    return rows.select(
        "conv_id",
        "turn",
        F.when(draw == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("copies") * F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1)).alias("copies"),
    )


def _initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _hashes() -> list[Column]:
    return [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2")]



def _in_order(*before: str) -> list[Column]:
    return [*(F.asc_nulls_first(c) for c in before), F.asc_nulls_first("turn"), "initial", "h1", "h2"]


def _coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, initial, h1, h2, copies, code, again): equal rows as one, with the byte of the first and of the rest."""
    seen = F.btrim("text", F.lit(WHITE))
    light = stored(
        rows.select(
            "conv_id", "turn", _initial().alias("initial"), (seen == "").alias("blank"),
            (~F.right(seen, F.lit(1)).isin(".", "!", "?")).alias("cut"), *_hashes(), F.col("copies").cast("long"),
        )
        .groupBy("conv_id", "turn", "initial", "blank", "cut", "h1", "h2")
        .agg(F.sum("copies").alias("copies")),
        "turns",
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    firsts = (
        light.where("copies > 0")
        .groupBy(F.col("conv_id").alias("c"), F.col("h1").alias("a"), F.col("h2").alias("b"))
        .agg(F.min(place).alias("place"), F.count("*").alias("places"))
        .where("places > 1")
    )
    same = light["conv_id"].eqNullSafe(firsts["c"]) & (light["h1"] == firsts["a"]) & (light["h2"] == firsts["b"])
    repeated = F.coalesce(place > F.col("place"), F.lit(False))
    fault = F.when(F.col("blank"), BLANK).when(repeated, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(NO_FAULT)
    rest = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)
    return light.join(firsts, same, "left").select(
        "conv_id", "turn", "initial", "h1", "h2", "copies",
        (65 + 4 * fault + F.col("initial")).alias("code"), (65 + 4 * rest + F.col("initial")).alias("again"),
    )


# Blocks and spans -------------------------------------------------------------------


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _cut(coded: DataFrame) -> DataFrame:
    """Blocks of each conversation's bytes, with the place of their first row."""
    schema = T.StructType(
        [
            T.StructField("conv_id", coded.schema["conv_id"].dataType),
            *(T.StructField(n, T.LongType()) for n in ("turn", "initial", "h1", "h2", "skipped")),
            T.StructField("codes", T.BinaryType()),
            *(T.StructField(n, T.LongType()) for n in ("low", "high", "turns")),
        ]
    )
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, codes, low, high, turns = [], None, bytearray(), None, None, 0

        def close() -> None:
            out.append((*head, bytes(codes), low, high, turns))

        for batch in batches:
            for conv, turn, initial, h1, h2, copies, code, again in zip(*(c.to_pylist() for c in batch.columns)):
                done = 0
                while True:
                    if head is None or head[0] != conv or len(codes) >= BLOCK:
                        if head is not None:
                            close()
                        head, codes, low, high, turns = (conv, turn, initial, h1, h2, done), bytearray(), None, None, 0
                    take = min(copies - done, BLOCK - len(codes))
                    if take > 0:
                        codes += bytes([code if done == 0 else again]) + bytes([again]) * (take - 1)
                        if turn is not None:
                            turns += turn != high
                            low, high = turn if low is None else low, turn
                    done += take
                    if done >= copies:
                        break
            if len(out) >= OUT_ROWS:
                yield _batch(out, arrow)
                out.clear()
        if head is not None:
            close()
        if out:
            yield _batch(out, arrow)

    ordered = coded.repartitionByRange(*_in_order("conv_id")).sortWithinPartitions(*_in_order("conv_id"))
    return ordered.mapInArrow(run, schema)


_SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType()),
            T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()),
        ]
    )
)
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _node_schema(conv: T.DataType) -> T.StructType:
    longs = ["no", "many", "low", "high", "turns", *_COUNTS, "head", "tail"]
    return T.StructType(
        [T.StructField("conv_id", conv), *(T.StructField(n, T.LongType()) for n in longs), T.StructField("spans", _SPANS)]
    )


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


@lru_cache(1 << 14)
def _counted(codes: bytes) -> tuple[int, int, int, int, int | None, int | None]:
    """Blank, duplicate and truncated rows, illegal neighbours, and the initials at both ends."""
    pairs = [divmod(c - 65, 4) for c in codes]
    faults, initials = [f for f, _ in pairs], [i for _, i in pairs]
    illegal = sum(not _legal(a, b) for a, b in zip(initials, initials[1:]))
    ends = (initials[0], initials[-1]) if initials else (None, None)
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, *ends


def _solve_blocks(blocks: DataFrame) -> DataFrame:
    schema = _node_schema(blocks.schema["conv_id"].dataType)
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            out = [
                (conv, no, many, low, high, turns, *_counted(codes), solve(codes, no == 0, many == 1))
                for conv, no, many, low, high, turns, codes in rows
            ]
            yield _batch(out, arrow)

    return blocks.select("conv_id", "no", "many", "low", "high", "turns", "codes").mapInArrow(run, schema)


def _merged(nodes: DataFrame) -> DataFrame:
    """Every ``FAN`` neighbouring nodes of a conversation as one."""
    arrow = _arrow(nodes.schema)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["no"])
        first, last = rows[0]["no"] == 0, rows[0]["many"] <= FAN
        spans = merge([[tuple(s.values()) for s in r["spans"]] for r in rows], first, last)
        total = dict(rows[0])
        for row in rows[1:]:
            for name in _COUNTS:
                total[name] += row[name]
            if row["head"] is not None:
                if total["tail"] is not None:
                    total["illegal"] += not _legal(total["tail"], row["head"])
                else:
                    total["head"] = row["head"]
                total["tail"] = row["tail"]
            if row["low"] is not None:
                total["turns"] += row["turns"] - (total["high"] == row["low"])
                total["low"] = row["low"] if total["low"] is None else total["low"]
                total["high"] = row["high"]
        total |= {"no": rows[0]["no"] // FAN, "many": -(-rows[0]["many"] // FAN), "spans": spans}
        return pa.Table.from_batches([_batch([tuple(total.values())], arrow)])

    return nodes.groupBy("conv_id", F.floor(F.col("no") / FAN)).applyInArrow(run, nodes.schema)


def judge(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``rows_of``.

    Rows stand in order of their turn, null turns first; rows of one turn by their role's
    initial (s, u, a, others) and then by a digest of role and text, equal ones side by
    side.  A conversation whose rows all have ``copies`` 0 has zeros and an empty audit.
    The null conversation is one like the others.
    """
    blocks = stored(_cut(stored(_coded(rows), "turn-codes")), "turn-blocks")
    # One row per block; only conversations of several blocks are numbered beyond 0.
    own = Window.partitionBy("conv_id")
    place = own.orderBy(F.asc_nulls_first("turn"), "initial", "h1", "h2", "skipped")
    numbered = blocks.withColumns(
        {"no": (F.row_number().over(place) - 1).cast("long"), "many": F.count("*").over(own)}
    )
    level = stored(_solve_blocks(numbered), "turn-spans")
    solved = [level.where("many = 1")]
    level = level.where("many > 1")
    while not level.isEmpty():
        level = stored(_merged(level), "turn-spans")
        solved.append(level.where("many = 1"))
        level = level.where("many > 1")
    nodes = solved[0]
    for more in solved[1:]:
        nodes = nodes.unionByName(more)
    best = F.element_at("spans", 1)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return nodes.select(
        "conv_id", gaps.alias("gaps"), *_COUNTS, best["cost"].alias("cost"), best["audit"].alias("audit")
    )


# Repaired conversations -------------------------------------------------------------


def repaired(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns of the repaired conversations.

    Each conversation's turns lie side by side and in order in one partition, read as a
    stream: one task writes out a conversation, but holds only a batch of it.
    """
    conv = rows.schema["conv_id"].dataType
    schema = T.StructType(
        [
            T.StructField("conv_id", conv), T.StructField("position", T.LongType()),
            *(T.StructField(n, T.StringType()) for n in ("edit", "role", "text")),
        ]
    )
    arrow = _arrow(schema)
    nothing = {"initial": "int", "turn": "long", "h1": "long", "h2": "long", "role": "string"}
    heads = verdicts.select(
        "conv_id", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(n) for n, t in nothing.items()),
        F.col("audit").alias("text"), F.lit(0).alias("copies"),
    )
    turns = rows.where("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), _initial().alias("initial"), "turn", *_hashes(), "role", "text",
        F.col("copies").cast("int").alias("copies"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own, audit, at, state, position, held = [], None, "", 0, START, 0, 0

        def add(edit: str, role: str, text: str) -> None:
            nonlocal position, held
            out.append((own, position, edit, role, text))
            position += 1
            held += len(text)

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                at, state = at + 1, FORWARD[state]
                add("I", ROLES[state], "")

        for batch in batches:
            for conv_id, kind, initial, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    inserts()
                    own, audit, at, state, position = conv_id, text, 0, START, 0
                for _ in range(copies):
                    inserts()
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        state = NEXT[state, initial]
                        add("K", role, text)
                    elif edit == "R":
                        state = FORWARD[state]
                        add("R", ROLES[state], text)
                if len(out) >= OUT_ROWS or held > 1 << 22:
                    yield _batch(out, arrow)
                    out.clear()
                    held = 0
        inserts()
        if out:
            yield _batch(out, arrow)

    both = heads.unionByName(turns)
    ordered = both.repartition("conv_id").sortWithinPartitions(*_in_order("conv_id", "kind"))
    return ordered.select("conv_id", "kind", "initial", "role", "text", "copies").mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the rows of ``repaired``, read in the order they come in."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, out = None, None, []
        for batch in batches:
            for conv, position, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if position == 0:
                    if digest is not None:
                        out.append((own, digest.hexdigest()))
                    own, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if len(out) >= OUT_ROWS:
                yield _batch(out, arrow)
                out.clear()
        if digest is not None:
            out.append((own, digest.hexdigest()))
        if out:
            yield _batch(out, arrow)

    return turns.select("conv_id", "position", "role", "text").mapInArrow(run, schema)


def repair_table(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cheapest repair and the digest of what that leaves.

    Defined cases: a null role or text is one space, so such a text is blank and such a
    role has no initial of use; null turns come first and count for no gap; an empty table
    gives an empty result; other columns are not read.
    """
    verdicts = stored(judge(rows), "turn-verdicts")
    found = digests(repaired(rows, verdicts)).withColumnRenamed("conv_id", "c")
    empty = hashlib.sha256().hexdigest()
    return verdicts.join(found, verdicts["conv_id"].eqNullSafe(found["c"]), "left").select(
        *verdicts.columns, F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )
