"""Repair: against all edit sequences, and conversations cut into many blocks."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loanbook.llm import conversations as C
from loanbook.llm.queries import op13_repair

SCHEMA = "conv_id long, turn long, role string, text string"
SOUND = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw, copies = zlib.crc32(name.encode()) % 20, 1
        if draw == 0:
            copies = 0
        elif draw == 1:
            text = ""
        elif draw == 2:
            text = re.sub("[.!?]", "", text)
        elif draw == 3:
            copies = 2
        elif draw == 4:
            role = "user"
        out.setdefault(conv, []).extend([(turn, role, text)] * copies)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, "sua".find(r[1][:1]) % 4)) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip("\t\n\x0b\x0c\r ")
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Relaxation over (rows read, initials so far as a state), with whole sequences as values."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    made = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    level = {"": (0, "", ())}

    def with_inserts(level):
        for _ in range(3):
            for q, (cost, audit, turns) in list(level.items()):
                new = (cost + 3, audit + "I", (*turns, f"{names[made[q]]}:"))
                level[made[q]] = min(level.get(made[q], new), new, key=lambda w: w[:2])
        return level

    level = with_inserts(level)
    for (_, role, text), fault in zip(rows, found):
        following = {}
        for q, (cost, audit, turns) in level.items():
            options = [(q, 4, "D", ())]
            if fault not in ("b", "d"):
                more = 3 if fault == "t" else 0
                if (q, role[:1]) in step:
                    options.append((step[q, role[:1]], more, "K", (f"{role}:{text}",)))
                options.append((made[q], 3 + more, "R", (f"{names[made[q]]}:{text}",)))
            for to, price, edit, turn in options:
                new = (cost + price, audit + edit, turns + turn)
                following[to] = min(following.get(to, new), new, key=lambda w: w[:2])
        level = with_inserts(following)
    return min((level[q] for q in ("", "a") if q in level), key=lambda w: w[:2])


def verdict(rows):
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    found = faults(rows)
    cost, audit, left = cheapest(rows, found)
    digest = hashlib.sha256("\n".join(left).encode()).hexdigest()
    return gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit, digest


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_relaxation_is_cheapest():
    """The plain version above against every edit sequence of short conversations."""
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for n in range(3):
        for roles in itertools.product("suao", repeat=n):
            for found in itertools.product(("", "b", "t"), repeat=n):
                rows = [(i, names[r], f"{i}") for i, r in enumerate(roles)]
                best = None
                for edits in itertools.product(*[("D",) if f == "b" else "DKUA" for f in found]):
                    for extra in itertools.product(("", "u", "a", "ua", "au"), repeat=n + 1):
                        made = extra[0]
                        audit, cost = "I" * len(extra[0]), 3 * sum(map(len, extra))
                        for r, f, e, x in zip(roles, found, edits, extra[1:]):
                            made += {"D": "", "K": r, "U": "u", "A": "a"}[e] + x
                            audit += ("R" if e in "UA" else e) + "I" * len(x)
                            cost += {"D": 4, "K": 0, "U": 3, "A": 3}[e] + (3 if f == "t" and e != "D" else 0)
                        if SOUND.fullmatch(made) and (best is None or (cost, audit) < best):
                            best = cost, audit
                assert cheapest(rows, found)[:2] == best


def test_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select(*SCHEMA.split(" ")[::2]).collect()]
    found = op13_repair(spark, small)
    assert found.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    ]
    assert got(found) == {c: verdict(r) for c, r in damaged(rows).items()}


@pytest.mark.parametrize("block", [1, 3, 256])
def test_odd_and_long_conversations(spark, monkeypatch, block):
    draw = random.Random(3)
    texts = ["Yes.", "no", "Ok!", "  ", "", None, "x" * 3000 + "?", "ja.\n", "é?"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in draw.sample(range(40), draw.randrange(12)):
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", "tool", None, ""]), draw.choice(texts)))
    rows += [(70, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(900)]
    rows += [(71, None, "user", "Same."), (72, None, None, None)]
    # Two rows a turn, which come in the order of their roles' initials as long as these differ.
    both = [t for t in range(0, 40, 2) if zlib.crc32(f"73:{t}".encode()) % 20 != 4]
    rows += [(73, t, role, f"turn {t}.") for t in both for role in ("assistant", "user")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"code": F.lit(1), "copies": F.lit("x"), "no": F.lit(2)})
    monkeypatch.setattr(C, "BLOCK", block)
    want = {c: verdict(r) for c, r in damaged(rows).items()}
    assert got(C.repair_table(C.damage(C.rows_of(frame)))) == want


def test_hot_repeated_row(spark):
    rows = [(1, 5, "user", "Again?")] * 3000 + [(1, 6, "assistant", "Once.")]
    found = got(C.repair_table(C.rows_of(spark.createDataFrame(rows, SCHEMA))))
    assert found[1][:7] == (0, 0, 2999, 0, 2999, 4 * 2999, "K" + "D" * 2999 + "K")


def test_empty(spark):
    assert C.repair_table(C.damage(C.rows_of(spark.createDataFrame([], SCHEMA)))).collect() == []
