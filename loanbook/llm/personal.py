"""Personal data by weak supervision: e-mail and network addresses, card and phone numbers.

Base spans follow fixed patterns and always count.  Further candidates are what these
patterns just miss: failed matches, spellings that hide a sign, other number forms.  Five
labelers vote on every candidate, base spans included, or abstain: two by pattern (shape
and validity), a gazetteer of endings, prefixes and ranges, the words before it, and its
borders.  Expectation-maximisation over the counts of all vote patterns of the whole
corpus estimates, per kind, how each labeler votes on true and on false candidates.  The
posteriors train a logistic classifier on features of the span itself and what surrounds
it, and candidates that it accepts are added to the base spans.

Patterns are searched from rare signs, so that a long text costs time in its length only.
"""

from __future__ import annotations

import ipaddress
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loanbook.llm.storage import stored

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
SAMPLE_ROWS = 20_000
"""The classifier is fitted to at most this many candidates, those of the smallest hashes."""
BUCKETS = 1 << 11
LABELERS = 5

# --- Fixed values: words, endings and prefixes that the labelers know ---------------
ENDINGS = set("com org net edu gov io co info biz de fr es it uk eu us ca au ch at nl be pl ru br in jp cn mx".split())
CALLING_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 971 972".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "35", "36", "38", "60", "62", "64", "65", "2")
CUES = {
    EMAIL: set("email e-mail mail mailto contact write kontakt correo courriel reach".split()),
    IP: set("ip address host server addr adresse from login client ipv4 ipv6".split()),
    CARD: set("card visa mastercard amex credit payment karte carte tarjeta debit".split()),
    PHONE: set("phone tel call fax mobile telephone telefon cell whatsapp telefono".split()),
}
OTHER_CUES = set("version order invoice isbn id serial token article commit hash section chapter build revision doi".split())
# -------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

# Spellings beyond the base: each starts at a sign that is rare in prose.
_AT = re.compile(r" ?[\[({] ?(?:at|@) ?[\])}] ?| @ | at (?=[A-Za-z0-9-]{1,63} dot )", re.I)
_DOT = r"(?:\.| ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot )"
_AT_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", re.I)
_TAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_HIDDEN_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]| dot )[0-9]{1,3}){3}(?![0-9])", re.I)
_COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_WIDE_CARD = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ .\-_/ ]{0,2}[0-9]){12,18}(?![0-9A-Za-z])")
_PLAIN_PHONE = re.compile(
    r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+.])00[1-9][0-9]?(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9A-Za-z])"
)

Span = tuple[int, int]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = int(c) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


# Base spans: (accepted, failed) of each kind, leftmost and without overlap --------------


def _emails(text: str) -> tuple[list[Span], list[Span]]:
    found, failed, end, at = [], [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            if domain := _DOMAIN.match(text, at + 1):
                end = domain.end()
                found.append((start, end))
            elif at + 1 < len(text) and text[at + 1].isalnum():
                stop = at + 1
                while stop < len(text) and stop < at + 64 and (text[stop].isalnum() or text[stop] == "-"):
                    stop += 1
                failed.append((start, stop))
        at = text.find("@", max(at + 1, end))
    return found, failed


def _addresses(text: str) -> tuple[list[Span], list[Span]]:
    found, failed = [], []
    for chain in _CHAIN.finditer(text):
        whole = chain.group()
        if whole.count(".") < 3:
            continue
        runs, at = whole.split("."), chain.start()
        for first in range(0, len(runs) // 4 * 4, 4):
            four = runs[first : first + 4]
            size = sum(map(len, four)) + 3
            small = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)
            (found if small else failed).append((at, at + size))
            at += size + 1
    return found, failed


def _cards(text: str) -> tuple[list[Span], list[Span]]:
    found, failed = [], []
    for match in _CARD.finditer(text):
        if match.end() - match.start() < 13:
            continue
        digits = _digits(match.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(match.span())
        elif 13 <= len(digits) <= 19:
            failed.append(match.span())
    return found, failed


def _phones(text: str) -> tuple[list[Span], list[Span]]:
    found, failed = [], []
    if "+" in text:
        for match in _PHONE.finditer(text):
            many = len(_digits(match.group()))
            if 8 <= many <= 15:
                found.append(match.span())
            elif 6 <= many <= 17:
                failed.append(match.span())
    return found, failed


def base_spans(text: str) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and failed matches of each kind."""
    parts = [_emails(text), _addresses(text), _cards(text), _phones(text)]
    return [p[0] for p in parts], [p[1] for p in parts]


def _near_misses(text: str) -> Iterator[tuple[int, int, int]]:
    for at in _AT.finditer(text):
        local = _TAIL.search(text[max(0, at.start() - 64) : at.start()])
        domain = _AT_DOMAIN.match(text, at.end())
        if local and domain:
            yield EMAIL, at.start() - len(local.group()), domain.end()
    for match in _HIDDEN_IP.finditer(text):
        yield IP, *match.span()
    if "::" in text or text.count(":") > 6:
        for match in _COLONS.finditer(text):
            if "::" in match.group() or match.group().count(":") == 7:
                yield IP, *match.span()
    for kind, pattern in ((CARD, _WIDE_CARD), (PHONE, _PLAIN_PHONE)):
        for match in pattern.finditer(text):
            yield kind, *match.span()


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, is base) by kind and start; others overlap neither a base span nor each other."""
    found, failed = base_spans(text)
    base = [(k, s, e, True) for k in range(4) for s, e in found[k]]
    taken = sorted((s, e) for _, s, e, _ in base)
    more = sorted({(k, *span) for k in range(4) for span in failed[k]} | set(_near_misses(text)), key=lambda c: (c[1], -c[2], c[0]))
    starts, reach = [s for s, _ in taken], -1
    for i, (_, e) in enumerate(taken):
        reach = max(reach, e)
        taken[i] = (starts[i], reach)
    out, end = [], 0
    for kind, start, stop in more:
        before = bisect_right(starts, stop - 1) - 1
        if start >= end and (before < 0 or taken[before][1] <= start):
            out.append((kind, start, stop, False))
            end = stop
    return sorted(base + out)


# Labelers -----------------------------------------------------------------------------


def _words_before(text: str, start: int) -> list[str]:
    return [w.lower() for w in _WORD.findall(text[max(0, start - 60) : start])][-4:]


def _open(text: str, start: int, end: int) -> bool:
    """Whether the span is part of a longer token."""
    return (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())


def _shape(kind: int, span: str) -> int:
    digits = len(_digits(span))
    if kind == EMAIL:
        return 1 if re.fullmatch(r"[\w.%+-]{1,64}@[\w-]+(\.[\w-]+)+", span) else 0
    if kind == IP:
        return 1 if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", span) or span.count(":") == 7 else -1
    if kind == CARD:
        return 1 if digits in (15, 16) and re.fullmatch(r"[0-9]+|([0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", span) else -1
    return 1 if 10 <= digits <= 13 else -1


def _valid(kind: int, span: str) -> int:
    if kind == EMAIL:
        return 1 if re.search(r"[A-Za-z]{2,}\Z", span) else -1
    if kind == IP:
        try:
            ipaddress.ip_address(re.sub(r" dot |[\[({](?:dot|\.)[\])}]", ".", span, flags=re.I))
            return 1
        except ValueError:
            return -1
    digits = _digits(span)
    if kind == CARD:
        return 1 if luhn(digits) else -1
    return 0 if span.count("(") == span.count(")") else -1


def _listed(kind: int, span: str) -> int:
    digits = _digits(span)
    if kind == EMAIL:
        return 1 if re.split(r"[^A-Za-z0-9]+", span.lower())[-1] in ENDINGS else -1
    if kind == IP:
        return -1 if span.startswith(("0.", "255.")) or span.count(":") and len(span) < 6 else 0
    if kind == CARD:
        return 1 if digits.startswith(CARD_PREFIXES) else -1
    if span.startswith("+"):
        return 1 if any(digits[:n] in CALLING_CODES for n in (1, 2, 3)) else -1
    return 0


def votes(text: str, kind: int, start: int, end: int) -> list[int]:
    """What each labeler says: 1 true, -1 false, 0 nothing."""
    span, words = text[start:end], _words_before(text, start)
    cue = 1 if CUES[kind].intersection(words) else -1 if OTHER_CUES.intersection(words) else 0
    return [_shape(kind, span), _valid(kind, span), _listed(kind, span), cue, -1 if _open(text, start, end) else 1]


def features(text: str, kind: int, start: int, end: int) -> list[int]:
    """Buckets of what is seen in and around a span."""
    span = text[start:end]
    digits = len(_digits(span))
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    seen = [
        "", f"length {min(len(span) // 4, 12)}", f"digits {min(digits, 20)}", f"signs {''.join(sorted(set(re.findall(r'[^0-9A-Za-z]', span))))[:8]}",
        f"before {'w' if before.isalnum() else before}", f"after {'w' if after.isalnum() else after}",
        f"first {span[:1] if not span[:1].isalnum() else 'd' if span[:1].isdigit() else 'a'}",
        f"last {re.split('[^A-Za-z0-9]+', span.lower())[-1][:6] if kind == EMAIL else ''}",
        f"check {luhn(_digits(span)) if kind == CARD else max(map(len, re.findall('[0-9]+', span)), default=0) if kind == IP else ''}",
        *(f"word {w}" for w in _words_before(text, start)),
    ]
    return [zlib.crc32(f"{kind} {s}".encode()) % BUCKETS for s in seen]


def vote_code(given: list[int]) -> int:
    code = 0
    for v in given:
        code = code * 3 + v + 1
    return code


# Model --------------------------------------------------------------------------------


@dataclass
class Reliability:
    """Of one kind: the share of true candidates, and how often each labeler says -1, 0 or 1 of false and true ones."""

    share: float
    says: np.ndarray  # [labeler][false, true][vote + 1]

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        given = codes[:, None] // 3 ** np.arange(self.says.shape[0] - 1, -1, -1) % 3
        odds = np.log([1 - self.share, self.share])[None, :] + sum(
            np.log(self.says[n][:, given[:, n]]).T for n in range(self.says.shape[0])
        )
        return 1 / (1 + np.exp(np.clip(odds[:, 0] - odds[:, 1], -500, 500)))


def estimate(codes: np.ndarray, counts: np.ndarray, labelers: int = LABELERS, rounds: int = 100) -> Reliability:
    """Expectation-maximisation over counts of vote patterns, started from labelers that are right more often than not."""
    given = codes[:, None] // 3 ** np.arange(labelers - 1, -1, -1) % 3
    # As many made-up votes as four candidates keep the classes from changing places.
    prior = np.array([[2.4, 0.8, 0.8], [0.8, 0.8, 2.4]])
    found = Reliability(0.5, np.stack([prior / prior.sum(axis=1, keepdims=True)] * labelers))
    for _ in range(rounds):
        true = found.posterior(codes) * counts
        false = counts - true
        says = np.stack(
            [
                prior + np.stack([np.bincount(given[:, n], weights=w, minlength=3) for w in (false, true)])
                for n in range(labelers)
            ]
        )
        found = Reliability((true.sum() + 1) / (counts.sum() + 2), says / says.sum(axis=2, keepdims=True))
    return found


def train(rows: list[list[int]], labels: np.ndarray, rounds: int = 300, rate: float = 0.5, keep: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model of the buckets, fitted to probabilities by gradient steps of adapted size."""
    weights, seen = np.zeros(BUCKETS), np.zeros(BUCKETS)
    sizes = np.array([len(r) for r in rows])
    owner, flat = np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.asarray(r) for r in rows])
    for _ in range(rounds):
        sums = np.bincount(owner, weights=weights[flat], minlength=len(rows))
        error = 1 / (1 + np.exp(-sums)) - labels
        step = np.bincount(flat, weights=error[owner], minlength=BUCKETS) / len(rows) + keep * weights
        seen += step * step
        weights -= rate * step / (np.sqrt(seen) + 1e-8)
    return weights


def accepted(weights: np.ndarray, rows: list[list[int]], threshold: float) -> list[bool]:
    return [1 / (1 + np.exp(-weights[r].sum())) >= threshold for r in rows]


# Tables -------------------------------------------------------------------------------

_SPAN = "kind int, start int, stop int"
_CANDIDATES = f"array<struct<{_SPAN}, base boolean, votes int, features array<int>>>"


def _with_candidates(rows: DataFrame) -> DataFrame:
    """(row, candidates) of (row, text)."""
    at = rows.columns.index("text")
    schema = rows.drop("text").withColumn("candidates", F.lit(None).cast(_CANDIDATES)).schema
    inner = pa.list_(
        pa.struct(
            [
                *(pa.field(n, pa.int32()) for n in ("kind", "start", "stop")),
                pa.field("base", pa.bool_()), pa.field("votes", pa.int32()), pa.field("features", pa.list_(pa.int32())),
            ]
        )
    )

    def judged(text: str) -> list[dict]:
        return [
            {
                "kind": kind, "start": start, "stop": end, "base": base,
                "votes": vote_code(votes(text, kind, start, end)), "features": features(text, kind, start, end),
            }
            for kind, start, end, base in candidates(text)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array((judged(t.as_py() or "") for t in batch.column(at)), inner)
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, found], names=schema.names)

    return rows.mapInArrow(run, schema)


def fit(found: DataFrame) -> tuple[dict[int, Reliability], np.ndarray | None]:
    """Reliabilities of the labelers from the counts of all vote patterns, and the classifier's weights."""
    each = found.select(F.explode("candidates").alias("c")).select("c.*")
    # At most 4 kinds x 3 ** LABELERS patterns.
    counted = each.groupBy("kind", "votes").count().toPandas()
    if counted.empty:
        return {}, None
    known = {
        int(kind): estimate(part["votes"].to_numpy(), part["count"].to_numpy(dtype=np.float64))
        for kind, part in counted.sort_values(["kind", "votes"]).groupby("kind")
    }
    # Candidates that look alike weigh as often as they occur; the sample is fixed by their hashes.
    sample = (
        each.withColumn("at", F.xxhash64("kind", "start", "stop", "votes", "features"))
        .orderBy("at", "kind", "votes", "features").limit(SAMPLE_ROWS).select("kind", "votes", "features").toPandas()
    )
    labels = np.zeros(len(sample))
    for kind, reliability in known.items():
        own = (sample["kind"] == kind).to_numpy()
        labels[own] = reliability.posterior(sample.loc[own, "votes"].to_numpy())
    return known, train(list(sample["features"]), labels)


def personal_spans(
    df: DataFrame, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, base, spans) of every row: arrays of (kind, start, stop) by kind and start, in code points, ends exclusive.

    Base spans are among the spans.  Defined cases: a null text is empty and has no spans; a
    null or repeated id stays as it is; an empty table gives an empty result; a table
    without candidates is not fitted; other columns are not read.
    """
    found = stored(
        _with_candidates(df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))),
        "personal",
    )
    _, weights = fit(found)
    spans = f"array<struct<{_SPAN}>>"
    schema = found.select("id").withColumns({n: F.lit(None).cast(spans) for n in ("base", "spans")}).schema
    inner = pa.list_(pa.struct([pa.field(n, pa.int32()) for n in ("kind", "start", "stop")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [c or [] for c in batch.column(1).to_pylist()]
            flat = [c for some in lists for c in some]
            good = iter(accepted(weights, [c["features"] for c in flat], threshold) if flat else [])
            kept = [[(c["base"], next(good), c) for c in some] for some in lists]
            base = [[c for is_base, _, c in some if is_base] for some in kept]
            every = [[c for is_base, likely, c in some if is_base or likely] for some in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([[{n: c[n] for n in ("kind", "start", "stop")} for c in some] for some in lists_], inner) for lists_ in (base, every))],
                names=["id", "base", "spans"],
            )

    return found.mapInArrow(run, schema)


def _listing(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one: Callable[[Column], Column] = lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")
    )
    return F.array_join(F.transform(spans, one), ",")


def span_table(df: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): base counts and digest, and all spans as text."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)]
    return personal_spans(df).select(
        F.col("id").alias("doc_id"), *counts, F.sha2(_listing("base"), 256).alias("base_sha256"),
        _listing("spans").alias("spans"),
    )
