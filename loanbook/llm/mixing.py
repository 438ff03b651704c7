"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Every source wants a share of the mix in proportion to its weight but gives at most
``max_epochs`` times its words.  Clamping the sources above that and sharing their excess
out by weight, until none is above, ends at one common level: a source gets the smaller
of its cap and weight times level.

Within a source every document is taken the whole number of times that the target
allows.  What is left is filled in an order shuffled by a seeded hash: the documents
before the cut are taken once more, and then the one document beyond it whose size comes
nearest to the gap.  All documents are taken whole.  Documents that agree in id, source and
size are counted and then numbered, so that each has a hash and a decision of its own.

Only totals per source, and per block of some thousand hash-neighbours, are ever
gathered; single rows are ordered in one block per source, the one that holds the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanbook.llm.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
_KEY_BITS = 52
_BLOCK_ROWS = 8192


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _key(id_column: Column, number: Column, seed: str) -> Column:
    """A seeded hash of an id, and of the number of a repeated one, below 2**52, so that it is exact as a double."""
    again = F.when(number > 0, F.concat(F.lit(":"), number.cast("string"))).otherwise("")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")), again)
    digest = F.md5(name.cast("binary"))
    return F.conv(F.substring(digest, 1, _KEY_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """Add ``target`` to (source, weight, source_size, ...); one row per source.

    Sorted by how soon each source meets its cap, the level that would hold if all
    sources before were clamped rises up to the first that isn't and falls from there:
    the common level is the largest.
    """
    by_cap = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    capped = sources.withColumn("_cap", F.col("source_size") * max_epochs).withColumn(
        "_total", F.sum("source_size").over(everything) * share
    )
    clamped = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    return (
        capped.withColumn("_level", (F.col("_total") - clamped) / weights)
        .withColumn("_level", F.max("_level").over(everything))
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.col("weight") * F.col("_level")))
        .drop("_cap", "_total", "_level")
    )


def alternating_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Give the sources, in code point order with null last, the weights in turn."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1)))


def _same_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the source, null being a source as well."""
    right = right.withColumnRenamed("source", "_other")
    return left.join(right, left["source"].eqNullSafe(right["_other"]), how).drop("_other")


def _position(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{name}") for name in ("key", "id", "size", "number")))


def _blocks(many: Column, block: str) -> Column:
    """One row per block of at most ``_BLOCK_ROWS`` of ``many`` equal things; none of none."""
    last = F.floor((many - 1) / _BLOCK_ROWS)
    return F.explode(F.when(many > 0, F.sequence(F.lit(0).cast("long"), last))).alias(block)


def _in_block(many: Column, block: Column) -> Column:
    first = block * _BLOCK_ROWS
    return F.sequence(first, F.least(first + _BLOCK_ROWS, many) - 1)


def _numbered(documents: DataFrame, seed: str) -> DataFrame:
    """(id, source, size, number, key): documents that agree in the first three are numbered from 0.

    They are counted before they move and laid out again in blocks.
    """
    same = ["id", "source", "size"]
    counted = documents.select("id", "source", word_count(F.col("text")).alias("size")).groupBy(*same).agg(
        F.count("*").alias("rows")
    )
    laid = counted.select(*same, "rows", _blocks(F.col("rows"), "block")).repartition(*same, "block")
    rows = laid.select(*same, F.explode(_in_block(F.col("rows"), F.col("block"))).alias("number"))
    return rows.withColumn("key", _key(F.col("id"), F.col("number"), seed))


def plan_mix(
    documents: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int, seed: str
) -> tuple[DataFrame, DataFrame]:
    """Stored (id, source, size, number, key) rows, and one row per source that says what to take."""
    sized = stored(_numbered(documents, seed), "mixing")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = water_fill(alternating_weights(totals, weights), share, max_epochs)
    targets = targets.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ).withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = targets.withColumn("blocks", F.ceil(F.col("rows") / _BLOCK_ROWS)).drop("rows")
    targets = stored(targets, "mixing-targets")

    place = _same_source(sized, targets.select("source", "blocks", "want"))
    place = place.withColumn("block", F.floor(F.col("key") / float(1 << _KEY_BITS) * F.col("blocks")))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cut_block = (
        place.groupBy("source", "block", "want")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .where((F.col("before") <= F.col("want")) & (F.col("want") < F.col("before") + F.col("words")))
        .select(F.col("source").alias("_s"), F.col("block").alias("_b"), "before")
    )
    so_far = Window.partitionBy("source").orderBy("key", "id", "size", "number").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        place.join(cut_block, place["source"].eqNullSafe(F.col("_s")) & (place["block"] == F.col("_b")))
        .withColumn("reach", F.col("before") + F.sum("size").over(so_far))
        .groupBy("source")
        .agg(
            F.min(F.when(F.col("reach") > F.col("want"), _position())).alias("cut"),
            F.max(F.when(F.col("reach") <= F.col("want"), F.col("reach"))).alias("reach"),
            F.first("before").alias("before"),
            F.first("want").alias("want"),
        )
        .select("source", "cut", (F.col("want") - F.coalesce("reach", "before")).alias("gap"))
    )
    cut = stored(cut, "mixing-cuts")
    miss = F.abs(F.col("size") - F.col("gap"))
    extra = (
        _same_source(sized, cut)
        .where((_position() >= F.col("cut")) & (miss < F.col("gap")))
        .groupBy("source")
        .agg(F.min(F.struct(miss.alias("miss"), _position().alias("position"))).alias("nearest"))
        .select("source", F.col("nearest.position").alias("extra"))
    )
    plan = _same_source(_same_source(targets, cut.drop("gap"), "left"), extra, "left")
    return sized, stored(plan.select("source", "source_size", "target", "whole", "want", "cut", "extra"), "mixing-plan")


def repetitions() -> Column:
    """How often the row is taken, given its own columns and its source's plan."""
    position = _position()
    once_more = (
        F.when(F.col("cut").isNull(), F.col("want") > 0)  # the whole rest is wanted, or nothing
        .otherwise((position < F.col("cut")) | F.coalesce(position == F.col("extra"), F.lit(False)))
        .cast("long")
    )
    return F.col("whole") + once_more


def _named(df: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    return df.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(source_column).alias("source")
    )


def mix_table(
    df: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """Per document: its words, its source's words and target, and the words the mix takes.

    A null text has no words; a null source is a source of its own, the last; a null id
    counts as an empty one in the shuffle.  Rows that agree in id, source and size are
    decided one by one.  A source without words has target 0.  An empty table gives no
    rows.  Other columns are ignored.  Reruns agree.
    """
    sized, plan = plan_mix(_named(df, id_column, text_column, source_column), weights, share, max_epochs, seed)
    return _same_source(sized, plan).select(
        F.col("id").alias(id_column),
        F.col("source").alias(source_column),
        "size",
        "source_size",
        "target",
        (F.col("size") * repetitions()).alias("taken"),
    )


def mix_documents(
    df: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """The rows of the mix with all their columns, each as often as it is taken.

    Of rows that agree in id, source and size, as many are taken once more as the plan
    says, in the order of a hash of the whole row.
    """
    sized, plan = plan_mix(_named(df, id_column, text_column, source_column), weights, share, max_epochs, seed)
    rows = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
        F.col(id_column).alias("id"),
        F.col(source_column).alias("source"),
        word_count(F.col(text_column)).alias("size"),
    )
    same = ["id", "source", "size"]
    several = stored(
        _same_source(sized, plan).groupBy(*same, "whole").agg(
            F.count("*").alias("rows"), (F.sum(repetitions()) - F.first("whole") * F.count("*")).alias("more")
        ).where("rows > 1"),
        "mixing-repeated",
    )
    if several.isEmpty():
        return _repeated(_single(rows, plan, seed))
    other = several.toDF(*(f"_{c}" for c in several.columns))
    match = rows["id"].eqNullSafe(other["_id"]) & rows["source"].eqNullSafe(other["_source"]) & (rows["size"] == other["_size"])
    taken = _single(rows.join(other, match, "left_anti"), plan, seed)
    # Equal rows are one before they move; the others of a group are put in order without their texts.
    classes = stored(
        rows.join(other, match)
        .groupBy(*same, F.xxhash64("row").alias("hash"), F.col("_whole").alias("whole"), F.col("_more").alias("more"))
        .agg(F.count("*").alias("rows"), F.first("row").alias("row")),
        "mixing-classes",
    )
    before = Window.partitionBy(*same).orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = classes.select(*same, "hash", "rows", "whole", "more").withColumn(
        "start", F.coalesce(F.sum("rows").over(before), F.lit(0))
    )
    extra = F.greatest(F.lit(0), F.least(F.col("rows"), F.col("more") - F.col("start")))
    times = placed.select(*(F.col(c).alias(f"_{c}") for c in (*same, "hash")), (F.col("whole") * F.col("rows") + extra).alias("times"))
    own = (
        classes["id"].eqNullSafe(times["_id"]) & classes["source"].eqNullSafe(times["_source"])
        & (classes["size"] == times["_size"]) & (classes["hash"] == times["_hash"])
    )
    return _repeated(taken.unionByName(classes.join(times, own).select("row", "times")))


def _single(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """(row, times) of rows that no other agrees with."""
    alone = rows.withColumn("number", F.lit(0).cast("long"))
    alone = alone.withColumn("key", _key(F.col("id"), F.col("number"), seed))
    return _same_source(alone, plan).select("row", repetitions().cast("long").alias("times"))


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows of (row, times), each as often as it says, laid out in blocks."""
    blocks = rows.select("row", "times", _blocks(F.col("times"), "block"))
    return blocks.select("row", F.explode(_in_block(F.col("times"), F.col("block")))).select("row.*")


ORACLE = rf"""
WITH counted AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS number FROM counted),
sized AS (
  SELECT *, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')
                 || CASE WHEN number > 0 THEN ':' || CAST(number AS VARCHAR) ELSE '' END), 1, 13) AS BIGINT) AS key
  FROM numbered),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5e0
             - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM totals),
targets AS (
  SELECT source, source_size, least(2e0 * source_size, weight * max(level) OVER ()) AS target FROM levels),
wanted AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
laid AS (
  SELECT s.*, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS want,
         sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size, number ROWS UNBOUNDED PRECEDING) AS reach
  FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source),
gaps AS (
  SELECT *, want - max(CASE WHEN reach <= want THEN reach ELSE 0 END) OVER (PARTITION BY source) AS gap FROM laid),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source
                ORDER BY CASE WHEN reach > want AND abs(size - gap) < gap THEN abs(size - gap) END NULLS LAST,
                         key, doc_id, size, number) AS nearest
  FROM gaps)
SELECT doc_id, source, size, source_size, target,
       CAST(size * (whole + CASE WHEN reach <= want AND want > 0
                              OR nearest = 1 AND reach > want AND abs(size - gap) < gap THEN 1 ELSE 0 END) AS BIGINT)
         AS taken
FROM ranked
"""
