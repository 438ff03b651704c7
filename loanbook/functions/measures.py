"""Exact ratios, conditional aggregates and report spines.

Every rate in the reports is a ratio of two exact sums rounded half away from
zero to two places.  Decimal division in Spark truncates its scale, so the
ratios are formed on whole units (counts, cents) with integer division instead;
nothing is lost before the single rounding step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Result types.  Totals are wide enough for a book of 10^12 contracts.
MONEY = "decimal(15,2)"
MONEY_TOTAL = "decimal(25,2)"
RATE = "decimal(18,2)"

_WHOLE = "decimal(38,0)"


def whole_units(value: Column, scale: int = 0) -> Column:
    """``value`` with ``scale`` decimal places as a whole number of its last place."""
    # The literal carries scale 0, so the product keeps every digit of ``value``.
    return (value * F.lit(10**scale)).cast("decimal(30,0)") if scale else value.cast("decimal(30,0)")


def divide_half_up(numerator: Column, denominator: Column) -> Column:
    """Whole-number quotient of two whole numbers, rounded half away from zero."""
    n = F.abs(numerator).cast(_WHOLE)
    d = F.abs(denominator).cast(_WHOLE)
    quotient = F.call_function("div", 2 * n + d, 2 * d)
    return F.when((numerator < 0) != (denominator < 0), -quotient).otherwise(quotient)


def hundredths(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` rounded to two places."""
    return (divide_half_up(numerator * 100, denominator).cast("decimal(20,0)") / 100).cast(RATE)


def pct(part: Column, total: Column, scale: int = 0, zero_is_null: bool = True) -> Column:
    """``part`` as a percentage of ``total``.

    A zero total gives NULL, or a division error when ``zero_is_null`` is off.
    """
    whole = whole_units(total, scale)
    if zero_is_null:
        whole = F.nullif(whole, F.lit(0).cast(_WHOLE))
    return hundredths(whole_units(part, scale) * 100, whole)


def mean(total: Column, count: Column, scale: int = 0) -> Column:
    """``total / count`` to two places; NULL when nothing was counted."""
    rows = F.nullif(whole_units(count), F.lit(0).cast(_WHOLE))
    return hundredths(whole_units(total, scale), rows * F.lit(10**scale))


def round_to_cents(units: Column, units_per_cent: Column | int) -> Column:
    """Money from a whole number of fine units, rounded half away from zero."""
    divisor = F.lit(units_per_cent).cast(_WHOLE) if isinstance(units_per_cent, int) else units_per_cent
    return (divide_half_up(units, divisor).cast("decimal(20,0)") / 100).cast(MONEY)


def cents_to_money(cents: Column) -> Column:
    """Money from whole cents."""
    # 15 digits times 2 digits stays within 18, where decimals are plain longs.
    return (cents.cast("decimal(15,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY)


def scale_half_up(value: Column, factor: Column | int, divisor: Column | int) -> Column:
    """``value * factor / divisor`` on longs, rounded half away from zero; only ``value`` may be negative.

    Whole multiples of the divisor are split off first, so that the product never
    needs more than a long as long as the result and ``2 * divisor * factor`` fit one.
    """
    size = F.abs(value)
    divisor = F.lit(divisor) if isinstance(divisor, int) else divisor
    whole = F.call_function("div", size, divisor) * factor
    rest = F.call_function("div", 2 * (size % divisor) * factor + divisor, 2 * divisor)
    return (whole + rest) * F.when(value < 0, -1).otherwise(1)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def sum_where(value: Column, condition: Column) -> Column:
    return F.sum(F.when(condition, value))


def money_sum(value: Column, condition: Column | None = None) -> Column:
    """Sum of money, zero rather than NULL when there is nothing to add."""
    total = F.sum(value) if condition is None else sum_where(value, condition)
    return F.coalesce(total, F.lit(0)).cast(MONEY_TOTAL)


def bucket(value: Column, edges: list[tuple[int, str]], above: str | None) -> Column:
    """Label of the first edge that ``value`` does not exceed, else ``above``."""
    column = None
    for upper, label in edges:
        test = value <= F.lit(upper)
        column = F.when(test, label) if column is None else column.when(test, label)
    return column.otherwise(F.lit(above)) if above is not None else column


def spine(spark: SparkSession, key: str, labels: list[str]) -> DataFrame:
    """Fixed report rows ``(key, sort_order)`` in the order given."""
    rows = ", ".join(f"('{label}', {i})" for i, label in enumerate(labels, 1))
    # A handful of rows in one partition: totals over them and their final sort need no shuffle.
    return spark.sql(f"SELECT * FROM VALUES {rows} AS spine({key}, sort_order)").coalesce(1)


def on_spine(summary: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """Lay an already aggregated ``summary`` over the fixed report rows.

    The summary holds at most one row per label, so it is the side to broadcast:
    its size is bounded by the label list whatever the data.  Joining before the
    aggregation would instead move every fact row onto a handful of keys.
    """
    rows = spine(summary.sparkSession, key, labels)
    return rows.join(F.broadcast(summary), key, "left")
