"""Column expressions shared by the operators.

All date helpers work on zone-less timestamps without a detour through the
session time zone, so results do not depend on daylight-saving rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Operand types for exact ratios: the division keeps ten or more decimals.
COUNT = "decimal(20,0)"
MONEY = "decimal(24,2)"
SCORE = "decimal(24,4)"

# Weekday names, Monday first.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def flag(condition: Column) -> Column:
    """Condition as 1/0, NULL when unknown, so that sums skip unknown rows."""
    return condition.cast("int")


def require_money(df: DataFrame, *columns: str) -> None:
    """Amounts must be decimals of at most two places, as the table schemas declare."""
    for name in columns:
        kind = df.schema[name].dataType
        if not (isinstance(kind, T.DecimalType) and kind.scale <= 2):
            raise TypeError(f"{name} is {kind.simpleString()}, expected decimal(_,2)")


def cents(column: str) -> Column:
    """An amount in whole cents.

    Sums of bigint cents are exact, run in generated code and shuffle a third of
    the bytes of wide decimal sums; an overflow is an error, never a wrong total.
    """
    return (F.col(column) * 100).cast("bigint")


def money(total: Column) -> Column:
    """Cents as an amount with two decimals."""
    return (total.cast(COUNT) / 100).cast("decimal(22,2)")


def ratio(
    part: Column,
    whole: Column,
    kinds: tuple[str, str] = (COUNT, COUNT),
    *,
    digits: int = 2,
    times: int = 1,
    rounding=F.round,
) -> Column:
    """``part * times / whole`` in decimal arithmetic; NULL when ``whole`` is zero."""
    numerator = part.cast(kinds[0])
    if times != 1:
        numerator = numerator * F.lit(times).cast("decimal(3,0)")
    return rounding(F.try_divide(numerator, whole.cast(kinds[1])), digits)


def percent(part: Column, whole: Column, kind: str = COUNT, **options) -> Column:
    return ratio(part, whole, (kind, kind), times=100, **options)


def mean(total: Column, n: Column, kind: str = COUNT, **options) -> Column:
    return ratio(total, n, (kind, COUNT), **options)


def month_key(ts: Column) -> Column:
    """Calendar month as 'YYYY-MM'."""
    return ts.cast("date").cast("string").substr(1, 7)


def month_number(ts: Column) -> Column:
    """Months counted from year zero; consecutive months differ by one."""
    return F.year(ts) * 12 + F.month(ts) - 1


def month_key_of(number: Column) -> Column:
    """Inverse of ``month_number``."""
    year = F.floor(number / 12).cast("int")
    return F.concat(
        F.lpad(year.cast("string"), 4, "0"),
        F.lit("-"),
        F.lpad((number % 12 + 1).cast("string"), 2, "0"),
    )


def parse_month(text: str) -> int:
    """``month_number`` of a literal 'YYYY-MM'."""
    year, month = text.split("-")
    return int(year) * 12 + int(month) - 1


def _time_of_day(ts: Column) -> Column:
    return ts - ts.cast("date").cast("timestamp_ntz")


def calendar_days(later: Column, earlier: Column) -> Column:
    """Difference of the two calendar dates."""
    return F.datediff(later, earlier)


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour periods elapsed, rounded down (also below zero)."""
    borrow = flag(_time_of_day(later) < _time_of_day(earlier))
    return F.datediff(later, earlier) - borrow


def complete_months(earlier: Column, later: Column) -> Column:
    """Complete months from ``earlier`` to ``later``, counted towards zero."""
    span = month_number(later) - month_number(earlier)
    mark_from = F.struct(F.dayofmonth(earlier), _time_of_day(earlier))
    mark_to = F.struct(F.dayofmonth(later), _time_of_day(later))
    return (
        F.when((span > 0) & (mark_to < mark_from), span - 1)
        .when((span < 0) & (mark_to > mark_from), span + 1)
        .otherwise(span)
    )


def monday_first(ts: Column) -> Column:
    """Day of the week, 1 for Monday to 7 for Sunday."""
    return F.weekday(ts) + 1


def weekday_name(ts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), monday_first(ts))


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Label of the first rule that holds."""
    (condition, label), *rest = rules
    chain = F.when(condition, label)
    for condition, label in rest:
        chain = chain.when(condition, label)
    return chain.otherwise(default)


def cut(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin ``(edges[i], edges[i+1]]`` holding ``value``, NULL outside."""
    chain = F.when(value <= edges[0], None)
    for edge, label in zip(edges[1:], labels, strict=True):
        chain = chain.when(value <= edge, label)
    return chain


def tile_number(position: Column, total: Column, tiles: int) -> Column:
    """NTILE from a row's 1-based position: the first ``total % tiles`` tiles get one row more."""
    small = F.floor(total / tiles)
    longer = total % tiles
    in_longer = longer * (small + 1)
    return (
        F.when(position <= in_longer, F.ceil(position / (small + 1)))
        .otherwise(longer + F.ceil((position - in_longer) / F.greatest(small, F.lit(1))))
        .cast("int")
    )


def quantile_bin(position: Column, total: Column, bins: int) -> Column:
    """Bin 1..``bins`` of a rank cut at evenly spaced linear quantiles of 1..total."""
    scaled = (position - 1) * bins
    width = F.greatest(total - 1, F.lit(1))
    # ceil(scaled / width) in whole numbers
    ceiling = (scaled - scaled % width) / width + flag(scaled % width > 0)
    return F.when(total <= 1, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.least(F.lit(bins), ceiling.cast("int")))
    )
