"""Global order, running totals, order statistics and quantiles without a one-task window.

Values are counted, the counts are summed by magnitude (a table of bounded length, whatever the
number of rows), and only the values of one magnitude are put in order together. Rows of one
value are told apart by id: ids are dealt to ranges between the smallest and the largest, and
only one range's ids are put in order together. These are plain joins and aggregates, so the
results are ordinary lazy frames; nothing is run or written when they are built.

``with_position`` orders whole rows by any columns instead: it sorts by range and stages them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agoralytics.plans.staging import staged

_ROW_BITS = 33  # layout of monotonically_increasing_id: partition, then row
_SLOT = "_slot"
_PART = "_part"


def _in_order(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    ordered = df.orderBy(*order).withColumn(_SLOT, F.monotonically_increasing_id())
    return staged(ordered, label).withColumn(_PART, F.shiftright(_SLOT, _ROW_BITS))


def _place() -> Column:
    return F.col(_SLOT).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1


def with_position(
    df: DataFrame,
    order: Sequence[Column],
    *,
    position: str = "position",
    total: str = "total_rows",
    label: str = "ordered",
) -> DataFrame:
    """Add each row's 1-based position in ``order`` and the number of rows."""
    ordered = _in_order(df, order, label)
    sizes = ordered.groupBy(_PART).agg(F.count(F.lit(1)).alias("_rows"))
    everything = Window.orderBy(_PART).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the sort: bounded by the shuffle width
    starts = sizes.select(
        _PART,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_rows").over(everything).alias(total),
    )
    return (
        ordered.join(F.broadcast(starts), _PART)
        .withColumn(position, F.col("_start") + _place())
        .drop(_PART, _SLOT, "_start")
    )


ID_RANGES = 1 << 16  # parts in which the ids of one value are put in order
_CODE_BYTES, _CODES = 7, 6  # of an id's characters: pieces that fit a bigint, and how many are looked at


def magnitude(value: Column) -> Column:
    """A bigint that never falls when the number rises, with some 256 steps for each doubling; null is null."""
    x = value.cast("double")
    size = F.floor((F.log2(F.abs(x)) + 1100) * 256)
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("bigint")


def _id_codes(df: DataFrame, tie: str) -> list[Column]:
    """Numbers that order ids: one for a whole number, else one for each few bytes of the text."""
    if isinstance(df.schema[tie].dataType, T.IntegralType):
        return [F.col(tie).cast("bigint")]
    letters = F.hex(F.encode(F.col(tie).cast("string"), "utf-8"))
    width = 2 * _CODE_BYTES
    return [
        F.conv(F.rpad(F.substring(letters, width * k + 1, width), width, "0"), 16, 10).cast("bigint")
        for k in range(_CODES)
    ]


def _code_bounds(codes: Sequence[Column]) -> list[Column]:
    return [f(c).alias(f"_{name}{k}") for k, c in enumerate(codes) for name, f in (("low", F.min), ("high", F.max))]


def _id_range(codes: Sequence[Column], tie: str, bounded: DataFrame) -> Column:
    """The range of a row's id between the smallest and the largest of all; below all for null.

    ``bounded`` has ``_code_bounds`` of parts of the rows. Text that all ids begin with is
    skipped: the first few bytes in which any two differ count.
    """
    over_all = bounded.agg(*(F.min(f"_low{k}").alias(f"low{k}") for k in range(len(codes))), *(F.max(f"_high{k}").alias(f"high{k}") for k in range(len(codes))))
    wide = over_all.select(
        F.array(*(F.struct(F.col(f"low{k}").alias("low"), F.col(f"high{k}").alias("high")) for k in range(len(codes))))
    ).scalar()

    def place(code: Column, low: Column, high: Column) -> Column:
        # bigint differences may overflow, doubles do not and keep the order
        share = (code.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double") + 1)
        return F.floor(share * ID_RANGES).cast("bigint")

    chain = None
    for k, code in enumerate(codes):
        differs = wide[k]["low"] < wide[k]["high"]
        here = place(code, wide[k]["low"], wide[k]["high"])
        chain = F.when(differs, here) if chain is None else chain.when(differs, here)
    return F.coalesce(F.when(F.col(tie).isNull(), F.lit(-1)).otherwise(chain.otherwise(0)), F.lit(0)).cast("bigint")


def value_starts(counted: DataFrame, keys: Sequence[str], value: str, ascending: bool, sums: Sequence[str]) -> DataFrame:
    """``counted`` (one row per ``keys`` and value) with the sums of ``sums`` before each value and over all.

    Sums go by magnitude first; the running sum over magnitudes sees a table of bounded length.
    """
    parted = counted.withColumn(_PART, magnitude(F.col(value)) if ascending else -magnitude(F.col(value)))
    per_part = parted.groupBy(*keys, _PART).agg(*(F.sum(c).alias(f"_in_{c}") for c in sums))
    in_turn = Window.partitionBy(*keys).orderBy(_PART)
    earlier = in_turn.rowsBetween(Window.unboundedPreceding, -1)
    everything = in_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = per_part.select(
        *keys,
        _PART,
        *(F.sum(f"_in_{c}").over(earlier).alias(f"_start_{c}") for c in sums),
        *(F.sum(f"_in_{c}").over(everything).alias(f"all{c}") for c in sums),
    )
    order = F.asc(value) if ascending else F.desc(value)
    within = Window.partitionBy(*keys, _PART).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def before(c: str) -> Column:
        zero = F.lit(0).cast(counted.schema[c].dataType)
        return (F.coalesce(f"_start_{c}", zero) + F.coalesce(F.sum(c).over(within), zero)).alias(f"before{c}")

    placed = parted.join(starts, [*keys, _PART])
    return placed.select(*counted.columns, *(before(c) for c in sums), *(f"all{c}" for c in sums))


def order_statistics(
    rows: DataFrame, positions: Callable[[Column], Sequence[Column]], tie: str | None = None, series: str = "series", value: str = "value"
) -> DataFrame:
    """The rows at some 1-based positions of each series: ``series, pick, value``, the ``tie`` column and, without
    one, the series' number of rows as ``total``.

    ``positions`` gives the positions from a series' number of rows; those outside it give no
    row. Rows go by ascending ``value`` (a number, not NULL), then by ``tie``, NULL first. Only rows
    whose value is picked are told apart by ``tie``, and only in one range of ids each.
    """
    codes = [] if tie is None else _id_codes(rows, tie)
    counted = rows.groupBy(series, value).agg(F.count(F.lit(1)).alias("_n"), *_code_bounds(codes))
    placed = value_starts(counted.select(series, value, "_n"), [series], value, True, ["_n"])
    picks = placed.select("*", F.posexplode(F.array(*positions(F.col("all_n")))).alias("pick", "_at"))
    inside = (F.col("_at") > F.col("before_n")) & (F.col("_at") <= F.col("before_n") + F.col("_n"))
    if tie is None:
        return picks.where(inside).select(series, "pick", value, F.col("all_n").alias("total"))
    picked = picks.where(inside).select(series, "pick", value, (F.col("_at") - F.col("before_n")).alias("_nth"))
    ranged = rows.withColumn("_id_part", _id_range(codes, tie, counted))
    tied = ranged.join(picked, [series, value])
    per_range = tied.groupBy(series, "pick", value, "_nth", "_id_part").agg(F.count(F.lit(1)).alias("_n"))
    in_turn = Window.partitionBy(series, "pick").orderBy("_id_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        per_range.withColumn("_before", F.coalesce(F.sum("_n").over(in_turn), F.lit(0)))
        .where((F.col("_nth") > F.col("_before")) & (F.col("_nth") <= F.col("_before") + F.col("_n")))
        .select(series, "pick", value, "_id_part", (F.col("_nth") - F.col("_before")).alias("_nth"))
    )
    order = Window.partitionBy(series, "pick", "_id_part").orderBy(tie)
    ordered = ranged.join(ranges, [series, value, "_id_part"]).withColumn("_row", F.row_number().over(order))
    return ordered.where(F.col("_row") == F.col("_nth")).select(series, "pick", value, tie)


def ntile_ends(total: Column, tiles: int) -> list[Column]:
    """Last positions of all NTILE tiles but the last."""
    small, longer = F.floor(total / tiles), total % tiles
    return [small * k + F.least(F.lit(k), longer) for k in range(1, tiles)]


def quantile_ends(total: Column, bins: int) -> list[Column]:
    """Last positions of all bins but the last of a rank cut at evenly spaced linear quantiles of 1..total."""
    return [F.floor((total - 1) * k / bins) + 1 for k in range(1, bins)]


def with_tiles(
    df: DataFrame, tie: str, orders: Mapping[str, Column], tiles: int, ends: Callable[[Column, int], Sequence[Column]]
) -> DataFrame:
    """Add a column of tile numbers from 1 for each of ``orders``: a name, and numbers that are never NULL.

    Rows go by ascending number, then by ``tie``, which is unique. The last rows of the tiles
    are found for all orders at once; a row's tile follows from comparing it with them.
    """
    # The numbers become columns first: comparisons below would repeat what they are made of.
    numbered = df.withColumns({f"_number{k}": v for k, v in enumerate(orders.values())})
    pairs = (F.struct(F.lit(k).alias("series"), F.col(f"_number{k}").alias("value")) for k in range(len(orders)))
    rows = numbered.select(tie, F.explode(F.array(*pairs)).alias("_s")).select(tie, "_s.series", "_s.value")
    last = order_statistics(rows, lambda total: ends(total, tiles), tie)
    # at most one row per order and tile, laid side by side
    count = len(orders) * (tiles - 1)
    side_by_side = Window.orderBy(_PART)
    one = F.struct("series", "value", tie)
    listed = last.withColumn(_PART, F.col("series") * tiles + F.col("pick")).select(
        F.row_number().over(side_by_side).alias("_row"),
        F.array(*(F.lead(one, k).over(side_by_side) for k in range(count))).alias("_ends"),
    )
    found = listed.where(F.col("_row") == 1).select("_ends").scalar()

    def tile(k: int) -> Column:
        number = F.col(f"_number{k}")

        def reached(j: int) -> Column:
            end = F.col("_ends")[j]
            same = F.col(tie).isNull() | (F.col(tie) <= end[tie])
            own = (end["series"] == k) & ((number < end["value"]) | ((number == end["value"]) & same))
            return F.when(own, 1).otherwise(0)

        return F.lit(tiles) - sum((reached(j) for j in range(1, count)), reached(0))

    tiled = numbered.withColumn("_ends", found)
    return tiled.select(*df.columns, *(tile(k).alias(name) for k, name in enumerate(orders)))


def with_running_total(
    df: DataFrame,
    by: str,
    tie: str,
    amount: str,
    *,
    position: str = "position",
    total: str = "total_rows",
    running: str = "running_total",
    grand: str = "grand_total",
) -> DataFrame:
    """Descending position and running sum in which rows of equal ``by`` share the total.

    ``by`` must not be NULL. Rows of one value are put in order by range of ids.
    """
    codes = _id_codes(df, tie)
    counted = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_sum"), *_code_bounds(codes))
    values = value_starts(counted.select(by, "_n", "_sum"), [], by, False, ["_n", "_sum"])
    ranged = df.withColumn("_id_part", _id_range(codes, tie, counted))
    per_range = ranged.groupBy(by, "_id_part").agg(F.count(F.lit(1)).alias("_rows"))
    in_turn = Window.partitionBy(by).orderBy("_id_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select(by, "_id_part", F.coalesce(F.sum("_rows").over(in_turn), F.lit(0)).alias("_earlier"))
    known = starts.join(values, by)
    within = F.row_number().over(Window.partitionBy(by, "_id_part").orderBy(tie))
    return ranged.join(known, [by, "_id_part"]).select(
        *df.columns,
        (F.col("before_n") + F.col("_earlier") + within).alias(position),
        F.col("all_n").alias(total),
        (F.col("before_sum") + F.col("_sum")).alias(running),
        F.col("all_sum").alias(grand),
    )


def series_quantiles(rows: DataFrame, points: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles of each series of ``rows(series, value)``: ``series``, ``q0..`` per point.

    Used for values with unbounded distinct values, where the built-in exact percentile would
    hold all of them in a single buffer. NULL does not count.
    """

    def spots(total: Column) -> list[Column]:
        return [(total - 1) * F.lit(float(p)) for p in points]

    def positions(total: Column) -> list[Column]:
        return [f(s) + 1 for s in spots(total) for f in (F.floor, F.ceil)]

    picked = order_statistics(rows.where(F.col("value").isNotNull()), positions)
    values = [F.max(F.when(F.col("pick") == k, F.col("value").cast("double"))).alias(f"_v{k}") for k in range(2 * len(points))]
    found = picked.groupBy("series").agg(F.max("total").alias("total"), *values)
    return found.select(
        "series",
        *(
            (F.col(f"_v{2 * k}") + (F.col(f"_v{2 * k + 1}") - F.col(f"_v{2 * k}")) * (s - F.floor(s))).alias(f"q{k}")
            for k, s in enumerate(spots(F.col("total")))
        ),
    )


def exact_quantiles(df: DataFrame, column: str, points: Sequence[float]) -> DataFrame:
    """Quantiles of one column as one row ``q0..``, all NULL where there is no value."""
    found = series_quantiles(df.select(F.lit(0).alias("series"), F.col(column).alias("value")), points)
    return found.agg(*(F.max(f"q{k}").alias(f"q{k}") for k in range(len(points))))
