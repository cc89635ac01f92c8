"""Does a late delivery lower the review score? Descriptives, tests, effect sizes.

The tests need no row-level data beyond one aggregation: counts per group and
score, or count, mean and variance per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoralytics.functions.ranking import value_starts
from agoralytics.functions.scalars import cut, elapsed_days, percent
from agoralytics.functions.tails import (
    EXACT_GROUP,
    chi_square_upper_tail,
    rank_sum_upper_tail,
    student_two_sided,
)
from agoralytics.operators.common import DELIVERED, label_rows, with_status

# Group labels, score scale, delay bins (open below, closed above).
DELAYED = "Delayed"
PUNCTUAL = "On-Time / Early"
STATUSES = (PUNCTUAL, DELAYED)
SCORES = (1, 2, 3, 4, 5)
DELAY_EDGES = (0, 3, 7, 14, 30, 100)
DELAY_LABELS = ("1-3 Days", "4-7 Days", "8-14 Days", "15-30 Days", "30+ Days")
NO_DELAY_LABEL = "On-Time (0)"
REJECT = "REJECT H0"
KEEP = "FAIL TO REJECT H0"
ALPHA = 0.05


def review_delay_frame(
    orders: DataFrame, order_reviews: DataFrame, status: str = DELIVERED
) -> DataFrame:
    """Delivered orders × their reviews, rows without a date or score left out."""
    purchased = F.col("order_purchase_timestamp")
    arrived = F.col("order_delivered_customer_date")
    promised = F.col("order_estimated_delivery_date")
    score = F.col("review_score")
    late = arrived > promised
    return (
        with_status(orders, status)
        .filter(arrived.isNotNull() & promised.isNotNull())
        .join(order_reviews.select("order_id", score).filter(score.isNotNull()), "order_id")
        .select(
            "order_id",
            purchased,
            arrived,
            promised,
            score,
            late.alias("is_delayed"),
            F.when(late, DELAYED).otherwise(PUNCTUAL).alias("delivery_status"),
            elapsed_days(arrived, promised).alias("delay_days"),
            elapsed_days(arrived, purchased).alias("delivery_days"),
        )
    )


def score_counts(frame: DataFrame) -> DataFrame:
    """Reviews per delivery status and score."""
    return frame.groupBy("delivery_status", "review_score").agg(F.count(F.lit(1)).alias("n"))


def delay_split_counts(frame: DataFrame) -> DataFrame:
    late = F.count_if("is_delayed")
    return frame.agg(F.count(F.lit(1)).alias("total_orders"), late.alias("delayed_orders")).select(
        "total_orders",
        "delayed_orders",
        percent(F.col("delayed_orders"), F.col("total_orders"), rounding=F.bround).alias(
            "delayed_pct"
        ),
        (F.col("total_orders") - F.col("delayed_orders")).alias("ontime_orders"),
        percent(
            F.col("total_orders") - F.col("delayed_orders"),
            F.col("total_orders"),
            rounding=F.bround,
        ).alias("ontime_pct"),
    )


def _mean_score() -> Column:
    return F.try_divide(F.sum("review_score").cast("double"), F.count("review_score"))


def delay_severity(
    frame: DataFrame,
    bins: Sequence[int] = DELAY_EDGES,
    labels: Sequence[str] = DELAY_LABELS,
) -> DataFrame:
    """Mean score by length of delay, punctual rows first; empty bins stay with count 0.

    A delay under one day or beyond the last edge belongs to no bin.
    """
    bucket = F.when(F.col("is_delayed"), cut(F.col("delay_days"), bins, labels)).otherwise(
        NO_DELAY_LABEL
    )
    per_bucket = frame.groupBy(bucket.alias("delay_bucket")).agg(
        _mean_score().alias("mean"), F.count("review_score").alias("count")
    )
    return (
        label_rows(frame.sparkSession, "delay_bucket", (NO_DELAY_LABEL, *labels))
        .join(per_bucket, "delay_bucket", "left")
        .select("place", "delay_bucket", "mean", F.coalesce("count", F.lit(0)).alias("count"))
        .orderBy("place")
    )


def review_box_stats(frame: DataFrame) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges, extremes and mean by status."""
    counts = score_counts(frame)
    score = F.col("review_score")
    boxes = counts.groupBy("delivery_status").agg(
        F.percentile("review_score", [0.25, 0.5, 0.75], F.col("n")).alias("q"),
        F.min(score).cast("double").alias("min_score"),
        F.max(score).cast("double").alias("max_score"),
        (F.sum(score * F.col("n")).cast("double") / F.sum("n")).alias("mean_score"),
        F.collect_set(score.cast("double")).alias("scale"),  # the few scores of the rating scale
    )
    low, high = F.col("q")[0], F.col("q")[2]
    reach = (high - low) * 1.5
    inside = F.filter("scale", lambda v: (v >= low - reach) & (v <= high + reach))
    return boxes.select(
        "delivery_status",
        "min_score",
        F.least(low, F.array_min(inside)).alias("whisker_low"),
        low.alias("q1"),
        F.col("q")[1].alias("median"),
        high.alias("q3"),
        F.greatest(high, F.array_max(inside)).alias("whisker_high"),
        "max_score",
        "mean_score",
    )


def contingency_table(
    frame: DataFrame,
    rows: str = "delivery_status",
    cols: str = "review_score",
    row_order: Sequence[str] = STATUSES,
    col_values: Sequence[int] = SCORES,
) -> DataFrame:
    """Rows in the given order, one column per value and one for all other values.

    A missing value is not counted; a row without data is NULL throughout.
    """
    value = F.col(cols)
    counted = frame.groupBy(rows).agg(
        *(F.count_if(value == v).alias(f"score_{v}") for v in col_values),
        F.count_if(~value.isin(*col_values)).alias("score_other"),
    )
    listed = label_rows(frame.sparkSession, rows, row_order)
    return listed.join(counted, rows, "left").orderBy("place").drop("place")


def review_share_by_status(frame: DataFrame) -> DataFrame:
    """Row percentages of the contingency table, all values in the denominator."""
    table = contingency_table(frame)
    names = [f"score_{v}" for v in (*SCORES, "other")]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return table.select(
        "delivery_status",
        *(F.try_divide(F.col(n).cast("double"), total).alias(f"{n}_share") for n in names),
    ).select("delivery_status", *((F.col(f"{n}_share") * 100).alias(f"{n}_pct") for n in names))


def cohort_descriptives(frame: DataFrame) -> DataFrame:
    """Size, mean, median, standard deviation and extreme-score shares by status."""
    score, n = F.col("review_score"), F.col("n")
    size, first, second = F.sum(n), F.sum(score * n), F.sum(score * score * n)
    # whole-number sums, so the variance is exact before the division
    spread = (size * second - first * first).cast("double") / (size * (size - 1))

    def share(value: int) -> Column:
        hits = F.coalesce(F.sum(F.when(score == value, n)), F.lit(0))
        return F.bround(hits * 100 / size, 3)

    stats = (
        score_counts(frame)
        .select("delivery_status", score, n.cast("decimal(19,0)").alias("n"))
        .groupBy("delivery_status")
        .agg(
            size.cast("bigint").alias("sample_size"),
            F.bround(first.cast("double") / size, 3).alias("mean_score"),
            F.percentile("review_score", 0.5, F.col("n").cast("bigint")).alias("median_score"),
            F.when(size > 1, F.bround(F.sqrt(spread), 3)).alias("std_deviation"),
            share(1).cast("double").alias("one_star_pct"),
            share(5).cast("double").alias("five_star_pct"),
        )
    )
    cohort = F.when(F.col("delivery_status") == DELAYED, "Delayed Orders").otherwise(PUNCTUAL)
    return (
        stats.withColumn("cohort", cohort)
        .select(
            "cohort",
            "sample_size",
            "mean_score",
            "median_score",
            "std_deviation",
            "one_star_pct",
            "five_star_pct",
        )
        .orderBy(F.desc("cohort"))
    )


def one_star_risk_ratio(descriptives: DataFrame) -> DataFrame:
    """How many times likelier a one-star review is after a delay."""

    def of(cohort: str) -> Column:
        return F.max(F.when(F.col("cohort") == cohort, F.col("one_star_pct")))

    return descriptives.agg(
        of("Delayed Orders").alias("delayed_one_star_pct"),
        of(PUNCTUAL).alias("ontime_one_star_pct"),
    ).withColumn(
        "risk_ratio",
        F.round(F.try_divide(F.col("delayed_one_star_pct"), F.col("ontime_one_star_pct")), 2),
    )


def two_group_moments(
    frame: DataFrame,
    group: str = "delivery_status",
    value: str = "review_score",
    first: str = DELAYED,
    second: str = PUNCTUAL,
) -> DataFrame:
    """Size, mean and sample variance of both groups in one row."""

    def of(label: str, no: int) -> list[Column]:
        own = F.when(F.col(group) == label, F.col(value).cast("double"))
        return [
            F.count(own).alias(f"n{no}"),
            F.avg(own).alias(f"mean{no}"),
            F.var_samp(own).alias(f"var{no}"),
        ]

    return frame.agg(*of(first, 1), *of(second, 2))


def mean_difference(frame: DataFrame, **groups) -> DataFrame:
    return two_group_moments(frame, **groups).select(
        "n1", "mean1", "n2", "mean2", (F.col("mean1") - F.col("mean2")).alias("mean_difference")
    )


def _t_statistic() -> tuple[Column, Column]:
    """Statistic and degrees of freedom for unequal variances."""
    a, b = (F.try_divide(F.col(f"var{no}"), F.col(f"n{no}")) for no in (1, 2))
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(a + b))
    spread = F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n2") - 1)
    return t, F.try_divide((a + b) * (a + b), spread)


def _effect_size() -> Column:
    degrees = F.col("n1") + F.col("n2") - 2
    pooled = F.try_divide(
        (F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2"), degrees
    )
    return F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(pooled))


def welch_t_test(frame: DataFrame, **groups) -> DataFrame:
    """Two-sided test of equal means, delayed minus punctual."""
    t, degrees = _t_statistic()
    return (
        two_group_moments(frame, **groups)
        .select(
            "n1",
            "n2",
            "mean1",
            "mean2",
            t.alias("t_statistic"),
            degrees.alias("degrees_of_freedom"),
            _effect_size().alias("cohens_d"),
        )
        .withColumn("p_value", student_two_sided("t_statistic", "degrees_of_freedom"))
    )


def cohens_d(frame: DataFrame, **groups) -> DataFrame:
    """Mean difference in pooled standard deviations."""
    return two_group_moments(frame, **groups).select(
        "n1", "n2", "var1", "var2", _effect_size().alias("cohens_d")
    )


def mann_whitney_u(
    frame: DataFrame,
    group: str = "delivery_status",
    value: str = "review_score",
    alternative: str = "less",
    first: str = DELAYED,
    second: str = PUNCTUAL,
    method: str = "auto",
) -> DataFrame:
    """U of the first group; p from the exact null distribution or by the normal limit.

    Without ties, and with at most 8 values in the smaller group, p counts all arrangements of
    the ranks; else it is the normal limit with tie and continuity corrections. ``method``
    ``asymptotic`` takes the limit always; ``z`` is that of the limit in either case.

    ``value`` is any number, of any count of distinct values: they are counted, the counts summed by
    magnitude, and only the values of one magnitude are put in order together. NULL and NaN do
    not count. A group without values leaves p NULL.
    """
    if method not in ("auto", "asymptotic"):
        raise ValueError(f"unknown method: {method}")
    mine, theirs = (F.count_if(F.col(group) == label) for label in (first, second))
    number = F.col(value)
    per_value = (
        frame.filter(number.isNotNull() & ~F.isnan(number.cast("double")) & F.col(group).isin(first, second))
        .groupBy(number.alias("value"))
        .agg(mine.cast("double").alias("mine"), theirs.cast("double").alias("theirs"))
    )
    ties = F.col("mine") + F.col("theirs")
    summed = (
        value_starts(per_value, [], "value", True, ["theirs"])
        .select(
            "mine",
            "theirs",
            # a pair counts when mine is above theirs, half when equal
            (F.col("mine") * (F.col("beforetheirs") + F.col("theirs") / 2)).alias("wins"),
            (ties * ties * ties - ties).alias("tied"),
        )
        .agg(
            F.sum("mine").alias("n1"),
            F.sum("theirs").alias("n2"),
            F.sum("wins").alias("u_statistic"),
            F.sum("tied").alias("tied"),
        )
    )
    n1, n2, u = F.col("n1"), F.col("n2"), F.col("u_statistic")
    n = n1 + n2
    deviation = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("tied"), n * (n - 1))))
    other = n1 * n2 - u
    larger = {"less": other, "greater": u, "two-sided": F.greatest(u, other)}[alternative]
    sides = 2.0 if alternative == "two-sided" else 1.0
    exact = (F.col("tied") == 0) & (F.least(n1, n2) <= EXACT_GROUP) & F.lit(method == "auto")
    return (
        summed.withColumn("z", F.try_divide(larger - n1 * n2 / 2 - 0.5, deviation))
        .withColumn("tail", rank_sum_upper_tail("z", larger, n1, n2, exact))
        .withColumn("p_value", F.when(F.col("tail").isNotNull(), F.least(F.col("tail") * sides, F.lit(1.0))))
        .select(n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"), u, "z", "p_value")
    )


def chi_square_test(
    frame: DataFrame, rows: str = "delivery_status", cols: str = "review_score"
) -> DataFrame:
    """Independence of two categories; Yates' correction for a 2 × 2 table only.

    Expected counts come from the table's margins, joined to its cells, so either side may have
    any number of categories. Rows in which one is NULL do not count.
    """
    cells = (
        frame.filter(F.col(rows).isNotNull() & F.col(cols).isNotNull())
        .groupBy(F.col(rows).alias("_row"), F.col(cols).alias("_col"))
        .agg(F.count(F.lit(1)).cast("double").alias("seen"))
    )
    across = cells.groupBy("_row").agg(F.sum("seen").alias("r"))
    down = cells.groupBy("_col").agg(F.sum("seen").alias("c"))

    def margin(sums: DataFrame, name: str) -> Column:
        parts = (f(name).alias(part) for part, f in (("kinds", F.count), ("total", F.sum), ("lo", F.min), ("hi", F.max)))
        return sums.agg(F.struct(*parts)).scalar()

    expected = F.col("r") * F.col("c") / F.col("sides.r.total")
    gap = F.col("seen") - F.col("expected")
    sides = F.struct(margin(across, "r").alias("r"), margin(down, "c").alias("c"))
    summed = (
        cells.join(across, "_row")
        .join(down, "_col")
        .withColumn("sides", sides)
        .withColumn("expected", expected)
        .agg(
            F.max("sides").alias("sides"),
            F.sum(gap * gap / F.col("expected")).alias("seen_part"),
            F.sum("expected").alias("seen_expected"),
            F.max(F.abs(gap)).alias("gap"),
        )
    )
    total = F.col("sides.r.total")
    degrees = (F.col("sides.r.kinds") - 1) * (F.col("sides.c.kinds") - 1)
    # cells never seen contribute their expected count
    plain = F.col("seen_part") + (total - F.col("seen_expected"))
    # in a 2 × 2 table all four gaps are equal
    shrunk = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    inverse = (
        total
        * (1 / F.col("sides.r.lo") + 1 / F.col("sides.r.hi"))
        * (1 / F.col("sides.c.lo") + 1 / F.col("sides.c.hi"))
    )
    return (
        summed.select(
            total.cast("bigint").alias("n"),
            degrees.alias("degrees_of_freedom"),
            F.when(degrees == 1, shrunk * shrunk * inverse).otherwise(plain).alias("chi_square"),
        )
        .withColumn(
            "p_value",
            F.when(F.col("degrees_of_freedom") > 0, chi_square_upper_tail("chi_square", "degrees_of_freedom"))
            .otherwise(1.0),
        )
    )


def significance_decision(result: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Verdict on a test row that carries ``p_value`` and ``cohens_d``."""
    return result.select(
        "p_value",
        F.lit(float(alpha)).alias("alpha"),
        F.when(F.col("p_value") < alpha, REJECT).otherwise(KEEP).alias("decision"),
        F.abs("cohens_d").alias("effect_size"),
    )


def delay_score_correlation(frame: DataFrame) -> DataFrame:
    """Correlation and slope of the score on the days of delay, delayed rows."""
    late = frame.filter("is_delayed")
    score, days = F.col("review_score").cast("double"), F.col("delay_days").cast("double")
    return late.agg(
        F.count(F.lit(1)).alias("delayed_reviews"),
        F.corr(score, days).alias("correlation"),
        F.regr_slope(score, days).alias("slope"),
    )
