"""Delivery times, delays and their distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoralytics.functions.scalars import (
    MONEY,
    SCORE,
    WEEKDAYS,
    calendar_days,
    elapsed_days,
    flag,
    mean,
    monday_first,
    money,
    month_key,
    month_key_of,
    month_number,
    percent,
)
from agoralytics.operators.common import DELIVERED, items_per_order, label_rows, with_status

_MOMENTS = (
    "order_purchase_timestamp",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)
HISTOGRAM_BINS = 40
CURVE_POINTS = 200


def _moments() -> tuple[Column, Column, Column]:
    purchased, arrived, promised = map(F.col, _MOMENTS)
    return purchased, arrived, promised


def delivery_by_state(
    orders: DataFrame, customers: DataFrame, status: str = DELIVERED
) -> DataFrame:
    """Mean delivery and promised days and the delay rate by customer state."""
    purchased, arrived, promised = _moments()
    arrivals = (
        with_status(orders, status)
        .filter(arrived.isNotNull())
        .join(customers.select("customer_id", "customer_state"), "customer_id")
    )
    taken, planned = calendar_days(arrived, purchased), calendar_days(promised, purchased)
    return (
        arrivals.groupBy("customer_state")
        .agg(
            F.count("order_id").alias("delivered_orders"),
            mean(F.sum(taken), F.count(taken), digits=1).alias("avg_delivery_days"),
            mean(F.sum(planned), F.count(planned), digits=1).alias("avg_estimated_days"),
            F.sum(flag(arrived > promised)).alias("delayed_orders"),
        )
        .withColumn("delay_rate_pct", percent(F.col("delayed_orders"), F.col("delivered_orders")))
        .orderBy(F.desc("delay_rate_pct"), "customer_state")
    )


def delay_review_impact(
    orders: DataFrame, order_reviews: DataFrame, status: str = DELIVERED
) -> DataFrame:
    """Review scores of delayed against punctual deliveries; every review counts once."""
    _, arrived, promised = _moments()
    score = F.col("review_score")
    per_order = order_reviews.groupBy("order_id").agg(
        F.count("review_id").alias("reviews"),
        F.sum(score).alias("total"),
        F.count(score).alias("scored"),
        F.sum(flag(score == 1)).alias("ones"),
        F.sum(flag(score == 5)).alias("fives"),
    )
    label = F.when(arrived > promised, "Delayed Delivery").otherwise("On-Time / Early Delivery")
    return (
        with_status(orders, status)
        .filter(arrived.isNotNull())
        .select("order_id", label.alias("delivery_performance"))
        .join(per_order, "order_id")
        .groupBy("delivery_performance")
        .agg(
            F.sum("reviews").alias("total_reviews"),
            mean(F.sum("total"), F.sum("scored")).alias("avg_review_score"),
            percent(F.sum("ones"), F.sum("reviews")).alias("pct_1_star"),
            percent(F.sum("fives"), F.sum("reviews")).alias("pct_5_star"),
        )
    )


def delivered_enriched(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    """Delivered orders with elapsed days, a late mark (unknown counts as punctual) and the month."""
    purchased, arrived, promised = _moments()
    return with_status(orders, status).withColumns(
        {
            "delivery_days": elapsed_days(arrived, purchased),
            "is_delayed": F.coalesce(arrived > promised, F.lit(False)),
            "order_month": month_key(purchased),
        }
    )


def delivery_headline(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    days = F.col("delivery_days")
    totals = delivered_enriched(orders, status).agg(
        F.count(F.lit(1)).alias("delivered_orders"),
        F.count_if("is_delayed").alias("late"),
        F.sum(days).alias("days"),
        F.count(days).alias("timed"),
    )
    return totals.select(
        "delivered_orders",
        percent(F.col("late"), F.col("delivered_orders"), rounding=F.bround).alias(
            "late_delivery_pct"
        ),
        mean(F.col("days"), F.col("timed"), digits=1, rounding=F.bround).alias(
            "avg_delivery_days"
        ),
    )


def monthly_order_counts(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    return (
        delivered_enriched(orders, status)
        .filter(F.col("order_month").isNotNull())
        .groupBy(F.col("order_month").alias("month"))
        .agg(F.count("order_id").alias("order_count"))
        .orderBy("month")
    )


def order_heatmap(orders: DataFrame) -> DataFrame:
    """Orders by weekday (Monday first) and hour ``h00``..``h23``; no orders is NULL."""
    purchased = F.col("order_purchase_timestamp")
    hours = list(range(24))
    counted = (
        orders.filter(purchased.isNotNull())
        .select(monday_first(purchased).alias("day_no"), F.hour(purchased).alias("hour"), "order_id")
        .groupBy("day_no")
        .pivot("hour", hours)
        .agg(F.count("order_id"))
        .withColumnsRenamed({str(hour): f"h{hour:02d}" for hour in hours})
    )
    week = label_rows(orders.sparkSession, "dow", WEEKDAYS).withColumnRenamed("place", "day_no")
    return week.join(counted, "day_no", "left").orderBy("day_no")


def delivery_day_counts(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    """Delivered orders per elapsed day: the small table behind the distribution measures."""
    return (
        delivered_enriched(orders, status)
        .filter(F.col("delivery_days").isNotNull())
        .groupBy("delivery_days")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def delivery_time_histogram(orders: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins are kept."""
    day, n = F.col("delivery_days"), F.col("n")
    all_days = Window.partitionBy()  # one row per elapsed day
    days = delivery_day_counts(orders).select(
        day,
        n,
        F.min(day).over(all_days).alias("least"),
        F.max(day).over(all_days).alias("most"),
        (F.sum(day * n).over(all_days).cast("double") / F.sum(n).over(all_days)).alias("mean_days"),
    )
    # a single value gets a range of one day around it
    pad = F.when(F.col("most") > F.col("least"), 0.0).otherwise(0.5)
    lo = F.col("least") - pad
    width = (F.col("most") + pad - lo) / bins
    own = F.least(F.lit(bins), F.floor((day - lo) / width).cast("int") + 1)
    # the first day also lists every bin, with no orders of its own
    listed = F.when(
        day == F.col("least"),
        F.transform(
            F.sequence(F.lit(1), F.lit(bins)),
            lambda b: F.struct(b.alias("bin_no"), F.lit(0).cast("bigint").alias("order_count")),
        ),
    )
    counted = F.array(F.struct(own.alias("bin_no"), n.alias("order_count")))
    no_bins = F.array().cast("array<struct<bin_no:int,order_count:bigint>>")
    entry = F.explode(F.concat(counted, F.coalesce(listed, no_bins))).alias("entry")
    return (
        days.select(lo.alias("lo"), width.alias("width"), "mean_days", entry)
        .groupBy("entry.bin_no", "lo", "width", "mean_days")
        .agg(F.sum("entry.order_count").alias("order_count"))
        .select(
            "bin_no",
            (F.col("lo") + (F.col("bin_no") - 1) * F.col("width")).alias("bin_start"),
            (F.col("lo") + F.col("bin_no") * F.col("width")).alias("bin_end"),
            "order_count",
            "mean_days",
        )
        .orderBy("bin_no")
    )


def delivery_time_kde(orders: DataFrame, gridsize: int = CURVE_POINTS) -> DataFrame:
    """Gaussian density estimate on an even grid over [min, max], Scott bandwidth.

    Works on the per-day counts, so its cost depends on the span of days only.
    """
    all_days = Window.partitionBy()  # one row per elapsed day
    x, n = F.col("delivery_days").cast("double"), F.col("n")
    total, first, second = (F.sum(v).over(all_days) for v in (n, x * n, x * x * n))
    variance = F.try_divide(second - first * first / total, total - 1)
    lo, hi = F.min(x).over(all_days), F.max(x).over(all_days)
    days = delivery_day_counts(orders).select(
        x.alias("x"),
        (n / total).alias("weight"),
        lo.alias("lo"),
        ((hi - lo) / (gridsize - 1)).alias("step"),
        (F.sqrt(F.greatest(variance, F.lit(0.0))) * F.pow(total, F.lit(-0.2))).alias("bandwidth"),
    )
    point = F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("point")
    spot = F.col("lo") + F.col("point") * F.col("step")
    distance = F.try_divide(F.col("spot") - F.col("x"), F.col("bandwidth"))
    kernel = F.try_divide(
        F.exp(-distance * distance / 2), F.col("bandwidth") * F.sqrt(2 * F.pi())
    )
    return (
        days.select("*", point)
        .withColumn("spot", spot)
        .groupBy("point", F.col("spot").alias("days"))
        .agg(F.sum(kernel * F.col("weight")).alias("density"))
        .orderBy("point")
    )


def delivery_median(orders: DataFrame) -> DataFrame:
    return delivery_day_counts(orders).agg(
        F.percentile("delivery_days", 0.5, F.col("n")).alias("median_delivery_days"),
        F.sum("n").alias("timed_orders"),
    )


def delivered_share(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    return orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(F.col("order_status") == status).alias("delivered_orders"),
    ).withColumn("delivered_pct", percent(F.col("delivered_orders"), F.col("total_orders")))


def freight_vs_delivery_by_state(
    orders: DataFrame, customers: DataFrame, order_items: DataFrame, status: str = DELIVERED
) -> DataFrame:
    """Mean freight next to mean delivery days, states that have both; one pass over the orders."""
    purchased, arrived, _ = _moments()
    taken = calendar_days(arrived, purchased)
    freight = items_per_order(order_items).select(
        "order_id", "freight", "freight_rows", "item_rows"
    )
    return (
        with_status(orders, status)
        .select("order_id", "customer_id", taken.alias("taken"))
        .join(customers.select("customer_id", "customer_state"), "customer_id")
        .join(freight, "order_id", "left")
        .groupBy("customer_state")
        .agg(
            F.count("item_rows").alias("sold"),
            F.count("taken").alias("delivered_orders"),
            mean(money(F.sum("freight")), F.sum("freight_rows"), MONEY).alias("avg_freight_paid"),
            mean(F.sum("taken"), F.count("taken"), digits=1).alias("avg_delivery_days"),
        )
        .filter((F.col("sold") > 0) & (F.col("delivered_orders") > 0))
        .drop("sold")
        .orderBy("customer_state")
    )


def delay_vs_review_trend(order_master: DataFrame) -> DataFrame:
    """Delay rate and mean review score of the orders bought in each month."""
    score = F.col("review_score")
    return (
        order_master.groupBy(month_number(F.col("order_purchase_timestamp")).alias("month"))
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.sum("is_delivery_delayed").alias("delayed_orders"),
            mean(F.sum(score), F.count(score), SCORE).alias("avg_review_score"),
        )
        .select(
            month_key_of(F.col("month")).alias("order_month"),
            "total_orders",
            "delayed_orders",
            "avg_review_score",
            percent(F.col("delayed_orders"), F.col("total_orders")).alias("delay_rate_pct"),
        )
        .orderBy("order_month")
    )
