"""Recency, frequency and monetary segmentation.

Two models are kept apart. The SQL model measures recency in calendar days
against the last order of any kind and cuts with NTILE; the notebook model
measures elapsed days against the last paid delivery and cuts a first-come rank
at its quartiles. Ties are ordered by customer id in both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoralytics.functions.ranking import ntile_ends, quantile_ends, with_tiles
from agoralytics.functions.scalars import (
    MONEY,
    calendar_days,
    cents,
    elapsed_days,
    first_match,
    mean,
    money,
    percent,
)
from agoralytics.operators.common import DELIVERED, payment_per_order, with_status
from agoralytics.plans.staging import staged

# Segment labels.
CHAMPIONS = "Champions"
LOYAL = "Loyal Customers"
ATTENTION = "Needs Attention (Repeat)"
AT_RISK = "Cant Lose Them (At Risk)"
PROMISING = "Promising High-Spenders"
LOST = "Lost / Churned"
STANDARD = "Standard One-Time Buyers"

SCORE_LEVELS = 4


def segment(with_attention: bool) -> Column:
    """Segment from the three scores; the short label set has no attention class."""
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    repeat, recent, spender = f == 4, r >= 3, m >= 3
    rules = [
        (repeat & recent & spender, CHAMPIONS),
        (repeat & recent, LOYAL),
        (repeat & (r == 1), AT_RISK),
        ((f == 1) & recent & spender, PROMISING),
        ((r == 1) & (m == 1), LOST),
    ]
    if with_attention:
        rules.insert(2, (repeat & (r == 2), ATTENTION))
    return first_match(rules, STANDARD)


def _rfm_code() -> Column:
    return F.concat(*(F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")))


def _frequency_score(orders_placed: str) -> Column:
    return F.when(F.col(orders_placed) > 1, SCORE_LEVELS).otherwise(1)


def _per_customer(
    orders: DataFrame, customers: DataFrame, payments: DataFrame, status: str = DELIVERED
) -> DataFrame:
    """Last purchase, number of orders and spend over delivered, paid orders."""
    return (
        with_status(orders, status)
        .select("order_id", "customer_id", "order_purchase_timestamp")
        .join(payment_per_order(payments), "order_id")
        .join(customers.select("customer_id", "customer_unique_id"), "customer_id")
        .groupBy("customer_unique_id")
        .agg(
            F.max("order_purchase_timestamp").alias("last_purchase"),
            F.count("order_id").alias("orders_placed"),
            money(F.sum("paid")).alias("spend"),
        )
    )


def customer_rfm_raw(
    orders: DataFrame, customers: DataFrame, payments: DataFrame, status: str = DELIVERED
) -> DataFrame:
    reference = orders.agg(F.max("order_purchase_timestamp")).scalar()
    return _per_customer(orders, customers, payments, status).select(
        "customer_unique_id",
        calendar_days(reference, F.col("last_purchase")).alias("recency_days"),
        F.col("orders_placed").alias("frequency_orders"),
        F.col("spend").alias("monetary_spend"),
    )


# Where a customer without a value goes when customers are put in order.
_FIRST, _LAST = -(1 << 62), 1 << 62


def _ordered(value: Column, missing: int) -> Column:
    return F.coalesce(value.cast("bigint"), F.lit(missing).cast("bigint"))


def rfm_scores(rfm_raw: DataFrame, n: int = SCORE_LEVELS) -> DataFrame:
    """NTILE scores: the latest buyers and the highest spenders get ``n``.

    Longest ago first and, for spend, lowest first; customers without a value come last by
    recency and first by spend. Only the last customer of each tile is looked for.
    """
    orders = {
        "r_score": _ordered(-F.col("recency_days"), _LAST),
        "m_score": _ordered(cents("monetary_spend"), _FIRST),
    }
    return with_tiles(rfm_raw, "customer_unique_id", orders, n, ntile_ends).select(
        *rfm_raw.columns, "r_score", _frequency_score("frequency_orders").alias("f_score"), "m_score"
    )


def scored_customers(
    orders: DataFrame, customers: DataFrame, payments: DataFrame, live: bool = False
) -> DataFrame:
    """The scores behind the three results below; compute once when several are wanted.

    The search for the ends of tiles reads the customers several times, so they are written
    once, one row each; where the result must follow the tables, ``live``, they are not.
    """
    raw = customer_rfm_raw(orders, customers, payments)
    return rfm_scores(raw if live else staged(raw, "customers"))


def label_customers(scores: DataFrame) -> DataFrame:
    """Scores with the three-digit code and the seven-label segment."""
    return scores.withColumn("rfm_code", _rfm_code()).withColumn("customer_segment", segment(True))


def top_spenders(scores: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` highest spenders with code and six-label segment."""
    return (
        scores.select(
            "customer_unique_id",
            "recency_days",
            "frequency_orders",
            "monetary_spend",
            _rfm_code().alias("rfm_code"),
            segment(False).alias("customer_segment"),
        )
        .orderBy(F.desc("monetary_spend"), "customer_unique_id")
        .limit(k)
    )


def summarise_segments(scores: DataFrame) -> DataFrame:
    """Size and revenue of the six-label segments."""
    everything = Window.partitionBy()  # one row per segment label
    spend = F.col("monetary_spend")
    per_segment = scores.groupBy(segment(False).alias("customer_segment")).agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum(spend).alias("total_revenue"),
        mean(F.sum(spend), F.count(spend), MONEY).alias("avg_spend_per_customer"),
    )
    return per_segment.select(
        "customer_segment",
        "customer_count",
        percent(F.col("customer_count"), F.sum("customer_count").over(everything)).alias(
            "pct_of_customers"
        ),
        "total_revenue",
        "avg_spend_per_customer",
    ).orderBy(F.desc("total_revenue"), "customer_segment")


def rfm_customer_segments(
    orders: DataFrame, customers: DataFrame, payments: DataFrame, live: bool = False
) -> DataFrame:
    return label_customers(scored_customers(orders, customers, payments, live))


def rfm_top100(
    orders: DataFrame, customers: DataFrame, payments: DataFrame, k: int = 100, live: bool = False
) -> DataFrame:
    return top_spenders(scored_customers(orders, customers, payments, live), k)


def rfm_segment_summary_sql(
    orders: DataFrame, customers: DataFrame, payments: DataFrame
) -> DataFrame:
    return summarise_segments(scored_customers(orders, customers, payments))


def rfm_pandas(
    orders: DataFrame, customers: DataFrame, payments: DataFrame, status: str = DELIVERED
) -> DataFrame:
    """Notebook model: recency, frequency, monetary, scores, code and seven-label segment."""
    known = _per_customer(orders, customers, payments, status).filter(F.col("customer_unique_id").isNotNull())
    # one row per customer, read for the latest purchase, for the ends of bins and for the result
    people = staged(known, "customers")
    reference = people.agg(F.max("last_purchase")).scalar()
    base = people.select(
        "customer_unique_id",
        elapsed_days(reference, F.col("last_purchase")).alias("recency"),
        F.col("orders_placed").alias("frequency"),
        # a sum of nothing is zero in this model
        F.coalesce("spend", F.lit(0).cast("decimal(22,2)")).alias("monetary"),
    )
    ranks = {"_by_recency": _ordered(F.col("recency"), _FIRST), "_by_spend": _ordered(cents("monetary"), _FIRST)}
    return (
        with_tiles(base, "customer_unique_id", ranks, SCORE_LEVELS, quantile_ends)
        .select(
            *base.columns,
            (SCORE_LEVELS + 1 - F.col("_by_recency")).alias("r_score"),
            _frequency_score("frequency").alias("f_score"),
            F.col("_by_spend").alias("m_score"),
        )
        .withColumn("rfm_code", _rfm_code())
        .withColumn("customer_segment", segment(True))
    )


def rfm_segment_summary(rfm: DataFrame) -> DataFrame:
    """Notebook summary: size, mean spend, revenue and shares, rounded half to even."""
    everything = Window.partitionBy()  # one row per segment label
    spend = F.col("monetary")
    per_segment = rfm.groupBy("customer_segment").agg(
        F.count("customer_unique_id").alias("customer_count"),
        mean(F.sum(spend), F.count(spend), MONEY, rounding=F.bround).alias("avg_spend"),
        F.sum(spend).alias("total_revenue"),
    )
    return per_segment.select(
        "*",
        percent(
            F.col("customer_count"),
            F.sum("customer_count").over(everything),
            rounding=F.bround,
        ).alias("customer_pct"),
        percent(
            F.col("total_revenue"),
            F.sum("total_revenue").over(everything),
            MONEY,
            rounding=F.bround,
        ).alias("revenue_pct"),
    ).orderBy(F.desc("total_revenue"), "customer_segment")


def segment_value_counts(rfm: DataFrame) -> DataFrame:
    return (
        rfm.groupBy("customer_segment")
        .agg(F.count(F.lit(1)).alias("customer_count"))
        .orderBy(F.desc("customer_count"), "customer_segment")
    )


def segment_chart_feeds(summary: DataFrame) -> DataFrame:
    """Rows of the two segment charts: by customer count and by revenue, each in drawing order."""
    bars = F.array(
        *(
            F.struct(
                F.lit(chart).alias("chart"),
                "customer_segment",
                F.col(measure).cast(MONEY).alias("value"),
            )
            for chart, measure in (("customers", "customer_count"), ("revenue", "total_revenue"))
        )
    )
    # one row per chart and segment label
    order = Window.partitionBy("chart").orderBy(F.desc("value"), "customer_segment")
    return (
        summary.select(F.explode(bars).alias("bar"))
        .select("bar.*")
        .withColumn("place", F.row_number().over(order))
    )


def top_share(summary: DataFrame, segments: Sequence[str] = (CHAMPIONS, PROMISING)) -> DataFrame:
    """Share of customers and of revenue held by the named segments together."""
    chosen = F.col("customer_segment").isin(*segments)

    def held(column: str) -> Column:
        return F.sum(F.when(chosen, F.col(column)))

    return summary.agg(
        percent(held("customer_count"), F.sum("customer_count"), digits=1).alias("customer_pct"),
        percent(held("total_revenue"), F.sum("total_revenue"), MONEY, digits=1).alias(
            "revenue_pct"
        ),
    )
