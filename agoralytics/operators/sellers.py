"""Seller sales, concentration and leaders; every order counts, delivered or not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.functions.ranking import with_running_total
from agoralytics.functions.scalars import (
    MONEY,
    SCORE,
    cents,
    mean,
    money,
    percent,
    require_money,
)
from agoralytics.operators.common import score_per_order

# Reported ranks and cumulative revenue marks.
MILESTONE_RANKS = (1, 10, 50, 100, 500, 1000)
MILESTONE_SHARES = (20, 50, 80)


def seller_sales(order_items: DataFrame, sellers: DataFrame) -> DataFrame:
    require_money(order_items, "price")
    per_seller = order_items.groupBy("seller_id").agg(
        money(F.sum(cents("price"))).alias("seller_gmv"),
        F.count("order_item_id").alias("units_sold"),
    )
    return per_seller.join(sellers.select("seller_id", "seller_state"), "seller_id").select(
        "seller_id", "seller_state", "seller_gmv", "units_sold"
    )


def seller_pareto(
    order_items: DataFrame,
    sellers: DataFrame,
    ranks: Sequence[int] = MILESTONE_RANKS,
    milestones: Sequence[int] = MILESTONE_SHARES,
) -> DataFrame:
    """Sellers at the given ranks or where the cumulative revenue share rounds to a milestone."""
    ranked = with_running_total(
        seller_sales(order_items, sellers),
        "seller_gmv",
        "seller_id",
        "seller_gmv",
        position="seller_rank",
        total="total_sellers",
        running="running_gmv",
        grand="grand_total_gmv",
    )
    running, grand = F.col("running_gmv"), F.col("grand_total_gmv")
    at_rank = F.col("seller_rank").isin(*ranks)
    at_share = percent(running, grand, MONEY, digits=0).isin(*milestones)
    return (
        ranked.filter(at_rank | at_share)
        .select(
            "seller_id",
            "seller_state",
            "seller_gmv",
            "units_sold",
            "seller_rank",
            percent(F.col("seller_rank"), F.col("total_sellers")).alias("seller_percentile"),
            percent(running, grand, MONEY).alias("cumulative_revenue_pct"),
        )
        .orderBy("seller_rank")
    )


def top20_sellers(
    order_items: DataFrame, sellers: DataFrame, order_reviews: DataFrame, k: int = 20
) -> DataFrame:
    """The ``k`` sellers with the highest sales and their share of all sales.

    The rating is the mean over items of the order's mean score.
    """
    require_money(order_items, "price", "freight_value")
    # one row per seller and order before the reviews are joined
    per_order = order_items.groupBy("seller_id", "order_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("order_item_id").alias("units"),
        F.sum(cents("price")).alias("price"),
        F.sum(cents("freight_value")).alias("freight"),
    )
    score, rows = F.col("review_score"), F.col("rows")
    per_seller = (
        per_order.join(score_per_order(order_reviews), "order_id", "left")
        .groupBy("seller_id")
        .agg(
            money(F.sum("price")).alias("seller_gmv"),
            money(F.sum("freight")).alias("total_freight_earned"),
            F.count("order_id").alias("total_orders"),
            F.sum("units").alias("units_sold"),
            mean(F.sum(rows * score), F.sum(F.when(score.isNotNull(), rows)), SCORE).alias(
                "avg_review_score"
            ),
        )
        .join(sellers.select("seller_id", "seller_state", "seller_city"), "seller_id")
    )
    total = per_seller.agg(F.sum("seller_gmv")).scalar()
    gmv = F.col("seller_gmv")
    return (
        per_seller.orderBy(F.desc("seller_gmv"), "seller_id")
        .limit(k)
        .select(
            "seller_id",
            "seller_state",
            "seller_city",
            "seller_gmv",
            "total_freight_earned",
            "total_orders",
            "units_sold",
            "avg_review_score",
            percent(gmv, total, MONEY).alias("gmv_share_pct"),
        )
    )
