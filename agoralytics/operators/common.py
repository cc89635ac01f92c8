"""Frames several operators start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoralytics.functions.scalars import cents, mean, require_money

DELIVERED = "delivered"


def with_status(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    return orders.filter(F.col("order_status") == status)


def label_rows(spark: SparkSession, column: str, labels: Sequence[str]) -> DataFrame:
    """A fixed list of labels as rows, numbered from 1 in ``place``."""
    listed = F.posexplode(F.array(*map(F.lit, labels))).alias("place", column)
    return spark.range(1).select(listed).withColumn("place", F.col("place") + 1)


def items_per_order(order_items: DataFrame) -> DataFrame:
    """Cents and unit totals, one row per order.

    Summing before the join keeps an order with very many items from becoming
    one join task, and the join on ``order_id`` reuses this shuffle.
    """
    require_money(order_items, "price", "freight_value")
    price, freight = cents("price"), cents("freight_value")
    return order_items.groupBy("order_id").agg(
        F.sum(freight).alias("freight"),
        F.count("freight_value").alias("freight_rows"),
        F.sum(price + freight).alias("revenue"),
        F.count(F.lit(1)).alias("item_rows"),
    )


def payment_per_order(order_payments: DataFrame) -> DataFrame:
    """Cents paid, one row per order."""
    require_money(order_payments, "payment_value")
    return order_payments.groupBy("order_id").agg(F.sum(cents("payment_value")).alias("paid"))


def score_per_order(order_reviews: DataFrame) -> DataFrame:
    """Mean review score per order to four decimals."""
    return (
        order_reviews.groupBy("order_id")
        .agg(F.sum("review_score").alias("_total"), F.count("review_score").alias("_n"))
        .select(
            "order_id",
            mean(F.col("_total"), F.col("_n"), digits=4).cast("decimal(14,4)").alias("review_score"),
        )
    )


def labelled_products(products: DataFrame, translation: DataFrame, missing: str | None) -> DataFrame:
    """Product → category label: English name, else the original name, else ``missing``."""
    names = [F.col("product_category_name_english"), F.col("product_category_name")]
    if missing is not None:
        names.append(F.lit(missing))
    return (
        products.select("product_id", "product_category_name")
        .join(
            translation.select("product_category_name", "product_category_name_english"),
            "product_category_name",
            "left",
        )
        .select("product_id", F.coalesce(*names).alias("category_english"))
    )
