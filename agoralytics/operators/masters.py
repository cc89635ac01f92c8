"""Denormalised tables: one row per order, one row per order item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.functions.scalars import calendar_days
from agoralytics.operators.common import labelled_products, score_per_order


def order_master(orders: DataFrame, customers: DataFrame, order_reviews: DataFrame) -> DataFrame:
    """Order, customer, dates, delivery days, late mark (unknown counts as punctual), mean score."""
    arrived, promised = "order_delivered_customer_date", "order_estimated_delivery_date"
    people = customers.select(
        "customer_id", "customer_unique_id", "customer_city", "customer_state"
    )
    return (
        orders.join(people, "customer_id")
        .join(score_per_order(order_reviews), "order_id", "left")
        .select(
            "order_id",
            "customer_id",
            "customer_unique_id",
            "customer_city",
            "customer_state",
            "order_status",
            "order_purchase_timestamp",
            "order_approved_at",
            "order_delivered_carrier_date",
            arrived,
            promised,
            calendar_days(F.col(arrived), F.col("order_purchase_timestamp")).alias("delivery_days"),
            F.when(F.col(arrived) > F.col(promised), 1).otherwise(0).alias("is_delivery_delayed"),
            "review_score",
        )
    )


def order_item_details(
    order_items: DataFrame, products: DataFrame, translation: DataFrame, sellers: DataFrame
) -> DataFrame:
    """Items with category and seller location.

    Product and seller tables are broadcast only when the optimizer knows them to
    be below its threshold; otherwise the sort-merge joins are skew-split at run time.
    """
    return (
        order_items.join(labelled_products(products, translation, "Other"), "product_id")
        .join(sellers.select("seller_id", "seller_state", "seller_city"), "seller_id")
        .select(
            "order_id",
            "order_item_id",
            "product_id",
            "category_english",
            "seller_id",
            "seller_state",
            "seller_city",
            "price",
            "freight_value",
            (F.col("price") + F.col("freight_value")).alias("total_item_cost"),
        )
    )
