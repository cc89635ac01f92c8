"""Top-line revenue, payment, state, month and category measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agoralytics.functions.scalars import (
    MONEY,
    SCORE,
    cents,
    flag,
    mean,
    money,
    month_key_of,
    month_number,
    percent,
    ratio,
    require_money,
)
from agoralytics.operators.common import (
    DELIVERED,
    items_per_order,
    labelled_products,
    score_per_order,
    with_status,
)


def repeat_customer_rate(
    orders: DataFrame, customers: DataFrame, status: str = DELIVERED
) -> DataFrame:
    """Customers with more than one delivered order."""
    buyers = (
        with_status(orders, status)
        .select("order_id", "customer_id")
        .join(customers.select("customer_id", "customer_unique_id"), "customer_id")
        .groupBy("customer_unique_id")
        .agg(flag(F.count("order_id") > 1).alias("repeated"))
    )
    return buyers.agg(
        F.count(F.lit(1)).alias("unique_customers"),
        F.sum("repeated").alias("repeat_customers"),
    ).withColumn("repeat_pct", percent(F.col("repeat_customers"), F.col("unique_customers")))


def business_summary(
    orders: DataFrame, customers: DataFrame, order_items: DataFrame, status: str = DELIVERED
) -> DataFrame:
    """One row of totals over delivered orders that have items and a customer.

    Items become one row per order before the join, so a huge order is reduced where it is
    read. What follows keeps the partitioning by order: an order counts once even where its
    customer is listed twice, and buyers are summed before they are counted. Sellers need only
    the distinct pairs of order and seller.
    """
    require_money(order_items, "price", "freight_value")
    price, freight = cents("price"), cents("freight_value")
    per_order = order_items.groupBy("order_id").agg(
        F.sum(price).alias("price"),
        F.sum(freight).alias("freight"),
        F.sum(price + freight).alias("revenue"),
        F.count("order_item_id").alias("units"),
    )
    bought = (
        with_status(orders, status)
        .select("order_id", "customer_id")
        .join(customers.select("customer_id", "customer_unique_id"), "customer_id")
        .select("order_id", "customer_unique_id")
    )
    measures = ("price", "freight", "revenue", "units")
    sums = [F.sum(m).alias(m) for m in measures]
    pairs = bought.join(per_order, "order_id").groupBy("order_id", "customer_unique_id").agg(*sums)
    first = F.row_number().over(Window.partitionBy("order_id").orderBy("customer_unique_id")) == 1
    buyers = (
        pairs.withColumn("first", flag(first))
        .groupBy("customer_unique_id")
        .agg(F.sum("first").alias("orders"), *sums)
    )
    sellers = (
        order_items.select("order_id", "seller_id")
        .distinct()
        .join(bought.select("order_id"), "order_id", "left_semi")
        .select("seller_id")
        .distinct()
        .agg(F.count("seller_id"))
    )
    totals = buyers.agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("total_delivered_orders"),
        F.count("customer_unique_id").alias("total_unique_buyers"),
        *(F.sum(m).alias(m) for m in measures[:-1]),
        F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
    ).withColumn("active_sellers", sellers.scalar())
    n = F.col("total_delivered_orders")
    gmv = money(F.col("price"))
    return totals.select(
        n,
        "total_unique_buyers",
        "active_sellers",
        gmv.alias("total_item_gmv"),
        money(F.col("freight")).alias("total_freight"),
        money(F.col("revenue")).alias("total_gross_revenue"),
        mean(gmv, n, MONEY).alias("avg_order_value"),
        mean(F.col("units"), n).alias("avg_items_per_order"),
    )


def payment_breakdown(order_payments: DataFrame) -> DataFrame:
    """Transactions, value and their shares by payment type, all orders."""
    require_money(order_payments, "payment_value")
    by_type = order_payments.groupBy("payment_type").agg(
        F.count("order_id").alias("transaction_count"),
        money(F.sum(cents("payment_value"))).alias("total_payment_value"),
        F.count("payment_value").alias("_valued"),
        F.sum("payment_installments").alias("_installments"),
        F.count("payment_installments").alias("_planned"),
    )
    everything = Window.partitionBy()  # one row per payment type
    n, value = F.col("transaction_count"), F.col("total_payment_value")
    return by_type.select(
        "payment_type",
        n,
        percent(n, F.sum(n).over(everything)).alias("transaction_share_pct"),
        value,
        percent(value, F.sum(value).over(everything), MONEY).alias("revenue_share_pct"),
        mean(F.col("_installments"), F.col("_planned"), digits=1).alias("avg_installments"),
        mean(value, F.col("_valued"), MONEY).alias("avg_ticket_size"),
    ).orderBy(F.desc("total_payment_value"), "payment_type")


def state_revenue(
    orders: DataFrame, customers: DataFrame, order_items: DataFrame, status: str = DELIVERED
) -> DataFrame:
    """Buyers, orders and revenue by customer state, delivered orders."""
    people = customers.select("customer_id", "customer_unique_id", "customer_state")
    return (
        with_status(orders, status)
        .select("order_id", "customer_id")
        .join(people, "customer_id")
        .join(items_per_order(order_items), "order_id")
        .groupBy("customer_state")
        .agg(
            F.count_distinct("customer_unique_id").alias("unique_customers"),
            F.count("order_id").alias("total_orders"),
            money(F.sum("revenue")).alias("total_revenue"),
            mean(money(F.sum("freight")), F.sum("freight_rows"), MONEY).alias("avg_freight_paid"),
        )
        .orderBy(F.desc("total_revenue"), "customer_state")
    )


def state_revenue_top10(
    orders: DataFrame, customers: DataFrame, order_items: DataFrame, k: int = 10
) -> DataFrame:
    return state_revenue(orders, customers, order_items).limit(k)


def monthly_revenue_growth(
    orders: DataFrame, order_items: DataFrame, status: str = DELIVERED
) -> DataFrame:
    """Revenue per month and its change against the previous month that has sales."""
    monthly = (
        with_status(orders, status)
        .select("order_id", month_number(F.col("order_purchase_timestamp")).alias("month"))
        .join(items_per_order(order_items), "order_id")
        .groupBy("month")
        .agg(F.count("order_id").alias("total_orders"), F.sum("revenue").alias("revenue"))
        .select(
            month_key_of(F.col("month")).alias("order_month"),
            "total_orders",
            money(F.col("revenue")).alias("monthly_revenue"),
        )
    )
    by_month = Window.orderBy("order_month")  # one row per calendar month
    now, before = F.col("monthly_revenue"), F.col("prev_month_revenue")
    return (
        monthly.withColumn("prev_month_revenue", F.lag("monthly_revenue").over(by_month))
        .withColumn("mom_growth_pct", percent(now - before, before, MONEY))
        .orderBy("order_month")
    )


def category_revenue(
    order_items: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    translation: DataFrame,
    order_reviews: DataFrame,
    missing: str = "Unknown",
    status: str = DELIVERED,
) -> DataFrame:
    """Orders, units, sales and mean rating by category, delivered orders.

    The rating is the mean over items of the order's mean score.
    """
    require_money(order_items, "price")
    # Items collapse to one row per category and order before they meet the
    # orders, so neither a huge order nor a huge category travels row by row.
    per_order = (
        order_items.select("order_id", "order_item_id", "product_id", "price")
        .join(labelled_products(products, translation, missing), "product_id")
        .groupBy("category_english", "order_id")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("order_item_id").alias("units"),
            F.sum(cents("price")).alias("sales"),
            F.count("price").alias("priced"),
        )
    )
    scored = (
        with_status(orders, status)
        .select("order_id")
        .join(score_per_order(order_reviews), "order_id", "left")
    )
    score, rows = F.col("review_score"), F.col("rows")
    return (
        per_order.join(scored, "order_id")
        .groupBy("category_english")
        .agg(
            F.count("order_id").alias("total_orders"),
            F.sum("units").alias("total_units_sold"),
            money(F.sum("sales")).alias("total_sales_value"),
            mean(money(F.sum("sales")), F.sum("priced"), MONEY).alias("avg_item_price"),
            mean(F.sum(rows * score), F.sum(F.when(score.isNotNull(), rows)), SCORE).alias(
                "avg_customer_rating"
            ),
        )
        .orderBy(F.desc("total_sales_value"), "category_english")
    )


def category_revenue_top10(
    order_items: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    translation: DataFrame,
    order_reviews: DataFrame,
    k: int = 10,
) -> DataFrame:
    return category_revenue(order_items, orders, products, translation, order_reviews).limit(k)


def top_categories_all_orders(
    order_items: DataFrame, products: DataFrame, translation: DataFrame, k: int = 10
) -> DataFrame:
    """Categories by price total over every order, unlabelled products left out."""
    require_money(order_items, "price")
    per_product = order_items.groupBy("product_id").agg(F.sum(cents("price")).alias("sales"))
    return (
        per_product.join(labelled_products(products, translation, None), "product_id")
        .filter(F.col("category_english").isNotNull())
        .groupBy("category_english")
        .agg(money(F.sum("sales")).alias("price"))
        .orderBy(F.desc("price"), "category_english")
        .limit(k)
    )


def revenue_growth_multiple(monthly: DataFrame, lo: str, hi: str) -> DataFrame:
    """Revenue of month ``hi`` as a multiple of month ``lo``, and the best month."""

    def of(month: str):
        return F.max(F.when(F.col("order_month") == month, F.col("monthly_revenue")))

    return monthly.agg(
        of(lo).alias("first_revenue"),
        of(hi).alias("last_revenue"),
        F.max_by("order_month", "monthly_revenue").alias("peak_month"),
        F.max("monthly_revenue").alias("peak_revenue"),
    ).withColumn(
        "growth_multiple",
        ratio(F.col("last_revenue"), F.col("first_revenue"), (MONEY, MONEY)),
    )

