"""Row counts, missing values, duplicates, key checks and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoralytics.functions.ranking import series_quantiles
from agoralytics.functions.scalars import complete_months, flag, money, percent
from agoralytics.operators.common import DELIVERED, payment_per_order, with_status


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_count_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _stack(
        [
            df.agg(F.count(F.lit(1)).alias("total_rows")).select(
                F.lit(name).alias("table_name"), "total_rows"
            )
            for name, df in tables.items()
        ]
    )


def table_shapes(tables: Mapping[str, DataFrame]) -> DataFrame:
    widths = F.create_map(
        *(part for name, df in tables.items() for part in (F.lit(name), F.lit(len(df.columns))))
    )
    return row_count_audit(tables).withColumn("total_columns", widths[F.col("table_name")])


def _per_column(df: DataFrame, measure, value: str) -> DataFrame:
    """One pass over ``df``: ``measure`` of every column plus the row count, as rows."""
    names = df.columns
    wide = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *(measure(F.col(name)).alias(f"c{i}") for i, name in enumerate(names)),
    )
    rows = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(i + 1).alias("column_no"),
                    F.lit(name).alias("column_name"),
                    F.col(f"c{i}").alias(value),
                )
                for i, name in enumerate(names)
            )
        )
    )
    return wide.select("total_rows", rows.alias("r")).select("total_rows", "r.*")


def schema_info(df: DataFrame) -> DataFrame:
    """Column number, name, type and count of present values."""
    types = F.create_map(
        *(part for name, kind in df.dtypes for part in (F.lit(name), F.lit(kind)))
    )
    return _per_column(df, F.count, "non_null_count").select(
        "column_no", "column_name", types[F.col("column_name")].alias("dtype"), "non_null_count"
    )


def null_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns with missing values: how many and what share of the rows."""
    return _stack(
        [
            _per_column(df, lambda c: F.count_if(c.isNull()), "null_count")
            .filter(F.col("null_count") > 0)
            .select(
                F.lit(name).alias("table_name"),
                "column_name",
                "null_count",
                percent(F.col("null_count"), F.col("total_rows")).alias("null_pct"),
            )
            for name, df in tables.items()
        ]
    )


def duplicate_orders(orders: DataFrame, key: str = "order_id") -> DataFrame:
    return (
        orders.groupBy(key)
        .agg(F.count(F.lit(1)).alias("occurrence_count"))
        .filter(F.col("occurrence_count") > 1)
    )


def duplicate_order_count(orders: DataFrame, key: str = "order_id") -> DataFrame:
    return duplicate_orders(orders, key).agg(F.count(F.lit(1)).alias("duplicate_order_count"))


def duplicated_keys(
    orders: DataFrame, customers: DataFrame, products: DataFrame, sellers: DataFrame
) -> DataFrame:
    """Rows after the first per key; missing keys count as one value."""
    keyed = (
        ("orders", orders, "order_id"),
        ("customers", customers, "customer_id"),
        ("products", products, "product_id"),
        ("sellers", sellers, "seller_id"),
    )
    return _stack(
        [
            df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("_rows"))
            .agg(F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("duplicated_rows"))
            .select(
                F.lit(name).alias("table_name"), F.lit(key).alias("key_column"), "duplicated_rows"
            )
            for name, df, key in keyed
        ]
    )


def customer_uniqueness_audit(customers: DataFrame) -> DataFrame:
    # first one row per person (map-side combined), then the totals
    people = customers.groupBy("customer_unique_id").agg(F.count("customer_id").alias("_rows"))
    return people.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_order_customers"),
        F.count("customer_unique_id").alias("total_unique_humans"),
    ).withColumn(
        "repeat_customer_transactions",
        F.col("total_order_customers") - F.col("total_unique_humans"),
    )


def order_status_audit(orders: DataFrame) -> DataFrame:
    missing = F.sum(flag(F.col("order_delivered_customer_date").isNull()))
    return (
        orders.groupBy("order_status")
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            missing.alias("missing_delivery_date_count"),
        )
        .withColumn("pct_missing", percent(F.col("missing_delivery_date_count"), F.col("total_orders")))
        .orderBy(F.desc("total_orders"), "order_status")
    )


def status_value_counts(orders: DataFrame) -> DataFrame:
    return (
        orders.filter(F.col("order_status").isNotNull())
        .groupBy("order_status")
        .agg(F.count(F.lit(1)).alias("order_count"))
        .orderBy(F.desc("order_count"), "order_status")
    )


def date_boundaries(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.min("order_purchase_timestamp").alias("earliest_purchase"),
        F.max("order_purchase_timestamp").alias("latest_purchase"),
    ).withColumn(
        "active_months_span",
        complete_months(F.col("earliest_purchase"), F.col("latest_purchase")),
    )


def primary_key_check(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """Rows without a complete key, keys used more than once, rows beyond the first of each key."""
    incomplete: Column = reduce(Column.__or__, (F.col(k).isNull() for k in keys))
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    repeated = ~incomplete & (F.col("_rows") > 1)
    return per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(incomplete, F.col("_rows"))), F.lit(0)).alias("null_key_rows"),
        F.count_if(repeated).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(repeated, F.col("_rows") - 1)), F.lit(0)).alias("surplus_rows"),
    ).select(
        F.lit(name).alias("table_name"),
        F.lit(",".join(keys)).alias("key_columns"),
        "total_rows",
        "null_key_rows",
        "repeated_keys",
        "surplus_rows",
    )


def foreign_key_check(
    child: DataFrame, parent: DataFrame, key: str, names: tuple[str, str] = ("child", "parent")
) -> DataFrame:
    """Child rows whose key is present but has no parent row.

    Counting rows per key first leaves one row per key for the anti join.
    """
    per_key = (
        child.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    orphans = per_key.join(parent.select(key), key, "left_anti")
    return orphans.agg(
        F.count(F.lit(1)).alias("orphan_keys"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("orphan_rows"),
    ).select(
        F.lit(names[0]).alias("child_table"),
        F.lit(names[1]).alias("parent_table"),
        F.lit(key).alias("key_column"),
        "orphan_keys",
        "orphan_rows",
    )


# The rows of a numeric profile, in order.
PROFILE_ROWS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")
_QUARTILES = (0.25, 0.5, 0.75)


def describe_rfm(rfm: DataFrame) -> DataFrame:
    """Eight-row numeric profile of recency, frequency and monetary value.

    The quartiles of all three are searched by magnitude in one pass; no rows are sorted.
    """
    columns = ("recency", "frequency", "monetary")
    series = F.array(
        *(F.struct(F.lit(i).alias("series"), F.col(name).cast("decimal(22,2)").alias("value")) for i, name in enumerate(columns))
    )
    rows = rfm.select(F.explode(series).alias("_s")).select("_s.*")
    found = series_quantiles(rows, _QUARTILES)
    picked = found.agg(
        *(
            F.max(F.when(F.col("series") == i, F.col(f"q{k}"))).alias(f"{name}_{4 + k}")
            for i, name in enumerate(columns)
            for k in range(len(_QUARTILES))
        )
    )
    quartiles = picked.select(F.struct(*picked.columns)).scalar()

    def measures(name: str) -> list[Column]:
        value = F.col(name).cast("double")
        return [
            F.count(name).cast("double").alias(f"{name}_0"),
            F.avg(value).alias(f"{name}_1"),
            F.stddev_samp(value).alias(f"{name}_2"),
            F.min(value).alias(f"{name}_3"),
            F.max(value).alias(f"{name}_7"),
        ]

    wide = rfm.agg(*(m for name in columns for m in measures(name)))
    wide = wide.withColumn("_quartiles", quartiles).select("*", "_quartiles.*")
    rows = F.array(
        *(
            F.struct(
                F.lit(i).alias("row_no"),
                F.lit(label).alias("statistic"),
                *(F.col(f"{name}_{i}").alias(name) for name in columns),
            )
            for i, label in enumerate(PROFILE_ROWS)
        )
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*").orderBy("row_no")


def analysis_set_counts(
    orders: DataFrame, customers: DataFrame, order_payments: DataFrame, status: str = DELIVERED
) -> DataFrame:
    """Size of the delivered-and-paid set: rows, distinct customers, money."""
    paid = (
        with_status(orders, status)
        .select("order_id", "customer_id")
        .join(payment_per_order(order_payments), "order_id")
        .join(customers.select("customer_id", "customer_unique_id"), "customer_id")
    )
    people = paid.groupBy("customer_unique_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("paid").alias("paid")
    )
    return people.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("analysis_rows"),
        F.count("customer_unique_id").alias("unique_customers"),
        money(F.sum("paid")).alias("total_payment_value"),
    )


def preview(df: DataFrame, n: int, order_by: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows in a stated order."""
    return df.orderBy(*order_by).limit(n)
