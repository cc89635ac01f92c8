"""The named views: a registry of builders, published as temporary views.

Every view is a plan over its tables and is expanded whenever it is queried, also those that
need a global order. Rows appended to catalog tables by the same session show at once; files
that others add show after ``REFRESH TABLE`` of the view. Nothing is written or run on publishing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from agoralytics.operators import cohorts, kpis, logistics, masters, quality, rfm, sellers

Tables = Mapping[str, DataFrame]
Builder = Callable[[Tables], DataFrame]


def _of(operator: Callable[..., DataFrame], *names: str, **fixed) -> Builder:
    return lambda t: operator(*(t[n] for n in names), **fixed)


_BUYING = ("orders", "customers")
_SELLING = ("order_items", "sellers")
_PAYING = ("orders", "customers", "order_payments")
_LABELS = ("products", "translation")

VIEWS: dict[str, Builder] = {
    "vw_row_count_audit": quality.row_count_audit,
    "vw_duplicate_orders": _of(quality.duplicate_orders, "orders"),
    "vw_customer_uniqueness_audit": _of(quality.customer_uniqueness_audit, "customers"),
    "vw_order_status_audit": _of(quality.order_status_audit, "orders"),
    "vw_date_boundaries": _of(quality.date_boundaries, "orders"),
    "vw_repeat_customer_rate": _of(kpis.repeat_customer_rate, *_BUYING),
    "vw_business_summary": _of(kpis.business_summary, *_BUYING, "order_items"),
    "vw_payment_breakdown": _of(kpis.payment_breakdown, "order_payments"),
    "vw_state_revenue": _of(kpis.state_revenue, *_BUYING, "order_items"),
    "vw_monthly_revenue_growth": _of(kpis.monthly_revenue_growth, "orders", "order_items"),
    "vw_category_revenue": _of(
        kpis.category_revenue, "order_items", "orders", *_LABELS, "order_reviews"
    ),
    "vw_delivery_by_state": _of(logistics.delivery_by_state, *_BUYING),
    "vw_delay_review_impact": _of(logistics.delay_review_impact, "orders", "order_reviews"),
    "vw_cohort_retention_counts": _of(cohorts.cohort_retention_counts, *_BUYING),
    "vw_cohort_retention_pct": _of(cohorts.cohort_retention_pct, *_BUYING),
    "vw_rfm_top100": _of(rfm.rfm_top100, *_PAYING, live=True),
    "vw_seller_pareto": _of(sellers.seller_pareto, *_SELLING),
    "vw_top20_sellers": _of(sellers.top20_sellers, *_SELLING, "order_reviews"),
    "vw_order_master": _of(masters.order_master, *_BUYING, "order_reviews"),
    "vw_order_item_details": _of(masters.order_item_details, "order_items", *_LABELS, "sellers"),
    "vw_rfm_customer_segments": _of(rfm.rfm_customer_segments, *_PAYING, live=True),
    "vw_cohort_retention": _of(cohorts.cohort_retention, *_BUYING),
}

# Base tables published under another name than their short one.
_TABLE_VIEWS = {"translation": "product_category_name_translation"}


def publish_view(name: str, df: DataFrame) -> DataFrame:
    """Create or replace the temporary view ``name`` and return it as a table."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def publish_tables(tables: Tables) -> list[str]:
    """Publish the base tables under their short names (the translation under its full one)."""
    names = [_TABLE_VIEWS.get(name, name) for name in tables]
    for name, df in zip(names, tables.values()):
        publish_view(name, df)
    return names


def publish_views(tables: Tables, names: Iterable[str] | None = None) -> list[str]:
    """Publish the named views, all of them by default."""
    chosen = list(VIEWS if names is None else names)
    for name in chosen:
        publish_view(name, VIEWS[name](tables))
    return chosen


def list_views(spark: SparkSession) -> DataFrame:
    """Names of the temporary views of the session."""
    return (
        spark.sql("SHOW VIEWS").filter("isTemporary").select("viewName").orderBy("viewName")
    )
