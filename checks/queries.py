"""Every operator as a query over the sample tables in a folder."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agoralytics.operators import (
    cohorts,
    hypothesis,
    kpis,
    logistics,
    masters,
    quality,
    rfm,
    sellers,
)
from agoralytics.plans import views
from agoralytics.plans.staging import fresh_path
from agoralytics.schemas import FOREIGN_KEYS, TABLES
from agoralytics.sources import sinks, spellings, tables
from agoralytics.sources.sample_tables import SampleTables

Tables = Mapping[str, DataFrame]
Query = Callable[[SparkSession, str], DataFrame]

# The sample orders run from 1995 to 2001 and come from a hundred suppliers per
# hundredth of a scale unit, hence these parameters instead of the defaults.
COHORTS = ("1995-01", "1996-01")
PARETO_RANKS = (1, 10, 50, 100)
GROWTH_MONTHS = ("1995-02", "2000-04")
_PROFILED = ("orders", "customers", "order_items", "order_payments", "order_reviews", "products")


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Plain types for a cross-engine comparison: bigint, double to ``digits`` decimals, text."""

    def plain(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, digits)
        elif isinstance(field.dataType, T.IntegralType):
            column = column.cast("bigint")
        return column.alias(field.name)

    return df.select(*map(plain, df.schema.fields))


def _query(build: Callable[[Tables], DataFrame], digits: int = 6) -> Query:
    return lambda spark, folder: comparable(build(SampleTables(spark, folder)), digits)


def _on(operator: Callable[..., DataFrame], *names: str, **fixed) -> Query:
    return _query(lambda t: operator(*(t[n] for n in names), **fixed))


# --- ingest and sinks: written as CSV, read back by the library's reader ---


def _as_csv(df: DataFrame) -> str:
    path = fresh_path(df.sparkSession, "csv")
    return sinks.write_csv(df, path)


def _read_back(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> Query:
    return _query(lambda t: reader(t[name].sparkSession, _as_csv(t[name])))


def _spoiled_payments(t: Tables) -> str:
    spoiled = t["order_payments"].withColumn(
        "payment_installments",
        F.when(F.col("order_id") % 97 == 0, F.lit("unknown")).otherwise(
            F.col("payment_installments").cast("string")
        ),
    )
    return _as_csv(spoiled)


def _rejected(t: Tables) -> DataFrame:
    bad = tables.rejected_rows(
        t["order_payments"].sparkSession, _spoiled_payments(t), TABLES["order_payments"].schema
    )
    return bad.withColumnRenamed(tables.REJECTED, "raw_line")


# Letters are accented in one row of three, else written small in one of five.
VARIANT = (
    "CASE WHEN {row} % 3 = 0 THEN REPLACE({text}, 'A', 'Ã') WHEN {row} % 5 = 0 THEN LOWER({text}) ELSE {text} END"
)


def _respelt(t: Tables) -> dict[str, DataFrame]:
    """The sample tables with accent and case variants of categories and states."""
    changed = {name: t[name] for name in t}
    for name, column, row in (
        ("products", "product_category_name", "product_id"),
        ("customers", "customer_state", "customer_id"),
    ):
        variant = F.expr(VARIANT.format(row=row, text=column))
        changed[name] = t[name].withColumn(column, variant)
    return changed


def _key_spellings(t: Tables) -> DataFrame:
    return (
        spellings.key_spellings(_respelt(t))
        .groupBy("key_name", "stored")
        .agg(F.count(F.lit(1)).alias("spellings"), F.sum("total_rows").alias("total_rows"))
    )


def _states_of_one_spelling(t: Tables) -> DataFrame:
    one = spellings.one_spelling(_respelt(t))
    return kpis.state_revenue(one["orders"], one["customers"], one["order_items"])


def _categories_of_one_spelling(t: Tables) -> DataFrame:
    one = spellings.one_spelling(_respelt(t))
    return kpis.category_revenue(
        one["order_items"], one["orders"], one["products"], one["translation"], one["order_reviews"]
    )


def _loaded(t: Tables) -> DataFrame:
    spark = t["order_payments"].sparkSession
    return tables.load_table(spark, "order_payments", _spoiled_payments(t), fresh_path(spark, "loaded")).counts


def _removed(t: Tables) -> DataFrame:
    """All orders, then some again under another status, then some without their id: read, loaded, and what was left out."""
    orders = t["orders"]
    spark = orders.sparkSession
    again = orders.where(F.col("order_id") % 89 == 0).withColumn("order_status", F.lit("copy"))
    nameless = orders.where(F.col("order_id") % 83 == 0).withColumn("order_id", F.lit(None).cast("bigint"))
    read = tables.read_orders(spark, _as_csv(orders.unionByName(again).unionByName(nameless)))
    removed_dir = fresh_path(spark, "removed")
    tables.materialize_tables({"orders": read}, fresh_path(spark, "typed"), removed_dir)
    return (
        tables.removed_rows(spark, "orders", removed_dir)
        .groupBy("removal_reason")
        .agg(F.count(F.lit(1)).alias("removed_rows"), F.count_if(F.col("order_status") == "copy").alias("later_copies"))
    )


def _cleaned_endings(t: Tables) -> DataFrame:
    crlf = t["sellers"].withColumn("seller_state", F.concat("seller_state", F.lit("\r")))
    return tables.line_ending_cleanup(crlf)


def _materialized(t: Tables) -> DataFrame:
    spark = t["orders"].sparkSession
    return quality.row_count_audit(tables.materialize_tables(t, fresh_path(spark, "typed")))


_RFM_SCHEMA = (
    "customer_unique_id bigint, recency int, frequency bigint, monetary decimal(22,2), "
    "r_score int, f_score int, m_score int, rfm_code string, customer_segment string"
)
_SUMMARY_SCHEMA = (
    "customer_segment string, customer_count bigint, avg_spend decimal(24,2), "
    "total_revenue decimal(32,2), customer_pct decimal(24,2), revenue_pct decimal(24,2)"
)
_GROWTH_SCHEMA = (
    "order_month string, total_orders bigint, monthly_revenue decimal(24,2), "
    "prev_month_revenue decimal(24,2), mom_growth_pct decimal(24,2)"
)


def _reread(spark: SparkSession, path: str, schema: str, null_text: str = "") -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", null_text)
        .csv(path)
    )


def _rfm_file(t: Tables) -> DataFrame:
    scored = _rfm_pandas(t)
    spark = scored.sparkSession
    path = sinks.write_rfm_output(scored, fresh_path(spark, "rfm-output"))
    return _reread(spark, path, _RFM_SCHEMA)


def _summary_file(t: Tables) -> DataFrame:
    summary = rfm.rfm_segment_summary(_rfm_pandas(t))
    spark = summary.sparkSession
    path = sinks.write_segment_summary(summary, fresh_path(spark, "rfm-summary"))
    return _reread(spark, path, _SUMMARY_SCHEMA)


def _exported(t: Tables) -> DataFrame:
    spark = t["orders"].sparkSession
    name = views.publish_views(t, ["vw_monthly_revenue_growth"])[0]
    path = sinks.export_view(spark, name, fresh_path(spark, "export"))
    return _reread(spark, path, _GROWTH_SCHEMA, "NULL")


def _published(t: Tables) -> DataFrame:
    name = "vw_monthly_revenue_growth"
    return views.publish_view(name, views.VIEWS[name](t))


def _listed(t: Tables) -> DataFrame:
    """All published views by name, with the number of rows each returns."""
    spark = t["orders"].sparkSession
    names = views.publish_views(t)
    listed = views.list_views(spark).filter(F.col("viewName").isin(names))
    sizes = reduce(
        DataFrame.unionByName,
        [
            spark.table(n).agg(F.count(F.lit(1)).alias("total_rows")).withColumn("viewName", F.lit(n))
            for n in names
        ],
    )
    return listed.join(sizes, "viewName").select(F.col("viewName").alias("view_name"), "total_rows")


# --- operators that start from another operator's result ---


def _frame(t: Tables) -> DataFrame:
    return hypothesis.review_delay_frame(t["orders"], t["order_reviews"])


def _on_frame(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return _query(lambda t: operator(_frame(t)))


def _paying(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t["orders"], t["customers"], t["order_payments"]


def _rfm_pandas(t: Tables) -> DataFrame:
    return rfm.rfm_pandas(*_paying(t))


def _on_rfm(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return _query(lambda t: operator(_rfm_pandas(t)))


def _on_summary(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_rfm(lambda scored: operator(rfm.rfm_segment_summary(scored)))


def _primary_keys(t: Tables) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            quality.primary_key_check(t[name], spec.primary_key, name)
            for name, spec in TABLES.items()
            if spec.primary_key
        ],
    )


def _foreign_keys(t: Tables) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            quality.foreign_key_check(t[child], t[parent], key, (child, parent))
            for child, parent, key in FOREIGN_KEYS
        ],
    )


def _preview(t: Tables) -> DataFrame:
    shown = ("order_id", "delivery_days", "is_delayed", "order_month")
    return quality.preview(logistics.delivered_enriched(t["orders"]).select(*shown), 5, ["order_id"])


_BUYING = ("orders", "customers")
_PAYING = (*_BUYING, "order_payments")
_LABELS = ("products", "translation")

QUERIES: dict[str, Query] = {
    # sources, sinks, catalog
    **{
        f"read_{name}": _read_back(name, getattr(tables, f"read_{name}"))
        for name in TABLES
    },
    "line_ending_cleanup": _query(_cleaned_endings),
    "materialize_tables": _query(_materialized),
    "rejected_rows": _query(_rejected),
    "load_table": _query(_loaded),
    "removed_rows": _query(_removed),
    "key_spellings": _query(_key_spellings),
    "state_revenue_any_spelling": _query(_states_of_one_spelling),
    "category_revenue_any_spelling": _query(_categories_of_one_spelling),
    "write_rfm_output": _query(_rfm_file),
    "write_segment_summary": _query(_summary_file),
    "export_view": _query(_exported),
    "publish_view": _query(_published),
    "list_views": _query(_listed),
    "preview": _query(_preview),
    # data quality
    "row_count_audit": _query(quality.row_count_audit),
    "table_shapes": _query(quality.table_shapes),
    "schema_info": _on(quality.schema_info, "orders"),
    "null_counts": _query(lambda t: quality.null_counts({n: t[n] for n in _PROFILED})),
    # looked for in the items, whose order ids do repeat
    "duplicate_orders": _on(quality.duplicate_orders, "order_items"),
    "duplicate_order_count": _on(quality.duplicate_order_count, "order_items"),
    "duplicated_keys": _on(quality.duplicated_keys, "orders", "customers", "products", "sellers"),
    "customer_uniqueness_audit": _on(quality.customer_uniqueness_audit, "customers"),
    "order_status_audit": _on(quality.order_status_audit, "orders"),
    "status_value_counts": _on(quality.status_value_counts, "orders"),
    "date_boundaries": _on(quality.date_boundaries, "orders"),
    "primary_key_check": _query(_primary_keys),
    "foreign_key_check": _query(_foreign_keys),
    # the deviation of the spend has few digits to spare behind the point
    "describe_rfm": _query(lambda t: quality.describe_rfm(_rfm_pandas(t)), digits=2),
    "analysis_set_counts": _on(quality.analysis_set_counts, *_PAYING),
    # revenue, payments, categories
    "repeat_customer_rate": _on(kpis.repeat_customer_rate, *_BUYING),
    "business_summary": _on(kpis.business_summary, *_BUYING, "order_items"),
    "payment_breakdown": _on(kpis.payment_breakdown, "order_payments"),
    "state_revenue": _on(kpis.state_revenue, *_BUYING, "order_items"),
    "state_revenue_top10": _on(kpis.state_revenue_top10, *_BUYING, "order_items"),
    "monthly_revenue_growth": _on(kpis.monthly_revenue_growth, "orders", "order_items"),
    "category_revenue": _on(
        kpis.category_revenue, "order_items", "orders", *_LABELS, "order_reviews"
    ),
    "category_revenue_top10": _on(
        kpis.category_revenue_top10, "order_items", "orders", *_LABELS, "order_reviews", k=3
    ),
    "top_categories_all_orders": _on(kpis.top_categories_all_orders, "order_items", *_LABELS, k=4),
    "revenue_growth_multiple": _query(
        lambda t: kpis.revenue_growth_multiple(
            kpis.monthly_revenue_growth(t["orders"], t["order_items"]), *GROWTH_MONTHS
        )
    ),
    # delivery
    "delivery_by_state": _on(logistics.delivery_by_state, *_BUYING),
    "delay_review_impact": _on(logistics.delay_review_impact, "orders", "order_reviews"),
    "delivered_enriched": _on(logistics.delivered_enriched, "orders"),
    "delivery_headline": _on(logistics.delivery_headline, "orders"),
    "monthly_order_counts": _on(logistics.monthly_order_counts, "orders"),
    "order_heatmap": _on(logistics.order_heatmap, "orders"),
    "delivery_time_histogram": _on(logistics.delivery_time_histogram, "orders"),
    "delivery_time_kde": _on(logistics.delivery_time_kde, "orders"),
    "delivery_median": _on(logistics.delivery_median, "orders"),
    "delivered_share": _on(logistics.delivered_share, "orders"),
    "freight_vs_delivery_by_state": _on(
        logistics.freight_vs_delivery_by_state, *_BUYING, "order_items"
    ),
    "delay_vs_review_trend": _query(
        lambda t: logistics.delay_vs_review_trend(
            masters.order_master(t["orders"], t["customers"], t["order_reviews"])
        )
    ),
    # cohorts
    "cohort_retention_counts": _on(
        cohorts.cohort_retention_counts, *_BUYING, lo=COHORTS[0], hi=COHORTS[1]
    ),
    "cohort_retention_pct": _on(
        cohorts.cohort_retention_pct, *_BUYING, lo=COHORTS[0], hi=COHORTS[1]
    ),
    "cohort_retention": _on(cohorts.cohort_retention, *_BUYING, lo=COHORTS[0], hi=COHORTS[1]),
    # customer segments
    "customer_rfm_raw": _on(rfm.customer_rfm_raw, *_PAYING),
    "rfm_scores": _query(lambda t: rfm.rfm_scores(rfm.customer_rfm_raw(*_paying(t)))),
    "rfm_customer_segments": _on(rfm.rfm_customer_segments, *_PAYING),
    "rfm_top100": _on(rfm.rfm_top100, *_PAYING),
    "rfm_segment_summary_sql": _on(rfm.rfm_segment_summary_sql, *_PAYING),
    "rfm_pandas": _query(_rfm_pandas),
    "rfm_segment_summary": _on_rfm(rfm.rfm_segment_summary),
    "segment_value_counts": _on_rfm(rfm.segment_value_counts),
    "segment_chart_feeds": _on_summary(rfm.segment_chart_feeds),
    "top_share": _on_summary(rfm.top_share),
    # sellers
    "seller_sales": _on(sellers.seller_sales, "order_items", "sellers"),
    "seller_pareto": _on(sellers.seller_pareto, "order_items", "sellers", ranks=PARETO_RANKS),
    "top20_sellers": _on(sellers.top20_sellers, "order_items", "sellers", "order_reviews"),
    # master tables
    "order_master": _on(masters.order_master, *_BUYING, "order_reviews"),
    "order_item_details": _on(masters.order_item_details, "order_items", *_LABELS, "sellers"),
    # delay and review scores
    "review_delay_frame": _query(_frame),
    "delay_split_counts": _on_frame(hypothesis.delay_split_counts),
    "delay_severity": _on_frame(hypothesis.delay_severity),
    "review_box_stats": _on_frame(hypothesis.review_box_stats),
    "review_share_by_status": _on_frame(hypothesis.review_share_by_status),
    "delay_score_correlation": _on_frame(hypothesis.delay_score_correlation),
    "cohort_descriptives": _on_frame(hypothesis.cohort_descriptives),
    "welch_t_test": _on_frame(hypothesis.welch_t_test),
    "cohens_d": _on_frame(hypothesis.cohens_d),
    "mean_difference": _on_frame(hypothesis.mean_difference),
    "mann_whitney_u": _on_frame(hypothesis.mann_whitney_u),
    "contingency_table": _on_frame(hypothesis.contingency_table),
    "chi_square_test": _on_frame(hypothesis.chi_square_test),
    "significance_decision": _on_frame(
        lambda frame: hypothesis.significance_decision(hypothesis.welch_t_test(frame))
    ),
    "one_star_risk_ratio": _on_frame(
        lambda frame: hypothesis.one_star_risk_ratio(hypothesis.cohort_descriptives(frame))
    ),
}
