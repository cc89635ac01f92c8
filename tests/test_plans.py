"""Physical plans: what is read, joined and moved."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from agoralytics.plans.views import VIEWS
from agoralytics.schemas import TABLES, TRANSLATION
from checks.queries import QUERIES


def plan_of(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def plan(spark, small_folder):
    known = {}

    def of(key):
        if key not in known:
            known[key] = plan_of(QUERIES[key](spark, small_folder))
        return known[key]

    return of


def test_status_filter_and_columns_reach_the_scan(plan):
    text = plan("monthly_revenue_growth")
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>", text)
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_tax:double>", text)


def test_status_filter_is_pushed_down(spark, tmp_path):
    from agoralytics.operators.common import with_status
    from agoralytics.schemas import ORDERS

    spark.createDataFrame([], ORDERS).write.parquet(str(tmp_path / "orders"))
    text = plan_of(with_status(spark.read.parquet(str(tmp_path / "orders"))).select("order_id"))
    assert "EqualTo(order_status,delivered)" in text
    assert "ReadSchema: struct<order_id:string,order_status:string>" in text


@pytest.mark.parametrize("key", sorted(set(QUERIES) - {"list_views"}))
def test_no_cross_join_and_no_python_over_rows(plan, key):
    text = plan(key)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if key not in {"welch_t_test", "significance_decision", "mann_whitney_u", "chi_square_test"}:
        assert "ArrowEvalPython" not in text


@pytest.mark.parametrize(
    "key", ["rfm_scores", "rfm_pandas", "customer_rfm_raw", "order_master", "top20_sellers"]
)
def test_no_window_gathers_the_rows_of_a_large_table(plan, key):
    """Windows without partitioning see one row per sort partition, never the customers."""
    for window in re.findall(r"\(\d+\) Window.*?\n\n", plan(key), flags=re.S):
        assert "_part" in window


def test_hot_keys_are_summed_before_the_join(plan):
    text = plan("monthly_revenue_growth")
    assert re.search(r"HashAggregate.*?partial_sum", text, flags=re.S)


@pytest.fixture
def small_partitions(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_product_or_seller_is_split(spark, small_partitions):
    from agoralytics.operators.masters import order_item_details

    rows = spark.range(60_000).repartition(8)
    hot = F.col("id") % 3 == 0
    items = rows.select(
        F.col("id").alias("order_id"),
        F.lit(1).alias("order_item_id"),
        F.when(hot, 0).otherwise(F.col("id") % 5000).alias("product_id"),
        F.when(hot, 0).otherwise(F.col("id") % 700).alias("seller_id"),
        (F.xxhash64("id") % 10_000 / 100).cast("decimal(10,2)").alias("price"),
        F.lit(1).cast("decimal(10,2)").alias("freight_value"),
    )
    products = spark.range(5000).select(F.col("id").alias("product_id"), F.lit("a").alias("product_category_name"))
    translation = spark.createDataFrame([("a", "b")], TRANSLATION)
    known = spark.range(700).select(F.col("id").alias("seller_id"), F.lit("SP").alias("seller_state"), F.lit("c").alias("seller_city"))
    df = order_item_details(items, products, translation, known)
    assert len(re.findall(r"SortMergeJoin\(skew=true\)", final_plan(df).split("Initial Plan")[0])) == 2


def test_a_hot_reviewed_order_is_split(spark, small_partitions):
    from agoralytics.operators.hypothesis import review_delay_frame, score_counts

    orders = spark.range(30_000).select(
        F.col("id").alias("order_id"),
        F.lit("delivered").alias("order_status"),
        *(
            F.lit(f"2017-01-0{day} 00:00:00").cast("timestamp_ntz").alias(name)
            for day, name in enumerate(
                ("order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"), 1
            )
        ),
    )
    rows = spark.range(90_000).repartition(8)
    reviews = rows.select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 30_000).alias("order_id"),
        # varied values keep the hot partition from compressing away
        (F.xxhash64("id") % 1_000_000).cast("int").alias("review_score"),
    )
    df = score_counts(review_delay_frame(orders, reviews))
    assert "SortMergeJoin(skew=true)" in final_plan(df)
    assert sum(r.n for r in df.collect()) == 90_000


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    """The nine tables with their declared types and no rows, as Parquet."""
    folder = tmp_path_factory.mktemp("declared")
    tables = {}
    for name, spec in TABLES.items():
        spark.createDataFrame([], spec.schema).write.parquet(f"{folder}/{name}")
        tables[name] = spark.read.schema(spec.schema).parquet(f"{folder}/{name}")
    return tables


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_views_aggregate_by_hash_and_accept_empty_tables(empty_tables, name):
    df = VIEWS[name](empty_tables)
    text = plan_of(df)
    assert "SortAggregate" not in text
    assert "ObjectHashAggregate" not in text
    assert df.count() <= len(TABLES)
