"""Operators on small hand-made tables where the result is known."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from agoralytics.operators import cohorts, kpis, logistics, masters, quality, rfm, sellers
from agoralytics.schemas import CUSTOMERS, ORDER_ITEMS, ORDER_PAYMENTS, ORDER_REVIEWS, ORDERS
from agoralytics.schemas import PRODUCTS, SELLERS, TRANSLATION


def when(text):
    return dt.datetime.fromisoformat(text) if text else None


def orders_of(spark, *rows):
    """(order, customer, status, bought, delivered, promised)"""
    return spark.createDataFrame(
        [(o, c, s, when(b), None, None, when(d), when(p)) for o, c, s, b, d, p in rows], ORDERS
    )


def customers_of(spark, *rows):
    """(customer id, person, state)"""
    return spark.createDataFrame([(c, p, "00000", "city", s) for c, p, s in rows], CUSTOMERS)


def items_of(spark, *rows):
    """(order, product, seller, price, freight)"""
    return spark.createDataFrame(
        [
            (o, i, p, s, None, Decimal(price) if price else None, Decimal(freight) if freight else None)
            for i, (o, p, s, price, freight) in enumerate(rows, start=1)
        ],
        ORDER_ITEMS,
    )


def payments_of(spark, *rows):
    """(order, type, value)"""
    return spark.createDataFrame(
        [(o, 1, t, 1, Decimal(v)) for o, t, v in rows], ORDER_PAYMENTS
    )


def reviews_of(spark, *rows):
    return spark.createDataFrame(
        [(f"r{i}", o, s, None, None, None, None) for i, (o, s) in enumerate(rows)], ORDER_REVIEWS
    )


def tuples(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def months(spark):
    """Sales in 2016-10, none in 2016-11, a free month, then sales again."""
    orders = orders_of(
        spark,
        ("o1", "c1", "delivered", "2016-10-03 10:00:00", None, None),
        ("o2", "c2", "delivered", "2016-12-23 10:00:00", None, None),
        ("o3", "c3", "canceled", "2016-12-24 10:00:00", None, None),
        ("o4", "c4", "delivered", "2017-01-05 10:00:00", None, None),
        ("o5", "c5", "delivered", "2017-02-05 10:00:00", None, None),
        ("o6", "c6", "delivered", "2017-02-06 10:00:00", None, None),
    )
    items = items_of(
        spark,
        ("o1", "p1", "s1", "100.00", "10.00"),
        ("o1", "p1", "s1", "100.00", "10.00"),
        ("o2", "p1", "s1", "50.00", "5.00"),
        ("o3", "p1", "s1", "999.00", "9.00"),
        ("o4", "p1", "s1", "0.00", "0.00"),
        ("o5", "p2", "s2", "30.00", "3.00"),
    )
    return orders, items


def test_growth_skips_missing_months_and_zero_bases(months):
    got = tuples(kpis.monthly_revenue_growth(*months))
    assert got == [
        ("2016-10", 1, Decimal("220.00"), None, None),
        ("2016-12", 1, Decimal("55.00"), Decimal("220.00"), Decimal("-75.00")),
        ("2017-01", 1, Decimal("0.00"), Decimal("55.00"), Decimal("-100.00")),
        ("2017-02", 1, Decimal("33.00"), Decimal("0.00"), None),
    ]


def test_another_status(months):
    got = tuples(kpis.monthly_revenue_growth(*months, status="canceled"))
    assert got == [("2016-12", 1, Decimal("1008.00"), None, None)]


def test_growth_multiple(spark, months):
    monthly = kpis.monthly_revenue_growth(*months)
    assert tuples(kpis.revenue_growth_multiple(monthly, "2016-10", "2016-12")) == [
        (Decimal("220.00"), Decimal("55.00"), "2016-10", Decimal("220.00"), Decimal("0.25"))
    ]


def test_summary_leaves_out_orders_without_items(spark, months):
    orders, items = months
    customers = customers_of(spark, *((f"c{i}", f"u{(i + 1) // 2}", "SP") for i in range(1, 7)))
    row = kpis.business_summary(orders, customers, items).first()
    assert (row.total_delivered_orders, row.total_unique_buyers, row.active_sellers) == (4, 3, 2)
    assert row.total_item_gmv == Decimal("280.00") and row.total_gross_revenue == Decimal("308.00")
    assert row.avg_order_value == Decimal("70.00") and row.avg_items_per_order == Decimal("1.25")


def test_summary_counts_an_order_once_where_its_customer_repeats(spark):
    orders = orders_of(spark, ("o1", "c1", "delivered", "2017-01-01 00:00:00", None, None))
    customers = customers_of(spark, ("c1", "u1", "SP"), ("c1", "u2", "SP"))
    items = items_of(spark, ("o1", "p1", "s1", "10.00", "2.00"), ("o2", "p1", "s2", "10.00", "2.00"))
    row = kpis.business_summary(orders, customers, items).first()
    assert (row.total_delivered_orders, row.total_unique_buyers, row.active_sellers) == (1, 2, 1)
    assert row.total_item_gmv == Decimal("20.00")
    nothing = kpis.business_summary(orders.limit(0), customers, items).first()
    assert (nothing.total_delivered_orders, nothing.total_unique_buyers, nothing.active_sellers) == (0, 0, 0)


def test_missing_freight_is_left_out_of_sums_and_means(spark):
    orders = orders_of(spark, ("o1", "c1", "delivered", "2017-01-01 00:00:00", None, None))
    customers = customers_of(spark, ("c1", "u1", "SP"))
    items = items_of(spark, ("o1", "p1", "s1", "10.00", "2.00"), ("o1", "p2", "s1", "10.00", None))
    row = kpis.state_revenue(orders, customers, items).first()
    # price + freight is unknown for the second item
    assert row.total_revenue == Decimal("12.00")
    assert row.avg_freight_paid == Decimal("2.00")


def test_repeat_rate_counts_orders_not_rows(spark):
    orders = orders_of(
        spark,
        ("o1", "c1", "delivered", "2017-01-01 00:00:00", None, None),
        ("o2", "c2", "delivered", "2017-01-02 00:00:00", None, None),
        ("o3", "c3", "delivered", "2017-01-03 00:00:00", None, None),
        ("o4", "c4", "shipped", "2017-01-04 00:00:00", None, None),
    )
    customers = customers_of(
        spark, ("c1", "u1", "SP"), ("c2", "u1", "SP"), ("c3", "u2", "SP"), ("c4", "u2", "SP")
    )
    assert tuples(kpis.repeat_customer_rate(orders, customers)) == [(2, 1, Decimal("50.00"))]


def test_category_labels_and_item_weighted_rating(spark):
    orders = orders_of(
        spark,
        ("o1", "c1", "delivered", "2017-01-01 00:00:00", None, None),
        ("o2", "c2", "delivered", "2017-01-01 00:00:00", None, None),
        ("o3", "c3", "shipped", "2017-01-01 00:00:00", None, None),
    )
    items = items_of(
        spark,
        ("o1", "p1", "s1", "10.00", "1.00"),
        ("o1", "p1", "s1", "20.00", "1.00"),
        ("o2", "p1", "s1", "30.00", "1.00"),
        ("o2", "p2", "s1", "5.00", "1.00"),
        ("o2", "p3", "s1", "6.00", "1.00"),
        ("o3", "p1", "s1", "7.00", "1.00"),
    )
    products = spark.createDataFrame(
        [(p, c, *[None] * 7) for p, c in (("p1", "beleza"), ("p2", "fora"), ("p3", None))], PRODUCTS
    )
    translation = spark.createDataFrame([("beleza", "beauty")], TRANSLATION)
    # o1 has a mean of 4.5 and two items, o2 a mean of 1 and one beauty item
    reviews = reviews_of(spark, ("o1", 4), ("o1", 5), ("o2", 1))
    got = tuples(kpis.category_revenue(items, orders, products, translation, reviews))
    assert got == [
        ("beauty", 2, 3, Decimal("60.00"), Decimal("20.00"), Decimal("3.33")),
        ("Unknown", 1, 1, Decimal("6.00"), Decimal("6.00"), Decimal("1.00")),
        ("fora", 1, 1, Decimal("5.00"), Decimal("5.00"), Decimal("1.00")),
    ]
    # every order counts here, products without a label do not
    top = tuples(kpis.top_categories_all_orders(items, products, translation))
    assert top == [("beauty", Decimal("67.00")), ("fora", Decimal("5.00"))]
    sold_by = spark.createDataFrame([("s1", "0", "city", "SP")], SELLERS)
    details = masters.order_item_details(items, products, translation, sold_by)
    assert {r.category_english for r in details.collect()} == {"beauty", "fora", "Other"}
    assert details.count() == 6


@pytest.fixture(scope="module")
def deliveries(spark):
    return orders_of(
        spark,
        ("o1", "c1", "delivered", "2017-01-01 23:59:00", "2017-01-02 00:01:00", "2017-01-10 00:00:00"),
        ("o2", "c2", "delivered", "2017-01-01 10:00:00", "2017-01-11 00:00:01", "2017-01-11 00:00:00"),
        ("o3", "c3", "delivered", "2017-01-01 10:00:00", None, "2017-01-11 00:00:00"),
        ("o4", "c4", "shipped", "2017-01-01 10:00:00", "2017-03-11 00:00:01", "2017-01-11 00:00:00"),
    )


def test_delivery_measures(spark, deliveries):
    customers = customers_of(spark, *((f"c{i}", f"u{i}", "SP") for i in range(1, 5)))
    assert tuples(logistics.delivery_by_state(deliveries, customers)) == [
        ("SP", 2, Decimal("5.5"), Decimal("9.5"), 1, Decimal("50.00"))
    ]
    # elapsed days 0 and 9; the order without a date counts as punctual
    assert tuples(logistics.delivery_headline(deliveries)) == [
        (3, Decimal("33.33"), Decimal("4.5"))
    ]
    assert tuples(logistics.delivery_median(deliveries)) == [(4.5, 2)]
    assert tuples(logistics.delivered_share(deliveries)) == [(4, 3, Decimal("75.00"))]


def test_master_has_every_order_once(spark, deliveries):
    customers = customers_of(spark, *((f"c{i}", f"u{i}", "SP") for i in range(1, 5)))
    reviews = reviews_of(spark, ("o1", 4), ("o1", 5), ("o1", 5), ("o4", 1))
    rows = {r.order_id: r for r in masters.order_master(deliveries, customers, reviews).collect()}
    assert len(rows) == 4
    assert rows["o1"].review_score == Decimal("4.6667") and rows["o1"].delivery_days == 1
    assert rows["o2"].review_score is None and rows["o2"].is_delivery_delayed == 1
    assert rows["o3"].delivery_days is None and rows["o3"].is_delivery_delayed == 0


def test_heatmap_is_monday_first_and_leaves_gaps(spark, deliveries):
    rows = logistics.order_heatmap(deliveries).collect()
    assert [r.dow for r in rows][0] == "Monday" and rows[6].dow == "Sunday"
    assert rows[6].h10 == 3 and rows[6].h23 == 1 and rows[6].h00 is None and rows[0].h10 is None


def test_histogram_keeps_empty_bins_and_closes_the_last(spark):
    days = (0, 0, 1, 10)
    orders = orders_of(
        spark,
        *(
            (f"o{i}", f"c{i}", "delivered", "2017-01-01 00:00:00", f"2017-01-{d + 1:02d} 00:00:00", None)
            for i, d in enumerate(days)
        ),
    )
    rows = logistics.delivery_time_histogram(orders, bins=5).collect()
    assert [(r.bin_start, r.bin_end, r.order_count) for r in rows] == [
        (0.0, 2.0, 3),
        (2.0, 4.0, 0),
        (4.0, 6.0, 0),
        (6.0, 8.0, 0),
        (8.0, 10.0, 1),
    ]
    assert rows[0].mean_days == 2.75
    density = logistics.delivery_time_kde(orders, gridsize=50).collect()
    assert len(density) == 50 and density[0].days == 0.0 and density[-1].days == pytest.approx(10.0)
    same = logistics.delivery_time_histogram(orders.filter("order_id = 'o3'"), bins=2).collect()
    assert [(r.bin_start, r.bin_end, r.order_count) for r in same] == [(9.5, 10.0, 0), (10.0, 10.5, 1)]
    assert logistics.delivery_time_histogram(orders.filter("order_id = 'none'"), bins=2).count() == 0
    # a density needs spread
    for alike in ("order_id = 'o3'", "order_id IN ('o0', 'o1')", "order_id = 'none'"):
        curve = logistics.delivery_time_kde(orders.filter(alike), gridsize=3).collect()
        assert {r.density for r in curve} <= {None}


def test_density_matches_the_formula(spark):
    import math
    import statistics

    days = [1, 1, 2, 5, 9, 9, 9]
    orders = orders_of(
        spark,
        *(
            (f"o{i}", f"c{i}", "delivered", "2017-01-01 00:00:00", f"2017-01-{d + 1:02d} 00:00:00", None)
            for i, d in enumerate(days)
        ),
    )
    h = statistics.stdev(days) * len(days) ** -0.2
    for row in logistics.delivery_time_kde(orders, gridsize=9).collect():
        expected = sum(math.exp(-(((row.days - d) / h) ** 2) / 2) for d in days)
        assert row.density == pytest.approx(expected / (len(days) * h * math.sqrt(2 * math.pi)))


def test_cohorts(spark):
    orders = orders_of(
        spark,
        ("o1", "c1", "delivered", "2017-01-31 00:00:00", None, None),
        ("o2", "c2", "delivered", "2017-02-01 00:00:00", None, None),
        ("o3", "c3", "delivered", "2017-02-03 00:00:00", None, None),
        ("o4", "c4", "delivered", "2018-01-01 00:00:00", None, None),
        ("o5", "c5", "delivered", "2017-01-10 00:00:00", None, None),
        ("o6", "c6", "delivered", "2016-12-10 00:00:00", None, None),
        ("o7", "c7", "delivered", "2017-01-10 00:00:00", None, None),
        ("o8", "c8", "shipped", "2017-04-10 00:00:00", None, None),
        ("o9", "c9", "delivered", "2018-01-15 00:00:00", None, None),
        ("o10", "c10", "delivered", "2018-02-15 00:00:00", None, None),
    )
    customers = customers_of(
        spark,
        *((f"c{i}", "a", "SP") for i in (1, 2, 3, 4)),  # 2017-01, twice 02, 2018-01
        ("c5", "b", "SP"),
        ("c6", "d", "SP"),  # first purchase before the window
        ("c7", "d", "SP"),
        ("c8", "b", "SP"),  # not delivered
        ("c9", "e", "SP"),
        ("c10", "e", "SP"),
    )
    assert tuples(cohorts.cohort_retention_counts(orders, customers)) == [
        ("2017-01", 2, 1, 0, 0, 0, 1),
        ("2018-01", 1, 1, 0, 0, 0, 0),
    ]
    pct = cohorts.cohort_retention_pct(orders, customers).first()
    assert pct.cohort_size == 2 and pct.retention_month_1_pct == Decimal("50.00")


def test_cohorts_over_more_months_than_one_bit_set(spark):
    bought = ["2000-01-05 00:00:00", "2005-04-05 00:00:00", "2005-05-05 00:00:00", "2010-08-05 00:00:00"]
    orders = orders_of(
        spark, *((f"o{i}", f"c{i}", "delivered", b, None, None) for i, b in enumerate(bought))
    )
    customers = customers_of(spark, *((f"c{i}", "a", "SP") for i in range(4)))
    got = cohorts.cohort_retention_counts(
        orders, customers, "1999-12", "2009-12", offsets=(0, 63, 64, 65, 127, 128)
    )
    # 2000-01 plus 63, 64 and 127 months
    assert tuples(got) == [("2000-01", 1, 1, 1, 0, 1, 0)]


def test_segment_tables(spark):
    scores = spark.createDataFrame(
        [(r, f, m) for r in range(1, 5) for f in (1, 4) for m in range(1, 5)],
        "r_score int, f_score int, m_score int",
    )
    rows = scores.select("*", rfm.segment(True).alias("seven"), rfm.segment(False).alias("six")).collect()
    label = {(r.r_score, r.f_score, r.m_score): (r.seven, r.six) for r in rows}
    assert len(label) == 32
    assert label[4, 4, 3] == ("Champions",) * 2
    assert label[3, 4, 2] == ("Loyal Customers",) * 2
    assert label[2, 4, 4] == ("Needs Attention (Repeat)", "Standard One-Time Buyers")
    assert label[1, 4, 1] == ("Cant Lose Them (At Risk)",) * 2
    assert label[3, 1, 3] == ("Promising High-Spenders",) * 2
    assert label[1, 1, 1] == ("Lost / Churned",) * 2
    assert label[2, 1, 1] == ("Standard One-Time Buyers",) * 2
    assert sum(a != b for a, b in label.values()) == 4


def test_both_rfm_models(spark):
    orders = orders_of(
        spark,
        ("o1", "c1", "delivered", "2017-01-01 12:00:00", None, None),
        ("o2", "c2", "delivered", "2017-01-05 06:00:00", None, None),
        ("o3", "c3", "delivered", "2017-01-10 12:00:00", None, None),
        ("o4", "c4", "canceled", "2017-01-20 12:00:00", None, None),
        ("o5", "c5", "delivered", "2017-01-15 12:00:00", None, None),  # never paid
    )
    customers = customers_of(
        spark, ("c1", "a", "SP"), ("c2", "a", "SP"), ("c3", "b", "SP"), ("c4", "b", "SP"), ("c5", "z", "SP")
    )
    payments = payments_of(
        spark, ("o1", "boleto", "10.00"), ("o1", "voucher", "5.00"), ("o2", "boleto", "1.00"), ("o3", "boleto", "2.00")
    )
    raw = {r[0]: tuple(r)[1:] for r in rfm.customer_rfm_raw(orders, customers, payments).collect()}
    assert raw == {"a": (15, 2, Decimal("16.00")), "b": (10, 1, Decimal("2.00"))}
    note = {r[0]: tuple(r)[1:4] for r in rfm.rfm_pandas(orders, customers, payments).collect()}
    # against the last paid delivery, in elapsed days
    assert note == {"a": (5, 2, Decimal("16.00")), "b": (0, 1, Decimal("2.00"))}


def test_segment_summary_reproduces_published_shares(spark):
    """Reference figures: seven segments with their customers and revenue."""
    published = [
        ("Standard One-Time Buyers", 62114, "135.65", "8425603.48", "66.53", "54.63"),
        ("Promising High-Spenders", 22475, "261.26", "5871818.72", "24.07", "38.07"),
        ("Champions", 1373, "343.67", "471859.89", "1.47", "3.06"),
        ("Lost / Churned", 5967, "43.69", "260682.36", "6.39", "1.69"),
        ("Needs Attention (Repeat)", 676, "309.10", "208954.20", "0.72", "1.35"),
        ("Cant Lose Them (At Risk)", 582, "291.37", "169578.30", "0.62", "1.10"),
        ("Loyal Customers", 170, "82.15", "13964.82", "0.18", "0.09"),
    ]
    # as many customers as published; the first of each segment carries its revenue
    size = F.element_at(
        F.create_map(*(F.lit(v) for s, n, *_ in published for v in (s, n))), F.col("customer_segment")
    )
    total = F.element_at(
        F.create_map(*(F.lit(v) for s, _, _, t, *_ in published for v in (s, t))), F.col("customer_segment")
    ).cast("decimal(12,2)")
    names = spark.createDataFrame([(s,) for s, *_ in published], "customer_segment string")
    people = names.select("customer_segment", F.explode(F.sequence(F.lit(1), size)).alias("i")).select(
        "customer_segment",
        F.concat_ws("-", "customer_segment", "i").alias("customer_unique_id"),
        F.when(F.col("i") == 1, total).otherwise(Decimal("0.00")).cast("decimal(12,2)").alias("monetary"),
    )
    summary = rfm.rfm_segment_summary(people)
    expected = [(s, n, *map(Decimal, rest)) for s, n, *rest in published]
    assert tuples(summary) == expected
    assert tuples(rfm.top_share(summary)) == [(Decimal("25.5"), Decimal("41.1"))]
    feeds = rfm.segment_chart_feeds(summary).orderBy("chart", "place").collect()
    assert [r.customer_segment for r in feeds if r.chart == "customers"][:3] == [
        "Standard One-Time Buyers",
        "Promising High-Spenders",
        "Lost / Churned",
    ]


def test_payment_breakdown(spark):
    payments = payments_of(
        spark, ("o1", "credit_card", "75.00"), ("o2", "credit_card", "25.00"), ("o3", "boleto", "50.00")
    )
    assert tuples(kpis.payment_breakdown(payments)) == [
        ("credit_card", 2, Decimal("66.67"), Decimal("100.00"), Decimal("66.67"), Decimal("1.0"), Decimal("50.00")),
        ("boleto", 1, Decimal("33.33"), Decimal("50.00"), Decimal("33.33"), Decimal("1.0"), Decimal("50.00")),
    ]


def test_sellers(spark):
    items = items_of(
        spark,
        ("o1", "p", "s1", "3.00", "1.00"),
        ("o1", "p", "s2", "2.00", "1.00"),
        ("o2", "p", "s3", "2.00", "1.00"),
        ("o3", "p", "s4", "1.00", "1.00"),
        ("o3", "p", "gone", "100.00", "1.00"),
    )
    known = spark.createDataFrame([(f"s{i}", "0", "city", "SP") for i in range(1, 5)], SELLERS)
    reviews = reviews_of(spark, ("o1", 5), ("o1", 4))
    pareto = sellers.seller_pareto(items, known, ranks=(1, 2, 3, 4), milestones=())
    assert [(r.seller_id, r.seller_rank, r.cumulative_revenue_pct) for r in pareto.collect()] == [
        ("s1", 1, Decimal("37.50")),
        ("s2", 2, Decimal("87.50")),
        ("s3", 3, Decimal("87.50")),
        ("s4", 4, Decimal("100.00")),
    ]
    crossing = sellers.seller_pareto(items, known, ranks=(), milestones=(88,))
    assert [r.seller_id for r in crossing.collect()] == ["s2", "s3"]
    top = sellers.top20_sellers(items, known, reviews, k=2).collect()
    assert [(r.seller_id, r.avg_review_score, r.gmv_share_pct) for r in top] == [
        ("s1", Decimal("4.50"), Decimal("37.50")),
        ("s2", Decimal("4.50"), Decimal("25.00")),
    ]


def test_key_checks(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 1), ("a", 1), ("b", 1), ("b", None), (None, 1)], "k string, n int"
    )
    assert tuples(quality.primary_key_check(df, ["k", "n"], "t")) == [("t", "k,n", 6, 2, 1, 2)]
    parents = spark.createDataFrame([("a",)], "k string")
    assert tuples(quality.foreign_key_check(df, parents, "k")) == [("child", "parent", "k", 1, 2)]
    dup = quality.duplicated_keys(*(df.withColumnRenamed("k", c) for c in ("order_id", "customer_id", "product_id", "seller_id")))
    assert {r.duplicated_rows for r in dup.collect()} == {3}


def test_null_profile(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("c", 1)], "k string, n int")
    assert tuples(quality.null_counts({"t": df}).orderBy("column_name")) == [
        ("t", "k", 1, Decimal("33.33")),
        ("t", "n", 2, Decimal("66.67")),
    ]
    assert tuples(quality.schema_info(df).orderBy("column_no")) == [
        (1, "k", "string", 2),
        (2, "n", "int", 1),
    ]
    assert tuples(quality.table_shapes({"t": df})) == [("t", 3, 2)]


def test_status_audit_on_an_empty_table(spark):
    empty = spark.createDataFrame([], ORDERS)
    assert quality.order_status_audit(empty).count() == 0
    assert tuples(quality.date_boundaries(empty)) == [(None, None, None)]
    assert tuples(logistics.delivered_share(empty)) == [(0, 0, None)]
