"""Edge rules of the column expressions."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from agoralytics.functions import scalars as s
from agoralytics.operators.hypothesis import DELAY_EDGES, DELAY_LABELS


def one(spark, *columns, **values):
    """Evaluate expressions on a one-row frame of SQL literals."""
    row = spark.sql("SELECT " + ", ".join(f"{v} AS {k}" for k, v in values.items()) if values else "SELECT 1 AS x")
    return tuple(row.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def ts(text):
    return f"TIMESTAMP_NTZ'{text}'"


@pytest.mark.parametrize(
    ("later", "earlier", "calendar", "elapsed"),
    [
        ("2017-01-02 00:01:00", "2017-01-01 23:59:00", 1, 0),
        ("2017-01-01 23:59:00", "2017-01-02 00:01:00", -1, -1),
        ("2017-01-02 12:00:00", "2017-01-01 12:00:00", 1, 1),
        ("2017-01-02 11:59:59.999999", "2017-01-01 12:00:00", 1, 0),
        ("2017-01-01 12:00:00", "2017-01-01 12:00:00", 0, 0),
        ("2017-01-01 00:00:00", "2017-01-03 00:00:00", -2, -2),
    ],
)
def test_day_differences(spark, later, earlier, calendar, elapsed):
    a, b = F.col("a"), F.col("b")
    got = one(spark, s.calendar_days(a, b), s.elapsed_days(a, b), a=ts(later), b=ts(earlier))
    assert got == (calendar, elapsed)


@pytest.mark.parametrize(
    ("earlier", "later", "months"),
    [
        ("2017-01-31 00:00:00", "2017-02-28 00:00:00", 0),
        ("2017-01-15 10:00:00", "2017-02-15 09:59:59", 0),
        ("2017-01-15 10:00:00", "2017-02-15 10:00:00", 1),
        ("2016-09-04 21:15:19", "2018-10-17 17:30:18", 25),
        ("2017-02-15 10:00:00", "2017-01-15 10:00:00", -1),
        ("2017-02-15 10:00:00", "2017-01-15 10:00:01", 0),
    ],
)
def test_complete_months(spark, earlier, later, months):
    a, b = F.col("a"), F.col("b")
    assert one(spark, s.complete_months(a, b), a=ts(earlier), b=ts(later)) == (months,)


def test_month_keys_round_trip(spark):
    month = F.col("a")
    got = one(
        spark,
        s.month_key(month),
        s.month_key_of(s.month_number(month)),
        s.weekday_name(month),
        a=ts("2016-12-31 23:59:59"),
    )
    assert got == ("2016-12", "2016-12", "Saturday")
    assert s.parse_month("2017-01") - s.parse_month("2016-12") == 1


def test_session_time_zone_does_not_matter(spark):
    # 2018-11-04 00:30 does not exist in Sao Paulo: the clock skipped that hour
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        a, b = F.col("a"), F.col("b")
        got = one(
            spark,
            s.elapsed_days(a, b),
            F.hour(a),
            s.month_key(a),
            a=ts("2018-11-04 00:30:00"),
            b=ts("2018-11-03 00:30:00"),
        )
        assert got == (1, 0, "2018-11")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_ratios(spark):
    a, b, zero = F.col("a"), F.col("b"), F.col("z")
    got = one(
        spark,
        s.percent(a, b),
        s.percent(a, zero),
        s.mean(a, b, digits=1),
        s.ratio(F.lit(Decimal("0.125")), F.lit(1), (s.SCORE, s.COUNT)),
        s.ratio(F.lit(Decimal("0.125")), F.lit(1), (s.SCORE, s.COUNT), rounding=F.bround),
        s.ratio(F.lit(Decimal("-0.125")), F.lit(1), (s.SCORE, s.COUNT)),
        a="1",
        b="3",
        z="0",
    )
    assert got == (
        Decimal("33.33"),
        None,
        Decimal("0.3"),
        Decimal("0.13"),
        Decimal("0.12"),
        Decimal("-0.13"),
    )


def test_published_growth_and_shares_follow_from_their_inputs(spark):
    """Reference figures: growth from two months, shares and tickets from totals."""
    m = lambda v: F.lit(Decimal(v))
    got = one(
        spark,
        s.percent(m("46490.66") - m("143.46"), m("143.46"), s.MONEY),
        s.percent(m("19.62") - m("46490.66"), m("46490.66"), s.MONEY),
        s.percent(F.lit(76795), F.lit(103886)),
        s.percent(m("12542084.19"), m("16008872.12"), s.MONEY),
        s.mean(m("12542084.19"), F.lit(76795), s.MONEY),
        s.percent(F.lit(95), F.lit(397)),
        s.percent(F.lit(62114), F.lit(93357), rounding=F.bround),
        s.mean(m("8425603.48"), F.lit(62114), s.MONEY, rounding=F.bround),
    )
    assert got == tuple(
        map(
            Decimal,
            ("32306.71", "-99.96", "73.92", "78.34", "163.32", "23.93", "66.53", "135.65"),
        )
    )


def test_cents_are_exact_and_typed(spark):
    df = spark.sql("SELECT CAST('99999999.99' AS DECIMAL(10,2)) AS p, 1.5D AS q")
    assert df.select(s.cents("p"), s.money(s.cents("p"))).first() == (
        9999999999,
        Decimal("99999999.99"),
    )
    s.require_money(df, "p")
    with pytest.raises(TypeError, match="q is double"):
        s.require_money(df, "q")


def test_delay_bins(spark):
    days = spark.createDataFrame([(d,) for d in (-1, 0, 1, 3, 4, 7, 30, 31, 100, 101)], "d int")
    got = [r[0] for r in days.select(s.cut(F.col("d"), DELAY_EDGES, DELAY_LABELS)).collect()]
    assert got == [
        None,
        None,
        "1-3 Days",
        "1-3 Days",
        "4-7 Days",
        "4-7 Days",
        "15-30 Days",
        "30+ Days",
        "30+ Days",
        None,
    ]


def test_unknown_conditions_are_skipped_not_counted(spark):
    df = spark.sql("SELECT CAST(NULL AS INT) AS a UNION ALL SELECT CAST(NULL AS INT)")
    assert df.agg(F.sum(s.flag(F.col("a") > 1))).first()[0] is None


def test_seven_values_in_four_classes(spark):
    places = spark.range(1, 8).withColumn("n", F.lit(7).cast("bigint"))
    got = places.orderBy("id").select(
        s.tile_number(F.col("id"), F.col("n"), 4), s.quantile_bin(F.col("id"), F.col("n"), 4)
    )
    tiles, bins = zip(*got.collect())
    assert tiles == (1, 1, 2, 2, 3, 3, 4)
    assert bins == (1, 1, 2, 2, 3, 4, 4)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 9, 13, 58])
def test_quantile_bins_match_pandas(spark, n):
    pd = pytest.importorskip("pandas")
    places = spark.range(1, n + 1).withColumn("n", F.lit(n).cast("bigint"))
    got = [r[0] for r in places.orderBy("id").select(s.quantile_bin(F.col("id"), F.col("n"), 4)).collect()]
    if n < 4:
        assert got[0] == 1 and (n == 1 or got[-1] == 4)
        return
    expected = pd.qcut(pd.Series(range(1, n + 1)), 4, labels=[1, 2, 3, 4]).astype(int).tolist()
    assert got == expected
