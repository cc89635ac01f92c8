"""The distributed order agrees with plain windows, ties and skew included."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from agoralytics.functions.ranking import (
    exact_quantiles,
    magnitude,
    ntile_ends,
    quantile_ends,
    with_position,
    with_running_total,
    with_tiles,
)
from agoralytics.functions.scalars import quantile_bin, tile_number


@pytest.fixture(scope="module", params=["ties", "one_value", "tiny", "empty"])
def frame(request, spark):
    rows = {"ties": 10_007, "one_value": 3_000, "tiny": 3, "empty": 0}[request.param]
    value = (
        F.lit(5)
        if request.param == "one_value"
        # a third of the rows share one value
        else F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 7919 % 101)
    )
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.range(rows).select(
        F.col("id").cast("string").alias("name"), value.cast("decimal(12,2)").alias("v")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_positions_and_tiles(frame):
    place = Window.orderBy(F.desc("v"), "name")
    expected = frame.withColumn("position", F.row_number().over(place)).withColumn(
        "tile", F.ntile(4).over(place)
    )
    got = with_position(frame, [F.desc("v"), F.asc("name")]).withColumn(
        "tile", tile_number(F.col("position"), F.col("total_rows"), 4)
    )
    columns = ("name", "v", "position", "tile")
    assert as_set(got, *columns) == as_set(expected, *columns)


def test_running_total_gives_ties_the_same_total(frame):
    expected = frame.select(
        "*",
        F.row_number().over(Window.orderBy(F.desc("v"), "name")).alias("position"),
        F.sum("v").over(Window.orderBy(F.desc("v"))).alias("running_total"),
        F.sum("v").over(Window.partitionBy()).alias("grand_total"),
        F.count("v").over(Window.partitionBy()).alias("total_rows"),
    )
    got = with_running_total(frame, "v", "name", "v")
    columns = ("name", "position", "running_total", "grand_total", "total_rows")
    assert as_set(got, *columns) == as_set(expected, *columns)


def test_rows_are_spread_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same = spark.range(8_000).select(F.col("id").alias("name"), F.lit(1).alias("v"))
        ordered = same.orderBy(F.desc("v"), "name").withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in ordered.groupBy("part").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 4_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_total_of_the_small_example(spark):
    df = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", 1)], "name string, v int")
    got = with_running_total(df, "v", "name", "v").orderBy("position")
    assert [tuple(r) for r in got.select("position", "running_total").collect()] == [
        (1, 3),
        (2, 7),
        (3, 7),
        (4, 8),
    ]


def test_exact_quantiles(frame):
    points = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = exact_quantiles(frame, "v", points).first()
    expected = frame.agg(F.percentile("v", list(points))).first()[0]
    if expected is None:
        assert all(v is None for v in got)
    else:
        assert list(got) == pytest.approx(expected)


@pytest.mark.parametrize("kind", ["text", "number"])
def test_tiles_equal_plain_windows(frame, kind):
    name = F.concat(F.lit("customer_number_"), "name") if kind == "text" else F.col("name").cast("bigint")
    named = frame.select(name.alias("name"), "v")
    number = (F.col("v") * 100).cast("bigint")
    got = with_tiles(named, "name", {"up": number, "down": -number}, 4, ntile_ends)
    up, down = Window.orderBy("v", "name"), Window.orderBy(F.desc("v"), "name")
    tiles = named.select("name", F.ntile(4).over(up).alias("up"), F.ntile(4).over(down).alias("down"))
    assert as_set(got, "name", "up", "down") == as_set(tiles, "name", "up", "down")
    got = with_tiles(named, "name", {"bin": number}, 4, quantile_ends)
    bins = quantile_bin(F.row_number().over(up), F.count("v").over(Window.partitionBy()), 4)
    assert as_set(got, "name", "bin") == as_set(named.select("name", bins.alias("bin")), "name", "bin")


def test_magnitudes_never_fall(spark):
    values = [-1e300, -5e9, -3.0, -1.0001, -1.0, -1e-9, 0.0, 1e-300, 0.01, 0.99, 1.0, 1.01, 7.0, 7.01, 1e4, 1e18]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(magnitude(F.col("v"))).collect()]
    assert got == sorted(got) and len(set(got)) > 13
