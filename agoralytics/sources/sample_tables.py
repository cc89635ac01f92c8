"""The nine marketplace tables derived from an order/lineitem star schema.

Each table is a list of SQL select expressions over raw Parquet tables. The
expressions use only syntax common to Spark and other SQL engines, so a check
can state its expectation over the same inputs.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DerivedTable:
    base: str
    # (table, base column, its column): inner equality joins
    joins: tuple[tuple[str, str, str], ...]
    columns: tuple[tuple[str, str], ...]
    distinct: bool = False



def _two_places(column: str, precision: int) -> str:
    # through whole hundredths: engines convert doubles to decimals slowly
    hundredths = f"CAST(FLOOR({column} * 100 + 0.5) AS BIGINT)"
    return f"CAST(CAST({hundredths} AS DECIMAL({precision},0)) * 0.01 AS DECIMAL({precision},2))"


_PRICE = _two_places("l_extendedprice", 12)
_FREIGHT = f"CAST(ROUND({_PRICE} * {_two_places('l_tax', 4)}, 2) AS DECIMAL(12,2))"


def _zip(key: str) -> str:
    return f"LPAD(CAST({key} % 100000 AS STRING), 5, '0')"


def _days(count: str) -> str:
    return f"INTERVAL '1' DAY * CAST({count} AS INT)"


def _hours(count: str) -> str:
    return f"INTERVAL '1' HOUR * CAST({count} AS INT)"


_LATE_DAYS = (
    "CASE WHEN o_orderkey % 5 = 0 THEN 1 + (o_orderkey * 37) % 150 "
    "ELSE 1 + (o_orderkey * 7) % 24 END"
)

DERIVED: dict[str, DerivedTable] = {
    "customers": DerivedTable(
        "orders",
        (("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey")),
        (
            ("customer_id", "o_orderkey"),
            ("customer_unique_id", "o_custkey"),
            ("customer_zip_code_prefix", _zip("o_custkey")),
            ("customer_city", "c_mktsegment"),
            ("customer_state", "n_name"),
        ),
    ),
    "orders": DerivedTable(
        "orders",
        (),
        (
            ("order_id", "o_orderkey"),
            ("customer_id", "o_orderkey"),
            (
                "order_status",
                "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' "
                "ELSE 'processing' END",
            ),
            ("order_purchase_timestamp", f"o_orderdate + {_hours('o_orderkey % 24')}"),
            (
                "order_approved_at",
                "CASE WHEN o_orderkey % 61 = 0 THEN NULL "
                f"ELSE o_orderdate + {_hours('o_orderkey % 24 + 1')} END",
            ),
            (
                "order_delivered_carrier_date",
                "CASE WHEN o_orderkey % 53 = 0 THEN NULL "
                f"ELSE o_orderdate + {_days('1 + o_orderkey % 3')} END",
            ),
            (
                "order_delivered_customer_date",
                "CASE WHEN o_orderkey % 50 = 0 THEN NULL "
                f"ELSE o_orderdate + {_days(_LATE_DAYS)} + {_hours('(o_orderkey * 5) % 24')} END",
            ),
            ("order_estimated_delivery_date", f"o_orderdate + {_days('24')}"),
        ),
    ),
    "order_items": DerivedTable(
        "lineitem",
        (),
        (
            ("order_id", "l_orderkey"),
            ("order_item_id", "l_linenumber"),
            ("product_id", "l_partkey"),
            ("seller_id", "l_suppkey"),
            ("shipping_limit_date", "l_shipdate"),
            ("price", _PRICE),
            ("freight_value", _FREIGHT),
        ),
    ),
    "order_payments": DerivedTable(
        "lineitem",
        (),
        (
            ("order_id", "l_orderkey"),
            ("payment_sequential", "l_linenumber"),
            (
                "payment_type",
                "CASE l_returnflag WHEN 'A' THEN 'credit_card' WHEN 'N' THEN 'boleto' "
                "ELSE 'voucher' END",
            ),
            ("payment_installments", "CAST(l_quantity AS INT)"),
            ("payment_value", f"CAST({_PRICE} + {_FREIGHT} AS DECIMAL(12,2))"),
        ),
    ),
    "order_reviews": DerivedTable(
        "events",
        (),
        (
            ("review_id", "event_id"),
            ("order_id", "event_id - event_id % 2"),
            ("review_score", "1 + CAST(FLOOR(value) AS INT) % 5"),
            ("review_comment_title", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END"),
            ("review_comment_message", "event_type || ', ' || CHR(10) || props"),
            ("review_creation_date", "ts"),
            ("review_answer_timestamp", f"ts + {_days('event_id % 4')}"),
        ),
    ),
    "products": DerivedTable(
        "part",
        (),
        (
            ("product_id", "p_partkey"),
            (
                "product_category_name",
                "CASE WHEN p_partkey % 17 = 0 THEN NULL "
                "WHEN p_partkey % 19 = 0 THEN p_type || ' NEW' ELSE p_type END",
            ),
            ("product_name_lenght", "CAST(LENGTH(p_name) AS INT)"),
            (
                "product_description_lenght",
                "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size * 10 END",
            ),
            ("product_photos_qty", "p_size % 6"),
            ("product_weight_g", "p_size * 100"),
            ("product_length_cm", "p_size + 2"),
            ("product_height_cm", "p_size"),
            ("product_width_cm", "p_size + 1"),
        ),
    ),
    "sellers": DerivedTable(
        "supplier",
        (("nation", "s_nationkey", "n_nationkey"),),
        (
            ("seller_id", "s_suppkey"),
            ("seller_zip_code_prefix", _zip("s_suppkey")),
            ("seller_city", "CONCAT('city_', CAST(s_nationkey AS STRING))"),
            ("seller_state", "n_name"),
        ),
    ),
    "translation": DerivedTable(
        "part",
        (),
        (
            ("product_category_name", "p_type"),
            ("product_category_name_english", "LOWER(p_type)"),
        ),
        distinct=True,
    ),
    "geolocation": DerivedTable(
        "customer",
        (("nation", "c_nationkey", "n_nationkey"),),
        (
            ("geolocation_zip_code_prefix", _zip("c_custkey")),
            ("geolocation_lat", "CAST(c_nationkey AS DOUBLE) - 12.5"),
            ("geolocation_lng", "CAST(c_custkey % 360 AS DOUBLE) - 180.0"),
            ("geolocation_city", "c_mktsegment"),
            ("geolocation_state", "n_name"),
        ),
    ),
}


class SampleTables(Mapping):
    """The derived tables of a folder by name, each set up when first asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark = spark
        self._folder = folder
        self._raw: dict[str, DataFrame] = {}
        self._ready: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._raw[name]

    def _derive(self, spec: DerivedTable) -> DataFrame:
        df = self._read(spec.base)
        for other, left, right in spec.joins:
            df = df.join(self._read(other), F.col(left) == F.col(right))
        df = df.selectExpr(*(f"{expr} AS {column}" for column, expr in spec.columns))
        return df.distinct() if spec.distinct else df

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._ready:
            self._ready[name] = self._derive(DERIVED[name])
        return self._ready[name]

    def __iter__(self):
        return iter(DERIVED)

    def __len__(self) -> int:
        return len(DERIVED)
