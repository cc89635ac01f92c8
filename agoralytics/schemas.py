"""Typed schemas, declared keys and joins of the nine marketplace tables.

Operators rely on the declared primary keys the way any star-schema query does:
one row per order in ``orders``, one row per ``customer_id`` in ``customers``,
and so on. ``quality.primary_key_check`` reports violations and
``tables.materialize_tables`` removes them while writing the typed copy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TEXT = T.StringType()
INT = T.IntegerType()
MONEY = T.DecimalType(10, 2)
REAL = T.DoubleType()
MOMENT = T.TimestampNTZType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


CUSTOMERS = _table(
    customer_id=TEXT,
    customer_unique_id=TEXT,
    customer_zip_code_prefix=TEXT,
    customer_city=TEXT,
    customer_state=TEXT,
)

ORDERS = _table(
    order_id=TEXT,
    customer_id=TEXT,
    order_status=TEXT,
    order_purchase_timestamp=MOMENT,
    order_approved_at=MOMENT,
    order_delivered_carrier_date=MOMENT,
    order_delivered_customer_date=MOMENT,
    order_estimated_delivery_date=MOMENT,
)

ORDER_ITEMS = _table(
    order_id=TEXT,
    order_item_id=INT,
    product_id=TEXT,
    seller_id=TEXT,
    shipping_limit_date=MOMENT,
    price=MONEY,
    freight_value=MONEY,
)

ORDER_PAYMENTS = _table(
    order_id=TEXT,
    payment_sequential=INT,
    payment_type=TEXT,
    payment_installments=INT,
    payment_value=MONEY,
)

ORDER_REVIEWS = _table(
    review_id=TEXT,
    order_id=TEXT,
    review_score=INT,
    review_comment_title=TEXT,
    review_comment_message=TEXT,
    review_creation_date=MOMENT,
    review_answer_timestamp=MOMENT,
)

# "lenght" is how the source files spell these two headers.
PRODUCTS = _table(
    product_id=TEXT,
    product_category_name=TEXT,
    product_name_lenght=INT,
    product_description_lenght=INT,
    product_photos_qty=INT,
    product_weight_g=INT,
    product_length_cm=INT,
    product_height_cm=INT,
    product_width_cm=INT,
)

SELLERS = _table(
    seller_id=TEXT,
    seller_zip_code_prefix=TEXT,
    seller_city=TEXT,
    seller_state=TEXT,
)

GEOLOCATION = _table(
    geolocation_zip_code_prefix=TEXT,
    geolocation_lat=REAL,
    geolocation_lng=REAL,
    geolocation_city=TEXT,
    geolocation_state=TEXT,
)

TRANSLATION = _table(
    product_category_name=TEXT,
    product_category_name_english=TEXT,
)


@dataclass(frozen=True)
class TableSpec:
    """How one table is read and what identifies a row."""

    schema: T.StructType
    primary_key: tuple[str, ...] = ()
    # Columns compared for equality by the views: stored trimmed and lower-cased.
    normalised: tuple[str, ...] = ()
    # Free text may hold quoted line breaks; such files cannot be split.
    multiline: bool = False


TABLES: dict[str, TableSpec] = {
    "customers": TableSpec(CUSTOMERS, ("customer_id",)),
    "orders": TableSpec(ORDERS, ("order_id",), ("order_status",)),
    "order_items": TableSpec(ORDER_ITEMS, ("order_id", "order_item_id")),
    "order_payments": TableSpec(ORDER_PAYMENTS, (), ("payment_type",)),
    "order_reviews": TableSpec(ORDER_REVIEWS, multiline=True),
    "products": TableSpec(PRODUCTS, ("product_id",), ("product_category_name",)),
    "sellers": TableSpec(SELLERS, ("seller_id",)),
    "translation": TableSpec(TRANSLATION, (), ("product_category_name",)),
    "geolocation": TableSpec(GEOLOCATION),
}

# (child table, parent table, shared column): the declared reference first,
# then the equality joins the views depend on.
FOREIGN_KEYS: tuple[tuple[str, str, str], ...] = (
    ("orders", "customers", "customer_id"),
    ("order_items", "orders", "order_id"),
    ("order_items", "products", "product_id"),
    ("order_items", "sellers", "seller_id"),
    ("order_payments", "orders", "order_id"),
    ("order_reviews", "orders", "order_id"),
)


@dataclass(frozen=True)
class KeyDomain:
    """Columns that hold the same text key, and values the operators compare it with."""

    places: tuple[tuple[str, str], ...]
    fixed: tuple[str, ...] = ()


TEXT_KEYS: dict[str, KeyDomain] = {
    "order_status": KeyDomain((("orders", "order_status"),), ("delivered",)),
    "payment_type": KeyDomain((("order_payments", "payment_type"),)),
    "category": KeyDomain(
        (("products", "product_category_name"), ("translation", "product_category_name"))
    ),
    "category_label": KeyDomain((("translation", "product_category_name_english"),)),
    "state": KeyDomain(
        (
            ("customers", "customer_state"),
            ("sellers", "seller_state"),
            ("geolocation", "geolocation_state"),
        )
    ),
}

ID_KEYS: dict[str, KeyDomain] = {
    key: KeyDomain(tuple((name, key) for name, spec in TABLES.items() if key in spec.schema.names))
    for key in ("order_id", "customer_id", "customer_unique_id", "product_id", "seller_id")
}
