"""One spelling per text key, chosen under the source's collation."""

from __future__ import annotations

import random

from agoralytics.operators import common, kpis
from agoralytics.schemas import ID_KEYS, TEXT_KEYS, KeyDomain
from agoralytics.sources import spellings, tables

CATEGORY = {"category": TEXT_KEYS["category"]}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def catalogue(spark, names, translated):
    return {
        "products": spark.createDataFrame(list(enumerate(names)), "product_id bigint, product_category_name string"),
        "translation": spark.createDataFrame(
            translated, "product_category_name string, product_category_name_english string"
        ),
    }


def test_variants_of_a_category_join_and_group_as_one(spark):
    names = ["moveis_decoração", "MOVEIS_DECORACAO", "moveis_decoração", "moveis", None, ""]
    one = spellings.one_spelling(catalogue(spark, names, [("Móveis_Decoracao", "furniture")]), CATEGORY)
    labels = common.labelled_products(one["products"], one["translation"], "Unknown")
    assert sorted((r.product_id, r.category_english) for r in labels.collect()) == [
        (0, "furniture"), (1, "furniture"), (2, "furniture"), (3, "moveis"), (4, "Unknown"), (5, "")
    ]
    assert rows(labels.groupBy("category_english").count()) == [
        ("", 1), ("Unknown", 1), ("furniture", 3), ("moveis", 1)
    ]


def test_the_stored_spelling_is_fixed_or_the_smallest(spark):
    orders = spark.createDataFrame([("Délivered",), ("DELIVERED",), ("Shipped",), ("shippéd",), (None,)], "order_status string")
    found = spellings.key_spellings({"orders": orders}, {"order_status": TEXT_KEYS["order_status"]})
    assert rows(found) == [
        ("order_status", "Shipped", "Shipped", 1),
        ("order_status", "Shipped", "shippéd", 1),
        ("order_status", "delivered", "DELIVERED", 1),
        ("order_status", "delivered", "Délivered", 1),
    ]
    one = spellings.one_spelling({"orders": orders})["orders"]
    assert common.with_status(one).count() == 2
    assert rows(one) == [("Shipped",), ("Shipped",), ("delivered",), ("delivered",), (None,)]


def test_spaces_and_other_letters_still_count(spark):
    names = ["a", "a ", " a", "b", "ß", "ss", "ø", "o"]
    one = spellings.one_spelling(catalogue(spark, names, []), CATEGORY)
    stored = {r.product_id: r.product_category_name for r in one["products"].collect()}
    assert [stored[k] for k in range(4)] == names[:4]


def test_tables_of_one_spelling_come_back_as_they_are(spark):
    given = catalogue(spark, ["x", "y", None], [("x", "X")])
    one = spellings.one_spelling(given, CATEGORY)
    assert all(one[name] is given[name] for name in given)
    empty = {name: df.limit(0) for name, df in given.items()}
    assert all(df.count() == 0 for df in spellings.one_spelling(empty).values())
    assert spellings.key_spellings(empty).count() == 0


def test_columns_of_other_names_and_types_stay(spark):
    given = spark.createDataFrame(
        [(1, "b", "É", "k", 2), (2, "c", "e", "l", 3)],
        "`a.b` int, _spelling string, product_category_name string, _stored string, __spelling int",
    )
    one = spellings.one_spelling({"products": given, "orders": spark.range(2).toDF("order_status")})
    assert one["products"].columns == given.columns
    assert rows(one["products"]) == [(1, "b", "e", "k", 2), (2, "c", "e", "l", 3)]
    assert one["orders"].schema["order_status"].dataType.typeName() == "long"


def test_ids_in_another_case_are_repeated_keys(spark, tmp_path):
    orders = spark.createDataFrame(
        [("AB", "c1", "shipped"), ("ab", "C1", "shipped"), ("cd", "c1", "shipped")],
        "order_id string, customer_id string, order_status string",
    )
    items = spark.createDataFrame([("Ab", 1), ("CD", 1)], "order_id string, order_item_id int")
    one = spellings.one_spelling({"orders": orders, "order_items": items}, {**TEXT_KEYS, **ID_KEYS})
    assert rows(one["order_items"]) == [("AB", 1), ("CD", 1)]
    copies = tables.materialize_tables({"orders": one["orders"]}, str(tmp_path))
    assert [r.order_id for r in copies["orders"].orderBy("order_id").collect()] == ["AB", "CD"]


def test_a_hot_spelling_and_many_others_equal_a_plain_fold(spark):
    rng = random.Random(3)
    variants = {"a": "aAáÃ", "o": "oOôÖ", "e": "eEéÊ"}
    words = ["".join(rng.choice("aoe") for _ in range(5)) for _ in range(60)]
    names = ["aoeaÃ"] * 1500 + ["".join(rng.choice(variants[c]) for c in rng.choice(words)) for _ in range(3000)]
    fold = str.maketrans("AáÃOôÖEéÊ", "aaaoooeee")
    least = {}
    for name in names:
        key = name.translate(fold)
        least[key] = min(least.get(key, name), name, key=lambda x: x.encode())
    one = spellings.one_spelling(catalogue(spark, names, []), CATEGORY)["products"]
    got = {r.product_id: r.product_category_name for r in one.collect()}
    assert got == {k: least[name.translate(fold)] for k, name in enumerate(names)}


def test_revenue_by_state_after_one_spelling(spark):
    orders = spark.createDataFrame([("o1", "c1", "delivered"), ("o2", "c2", "delivered")], "order_id string, customer_id string, order_status string")
    customers = spark.createDataFrame([("c1", "u1", "SP"), ("c2", "u2", "sp")], "customer_id string, customer_unique_id string, customer_state string")
    items = spark.sql("SELECT * FROM VALUES ('o1', 1, 10.00BD, 1.00BD), ('o2', 1, 5.00BD, 0.50BD) AS t(order_id, order_item_id, price, freight_value)")
    items = items.selectExpr("order_id", "order_item_id", "CAST(price AS DECIMAL(10,2)) price", "CAST(freight_value AS DECIMAL(10,2)) freight_value")
    one = spellings.one_spelling({"orders": orders, "customers": customers, "order_items": items})
    result = kpis.state_revenue(one["orders"], one["customers"], one["order_items"]).collect()
    assert [(r.customer_state, r.total_orders, float(r.total_revenue)) for r in result] == [("SP", 2, 16.5)]


def test_another_collation_and_keys_of_the_caller(spark):
    frame = spark.createDataFrame([("É",), ("é",), ("e",)], "city string")
    keys = {"city": KeyDomain((("places", "city"),))}
    one = spellings.one_spelling({"places": frame}, keys, collation="UNICODE_CI")["places"]
    assert rows(one) == [("e",), ("É",), ("É",)]
