"""CSV ingest, rejected rows, typed copies and result files."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from agoralytics.plans import views
from agoralytics.plans.staging import shared_folder, staged
from agoralytics.schemas import ORDERS, TABLES
from agoralytics.sources import sinks, tables

REVIEW_HEADER = ",".join(TABLES["order_reviews"].schema.names)
ORDER_HEADER = ",".join(ORDERS.names)


def put(tmp_path, text, name="data.csv", encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_reviews_keep_quoted_line_breaks_quotes_and_backslashes(spark, tmp_path):
    path = put(
        tmp_path,
        REVIEW_HEADER
        + '\nr1,o1,5,,"first line\nsecond ""quoted"", a \\ backslash",2018-01-18 00:00:00,2018-01-18 21:46:59\n'
        + "r2,o2,1,title,,2018-03-10 00:00:00,2018-03-11 03:05:13\n",
    )
    rows = {r.review_id: r for r in tables.read_order_reviews(spark, path).collect()}
    assert rows["r1"].review_comment_message == 'first line\nsecond "quoted", a \\ backslash'
    assert rows["r1"].review_comment_title is None
    assert rows["r2"].review_score == 1 and rows["r2"].review_comment_message is None
    assert rows["r2"].review_answer_timestamp == dt.datetime(2018, 3, 11, 3, 5, 13)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_translation_with_byte_order_mark_and_no_last_newline(spark, tmp_path, ending):
    path = put(
        tmp_path,
        ending.join(
            [
                "product_category_name,product_category_name_english",
                "beleza_saude,health_beauty",
                " Informatica_Acessorios ,computers_accessories",
            ]
        ),
        encoding="utf-8-sig",
    )
    df = tables.read_translation(spark, path)
    assert sorted(map(tuple, df.collect())) == [
        ("beleza_saude", "health_beauty"),
        ("informatica_acessorios", "computers_accessories"),
    ]


def test_empty_cells_and_leading_zeros(spark, tmp_path):
    path = put(
        tmp_path,
        ",".join(TABLES["products"].schema.names) + "\np1,perfumaria,40,287,1,225,16,10,14\np2,,,,,,,,\n",
        "products.csv",
    )
    rows = {r.product_id: r for r in tables.read_products(spark, path).collect()}
    assert rows["p1"].product_weight_g == 225
    assert set(list(rows["p2"])[1:]) == {None}
    path = put(
        tmp_path,
        ",".join(TABLES["sellers"].schema.names) + '\ns1,01310,"sao paulo, centro",SP\n',
        "sellers.csv",
    )
    assert tuple(tables.read_sellers(spark, path).first()) == ("s1", "01310", "sao paulo, centro", "SP")


def test_unreadable_cell_is_null_and_the_row_is_reported(spark, tmp_path):
    good = "o1,c1,Delivered ,2017-10-02 10:56:33,,,2017-10-10 21:25:13,2017-10-18 00:00:00"
    bad = "o2,c2,shipped,yesterday,,,,2017-10-18 00:00:00"
    path = put(tmp_path, f"{ORDER_HEADER}\n{good}\n{bad}\n")
    rows = {r.order_id: r for r in tables.read_orders(spark, path).collect()}
    assert rows["o1"].order_status == "delivered"
    assert rows["o1"].order_approved_at is None
    assert rows["o2"].order_purchase_timestamp is None
    assert rows["o2"].order_estimated_delivery_date == dt.datetime(2017, 10, 18)
    rejected = tables.rejected_rows(spark, path, ORDERS).collect()
    assert [(r.order_id, r[tables.REJECTED]) for r in rejected] == [("o2", bad)]


def test_line_ending_cleanup_touches_text_only(spark):
    df = spark.createDataFrame([("a\r", 1, "b\rc"), (None, 2, "d\r\r")], "x string, n int, y string")
    assert [tuple(r) for r in tables.line_ending_cleanup(df).collect()] == [
        ("a", 1, "b\rc"),
        (None, 2, "d\r"),
    ]


def test_materialized_tables_hold_the_first_row_of_each_key(spark, tmp_path):
    sellers = spark.createDataFrame(
        [("s1", "1", "first", "SP"), ("s2", "2", "x", "RJ"), ("s1", "3", "second", "MG"), (None, "4", "y", "BA"), (None, "5", "z", "BA")],
        TABLES["sellers"].schema,
    ).coalesce(1)
    translation = spark.createDataFrame([("a", "b"), ("a", "b")], TABLES["translation"].schema)
    copies = tables.materialize_tables(
        {"sellers": sellers, "translation": translation}, str(tmp_path / "typed")
    )
    assert sorted((r.seller_id or "", r.seller_city) for r in copies["sellers"].collect()) == [
        ("", "y"),
        ("s1", "first"),
        ("s2", "x"),
    ]
    assert copies["translation"].count() == 2
    assert copies["sellers"].schema == TABLES["sellers"].schema


def test_clean_tables_are_not_shuffled_on_load(spark, tmp_path):
    header = ",".join(TABLES["sellers"].schema.names)
    path = put(tmp_path, f"{header}\ns1,01310,a,SP\ns2,01311,b,RJ\n,01312,c,RJ\n")
    kept = tables.first_of_each_key(tables.read_sellers(spark, path), ("seller_id",))
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.seller_id or "" for r in kept.collect()) == ["", "s1", "s2"]


def test_typed_copies_can_be_opened_again(spark, tmp_path):
    empty = {name: spark.createDataFrame([], spec.schema) for name, spec in TABLES.items()}
    tables.materialize_tables(empty, str(tmp_path / "typed"))
    opened = tables.open_tables(spark, str(tmp_path / "typed"))
    assert {name: df.schema for name, df in opened.items()} == {
        name: spec.schema for name, spec in TABLES.items()
    }


def test_files_of_a_folder_are_read_in_parallel_tasks(spark, tmp_path):
    header = ",".join(TABLES["order_payments"].schema.names)
    for part in range(3):
        put(tmp_path, f"{header}\no{part},1,BOLETO,2,10.50\n", f"part{part}.csv")
    df = tables.read_order_payments(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [
        (f"o{part}", 1, "boleto", 2, Decimal("10.50")) for part in range(3)
    ]


def test_export_spells_missing_values(spark, tmp_path):
    df = spark.createDataFrame([("2016-09", None), ("2016-10", 1.5)], "month string, growth double")
    views.publish_view("vw_export_case", df.coalesce(1))
    folder = sinks.export_view(spark, "vw_export_case", str(tmp_path / "out"))
    lines = sorted(r.value for r in spark.read.text(folder).collect())
    assert lines == ["2016-09,NULL", "2016-10,1.5", "month,growth"]
    spark.catalog.dropTempView("vw_export_case")


def test_segment_files(spark, tmp_path):
    summary = spark.createDataFrame(
        [("Champions", 2, Decimal("1.50"), Decimal("3.00")), ("Loyal Customers", 1, Decimal("9.00"), Decimal("9.00"))],
        "customer_segment string, customer_count long, avg_spend decimal(10,2), total_revenue decimal(10,2)",
    )
    folder = sinks.write_segment_summary(summary, str(tmp_path / "summary"))
    assert [r.value for r in spark.read.text(folder).collect()] == [
        "customer_segment,customer_count,avg_spend,total_revenue",
        "Loyal Customers,1,9.00,9.00",
        "Champions,2,1.50,3.00",
    ]


def test_staged_tables_live_in_the_folder_of_the_session(spark):
    df = staged(spark.range(5).withColumn("k", F.col("id") % 2), "case")
    assert df.count() == 5
    assert all(shared_folder(spark) in path for path in df.inputFiles())


def test_publish_and_list(spark):
    first = views.publish_view("vw_case", spark.range(2))
    assert first.count() == 2
    views.publish_view("vw_case", spark.range(3))
    assert spark.table("vw_case").count() == 3
    assert "vw_case" in {r.viewName for r in views.list_views(spark).collect()}
    spark.catalog.dropTempView("vw_case")


class Settings:
    def __init__(self, **values):
        self.conf = self
        self._values = {k.replace("_", "."): v for k, v in values.items()}

    def get(self, key, default=None):
        return self._values.get(key, default)


def test_staging_folder_is_local_only_for_local_sessions():
    assert shared_folder(Settings(spark_checkpoint_dir="hdfs://x/ck/")) == "hdfs://x/ck"
    own = Settings(spark_master="local[2]", spark_app_id="app-1")
    assert shared_folder(own) == shared_folder(own)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Settings(spark_master="spark://host:7077", spark_app_id="app-2"))


def test_reviews_with_windows_line_ends_and_quoted_empty_cells(spark, tmp_path):
    path = put(
        tmp_path,
        REVIEW_HEADER + '\r\nr1,o1,5,"","a\r\nb",2018-01-18 00:00:00,2018-01-18 21:46:59\r\n',
        "crlf.csv",
    )
    row = tables.read_order_reviews(spark, path).first()
    assert row.review_comment_title is None
    assert row.review_comment_message == "a\nb"
    assert row.review_answer_timestamp == dt.datetime(2018, 1, 18, 21, 46, 59)


DATES = ",2018-01-18 00:00:00,2018-01-18 21:46:59"
PLAIN = f"r2,o2,4,b,y{DATES}\n"
REVIEW_FILES = {
    "bare quote": f'r1,o1,5,a 5" screen,x{DATES}\n{PLAIN}r3,o3,3,c,z{DATES}\n',
    "blank lines in quotes": f'r1,o1,5,"a\n\n\nb",x{DATES}\n{PLAIN}r3,o3,3,c,z{DATES}\n',
    "doubled quotes": f'r1,o1,5,"say ""hi""",x{DATES}\n{PLAIN}r3,o3,3,c,z{DATES}\n',
    "short row": f"r1,o1\n{PLAIN}r3,o3,3,c,z{DATES}\n",
    "unreadable score": f"r1,o1,bad,a,x{DATES}\n{PLAIN}r3,o3,3,c,z{DATES}\n",
}


@pytest.mark.parametrize("kind", sorted(REVIEW_FILES))
def test_review_files_are_read_by_one_rule_whatever_their_size(spark, tmp_path, kind):
    """A record is read alike alone and behind as many others as fill a larger file."""
    small = put(tmp_path, f"{REVIEW_HEADER}\n{REVIEW_FILES[kind]}", "small.csv")
    filler = "".join(f"f{i},o,1,t,m{DATES}\n" for i in range(20_000))
    large = put(tmp_path, f"{REVIEW_HEADER}\n{filler}{REVIEW_FILES[kind]}", "large.csv")
    alone = tables.read_order_reviews(spark, small)
    behind = tables.read_order_reviews(spark, large).where("review_id NOT LIKE 'f%'")
    assert alone.count() == 3
    assert sorted(behind.collect(), key=str) == sorted(alone.collect(), key=str)


@pytest.mark.parametrize("multiline", [False, True])
def test_rejected_rows_can_be_counted(spark, tmp_path, multiline):
    rows = "r1,o1,bad,,,2018-01-18 00:00:00,\nr2,o2,5,,,2018-01-18 00:00:00,\nr3,o3,worse,,,,\n"
    path = put(tmp_path, f"{REVIEW_HEADER}\n{rows}", "bad.csv")
    rejected = tables.rejected_rows(spark, path, TABLES["order_reviews"].schema, multiline)
    assert rejected.count() == 2
    assert sorted(r.review_id for r in rejected.collect()) == ["r1", "r3"]




SELLER_HEADER = ",".join(TABLES["sellers"].schema.names)


@pytest.mark.parametrize("names", [("a.csv", "b.csv", "c.csv"), ("c.csv", "a.csv", "b.csv")])
def test_the_first_row_goes_by_file_and_place_and_the_rest_is_reported(spark, tmp_path, names):
    folder = tmp_path / "sellers"
    folder.mkdir()
    bodies = {
        "a.csv": "s1,1,from a,SP\ns2,2,from a,SP\ns2,2,later in a,SP\n,3,nameless a,SP",
        "b.csv": "s1,1,from b,SP\ns3,3,from b,SP",
        "c.csv": "s1,1,from c,SP\n,4,nameless c,SP\ns4,4,from c,SP",
    }
    for name in names:
        put(folder, f"{SELLER_HEADER}\n{bodies[name]}\n", name)
    # the same survivors whatever the size of the parts in which files are read
    for size in ("128MB", "40B"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            read = tables.read_sellers(spark, str(folder))
            out = str(tmp_path / f"out{size}")
            kept = tables.materialize_tables({"sellers": read}, out, f"{out}-removed")["sellers"]
            removed = tables.removed_rows(spark, "sellers", f"{out}-removed")
            assert sorted((r.seller_city, r.removal_reason) for r in removed.collect()) == [
                ("from b", "repeated key"),
                ("from c", "repeated key"),
                ("later in a", "repeated key"),
                ("nameless c", "missing key"),
            ]
            assert sorted(r.seller_city for r in kept.collect()) == [
                "from a", "from a", "from b", "from c", "nameless a",
            ]
            assert kept.count() + removed.count() == read.count() == 9
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tables_without_repeats_remove_nothing(spark, tmp_path):
    path = put(tmp_path, f"{SELLER_HEADER}\ns1,1,x,SP\ns2,2,y,SP\n")
    kept, removed = tables.split_by_key(tables.read_sellers(spark, path), ("seller_id",))
    assert kept.count() == 2 and removed.count() == 0 and removed.columns[-1] == "removal_reason"
    made = spark.createDataFrame([("s1", 1), ("s1", 2)], "seller_id string, n int")  # not read from files
    kept, removed = tables.split_by_key(made, ("seller_id",))
    assert (kept.count(), removed.count()) == (1, 1)


def test_one_scan_loads_and_counts(spark, tmp_path):
    header = ",".join(TABLES["order_payments"].schema.names)
    lines = [f"o{k},1,credit_card,{'many' if k % 10 == 0 else 2},5.00" for k in range(95)] + ["o99,1,boleto"]
    path = put(tmp_path, "\n".join([header, *lines]) + "\n")
    load = tables.load_table(spark, "order_payments", path, str(tmp_path / "loaded"))
    assert tuple(load.counts.first()) == ("order_payments", 96, 85, 11)
    assert load.rows.count() == 85 and load.rows.columns == TABLES["order_payments"].schema.names
    bad = {r[tables.REJECTED] for r in load.rejected.collect()}
    assert len(bad) == 11 and "o99,1,boleto" in bad
    again = tables.rejected_rows(spark, path, TABLES["order_payments"].schema)
    assert {r[tables.REJECTED] for r in again.collect()} == bad


def test_loading_nothing_counts_nothing(spark, tmp_path):
    path = put(tmp_path, ",".join(TABLES["sellers"].schema.names) + "\n")
    load = tables.load_table(spark, "sellers", path, str(tmp_path / "loaded"))
    assert tuple(load.counts.first()) == ("sellers", 0, 0, 0)
    assert load.rows.count() == load.rejected.count() == 0
