"""CSV ingest into the typed tables, and their typed Parquet copies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agoralytics.plans.staging import staged
from agoralytics.schemas import TABLES, TableSpec

REJECTED = "_rejected_line"
_BAD = "_is_rejected"
_PLACE = "_place"

# Header skipped, comma separated, quotes doubled inside quoted cells; an empty
# cell is NULL, an unreadable one is NULL and marks its row.
_DIALECT = {
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": REJECTED,
}


def _csv(spark: SparkSession, path: str, schema: T.StructType, multiline: bool) -> DataFrame:
    """Rows of a CSV file or folder, by one rule at every size.

    Line mode splits files over tasks. Where quoted cells may hold line breaks, a file is one
    task of the multi-line reader; deliver such tables as many files.
    """
    reader = spark.read.schema(schema).options(header=True, multiLine=multiline, **_DIALECT)
    return reader.csv(path)


def line_ending_cleanup(df: DataFrame) -> DataFrame:
    """Strip a carriage return left at the end of any text column."""

    def stripped(name: str) -> Column:
        text = F.col(name)
        shorter = F.substr(text, F.lit(1), F.length(text) - 1)
        return F.when(F.endswith(text, F.lit("\r")), shorter).otherwise(text).alias(name)

    return df.select(
        *(
            stripped(field.name) if isinstance(field.dataType, T.StringType) else field.name
            for field in df.schema.fields
        )
    )


def _clean(df: DataFrame, spec: TableSpec) -> DataFrame:
    # Keys compared without regard to case in the source system are normalised
    # once here, so that every later join and filter is a plain equality.
    df = line_ending_cleanup(df)
    return df.withColumns({name: F.lower(F.trim(name)) for name in spec.normalised})


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One table from a CSV file or a folder of them. An unreadable cell is NULL."""
    spec = TABLES[name]
    return _clean(_csv(spark, path, spec.schema, spec.multiline), spec)


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "customers", path)


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "orders", path)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "products", path)


def read_sellers(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "sellers", path)


def read_order_items(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "order_items", path)


def read_order_payments(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "order_payments", path)


def read_order_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews hold quoted line breaks, so each file is read by one task."""
    return read_table(spark, "order_reviews", path)


def read_translation(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "translation", path)


def read_geolocation(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "geolocation", path)


def rejected_rows(
    spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False
) -> DataFrame:
    """Rows with an unreadable cell or a wrong cell count: parsed columns plus the raw line.

    The rows can also be counted: the filter needs every parsed column, because the reader
    refuses a scan of the raw line alone.
    """
    noting = T.StructType([*schema.fields, T.StructField(REJECTED, T.StringType(), True)])
    cells = F.length(F.concat_ws("", *(F.col(f.name).cast("string") for f in schema.fields)))
    return _csv(spark, path, noting, multiline).filter(F.col(REJECTED).isNotNull() & (cells >= 0))


class Load(NamedTuple):
    """What one read gave: the rows, the lines set aside, and their numbers as one row."""

    rows: DataFrame
    rejected: DataFrame
    counts: DataFrame


def load_table(spark: SparkSession, name: str, path: str, out_dir: str) -> Load:
    """Write the readable rows of a CSV as Parquet, its rejected lines beside them, and count both in that one scan.

    A line is rejected when a cell cannot be read or the number of cells is wrong; ``rejected``
    has the parsed columns and the raw line. ``counts`` has ``table_name, lines, loaded,
    rejected``, where ``loaded + rejected = lines``; they are observed while the rows pass, so
    nothing is read again for them. Files without rows give zeros.
    """
    spec = TABLES[name]
    noting = T.StructType([*spec.schema.fields, T.StructField(REJECTED, T.StringType(), True)])
    lines = _clean(_csv(spark, path, noting, spec.multiline), spec).withColumn(_BAD, F.col(REJECTED).isNotNull())
    seen = Observation()
    noted = lines.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(_BAD).alias("rejected"))
    out = f"{out_dir}/{name}"
    noted.write.mode("overwrite").partitionBy(_BAD).parquet(out)
    counted = seen.get
    written = spark.read.schema(lines.schema).parquet(out)
    counts = spark.createDataFrame(
        [(name, counted["lines"], counted["lines"] - counted["rejected"], counted["rejected"])],
        "table_name string, lines bigint, loaded bigint, rejected bigint",
    )
    return Load(written.where(~F.col(_BAD)).select(*spec.schema.names), written.where(_BAD).drop(_BAD), counts)


def _with_place(df: DataFrame) -> DataFrame:
    """Add each row's place: file, block of the file, row of the block; without files, the row read."""
    row = F.monotonically_increasing_id().alias("row")
    try:
        return df.withColumn(_PLACE, F.struct("_metadata.file_path", "_metadata.file_block_start", row))
    except AnalysisException:  # not read from files
        return df.withColumn(_PLACE, F.struct(row))


def split_by_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The first row per key, and all others with a ``removal_reason``; a missing key column counts as one value.

    First is the smallest file path, then the place in the file, so it depends neither on the
    order in which files are listed nor on how they are split. The reason is ``missing key``
    where a key column is NULL, else ``repeated key``.

    A narrow pass over the key columns finds the keys used more than once. As a
    rule there are none, and the rows are written as they are read: they are
    neither shuffled nor sorted. Otherwise only the rows of repeated keys are written
    aside and grouped, one candidate per key leaving each task.
    """
    names = [f"_key_{k}" for k in keys]
    missing = reduce(or_, (F.col(k).isNull() for k in keys))
    reason = F.when(missing, "missing key").otherwise("repeated key").alias("removal_reason")
    counted = df.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names))).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    repeated = staged(counted.filter(F.col("_rows") > 1).select(*names), "repeated-keys")
    if repeated.isEmpty():
        return df, df.sparkSession.createDataFrame([], df.select("*", reason).schema)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)))
    candidates = staged(_with_place(df).join(repeated, same), "rows-of-repeated-keys")
    first = candidates.groupBy(*names).agg(F.min_by(F.struct(*df.columns, _PLACE), _PLACE).alias("_row"))
    kept = df.join(repeated, same, "left_anti").unionByName(first.select("_row.*").drop(_PLACE))
    places = first.select(*names, F.col(f"_row.{_PLACE}").alias("_first"))
    removed = candidates.drop(*names).join(places, same).where(F.col(_PLACE) != F.col("_first"))
    return kept, removed.select(*df.columns, reason)


def first_of_each_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row per key, as ``split_by_key`` finds it."""
    return split_by_key(df, keys)[0]


def materialize_tables(
    tables: Mapping[str, DataFrame], out_dir: str, removed_dir: str | None = None
) -> dict[str, DataFrame]:
    """Write one typed Parquet copy per table, unique on its primary key, and return the copies.

    With ``removed_dir`` the rows left out are written there, a folder per table with a primary
    key; the rows kept and removed are together those read.
    """
    copies = {}
    for name, df in tables.items():
        keys = TABLES[name].primary_key
        path = f"{out_dir}/{name}"
        kept, removed = split_by_key(df, keys) if keys else (df, None)
        kept.write.mode("overwrite").parquet(path)
        if removed_dir is not None and removed is not None:
            removed.write.mode("overwrite").parquet(f"{removed_dir}/{name}")
        copies[name] = df.sparkSession.read.schema(df.schema).parquet(path)
    return copies


def removed_rows(spark: SparkSession, name: str, removed_dir: str) -> DataFrame:
    """The rows of one table that ``materialize_tables`` left out, each with its ``removal_reason``."""
    noted = T.StructType([*TABLES[name].schema.fields, T.StructField("removal_reason", T.StringType())])
    return spark.read.schema(noted).parquet(f"{removed_dir}/{name}")


def open_tables(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The typed copies written by ``materialize_tables`` from CSV input."""
    return {
        name: spark.read.schema(spec.schema).parquet(f"{out_dir}/{name}")
        for name, spec in TABLES.items()
    }
