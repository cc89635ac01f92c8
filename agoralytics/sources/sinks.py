"""Result files: CSV folders with a header row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A ``customer_segment`` summary has one row per segment label.
_SUMMARY_FILES = 1
MOMENT_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, out_dir: str, null_text: str = "") -> str:
    """A CSV folder, one file per partition."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", null_text)
        .option("emptyValue", '""')
        .option("timestampNTZFormat", MOMENT_FORMAT)
        .csv(out_dir)
    )
    return out_dir


def write_rfm_output(rfm: DataFrame, out_dir: str) -> str:
    """Per-customer scores; one file per partition."""
    return write_csv(rfm, out_dir)


def write_segment_summary(summary: DataFrame, out_dir: str) -> str:
    """Segment summary; a handful of rows, hence a single file."""
    ordered = summary.orderBy(F.desc("total_revenue"), "customer_segment")
    return write_csv(ordered.coalesce(_SUMMARY_FILES), out_dir)


def export_view(spark: SparkSession, name: str, out_dir: str) -> str:
    """A published view as CSV, missing values spelled NULL."""
    return write_csv(spark.table(name), out_dir, null_text="NULL")
