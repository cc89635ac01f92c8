"""Intermediate results written once to the cluster's shared checkpoint folder.

A staged table cuts the lineage: the joins above it run exactly once, later
passes read only the columns they need, and a lost executor re-reads files
instead of recomputing the plan.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR_SETTING = "spark.checkpoint.dir"
_test_folders: dict[str, str] = {}  # application id → folder of a local test session


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local-mode test session may lack one."""
    configured = spark.conf.get(_DIR_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {_DIR_SETTING} to a folder all executors can reach")
    application = spark.conf.get("spark.app.id")
    if application not in _test_folders:
        _test_folders[application] = tempfile.mkdtemp(prefix="agoralytics-")
    return _test_folders[application]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/agoralytics/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
