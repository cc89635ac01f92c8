"""Raw documents to packed training sequences: stages that each read what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoralytics.llm import decontamination, packing, pseudonyms, quality, simhash
from agoralytics.llm.queries import table, tokenizer_path
from agoralytics.plans.staging import staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the first by id, rows without an id last, then the first read.

    Rows are numbered as they are staged, so repeated rows and rows without an id are told apart.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    groups = simhash.simhash_groups(rows, id_col=row).select(F.col("doc_id").alias("member"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "member").alias("order")
    ids = rows.select(F.col(row).alias("member"), "doc_id")
    first = groups.join(ids, "member").groupBy("component_id").agg(F.min(order).alias("first"))
    kept = first.select(F.col("first.member").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms; ``n_chars`` stays the length read."""
    return pseudonyms.replace_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

# The classifier, the fingerprints and the tokenizer cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
