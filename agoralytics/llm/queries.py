"""The operators of this package as queries over the sample tables in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoralytics.llm import (
    covertree,
    decontamination,
    doubling,
    fixity,
    licences,
    manifest,
    packing,
    pseudonyms,
    quality,
    ranked,
    repeats,
    sharding,
    simhash,
)
from agoralytics.llm.oracle import ORACLE_SQL  # noqa: F401  read where the queries are registered
from agoralytics.plans.staging import staged

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 40


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, folder, "documents"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """Audit an archive of all pages against a replica in which some records have changed or are lost."""
    pages = table(spark, folder, "pages")
    record = fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    draw = F.coalesce(F.crc32(F.col("page_id").cast("string").cast("binary")), F.lit(0))
    middle = F.floor(F.length("record") / 2).cast("int")
    byte = F.when(F.substr("record", middle, F.lit(1)) == F.lit("x").cast("binary"), "y").otherwise("x")
    damaged = F.concat(F.substr("record", F.lit(1), middle - 1), byte.cast("binary"), F.substr("record", middle + 1))
    copy = F.when(draw % 97 == 3, damaged).when(draw % 193 == 5, None).otherwise(F.col("record"))
    digests = pages.select("page_id", record.alias("record"), draw.alias("draw")).select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.length("record").cast("bigint").alias("length"),
        F.sha2("record", 256).alias("digest"),
        F.sha2(copy, 256).alias("copy_digest"),
    )
    archive = staged(fixity.manifest(staged(digests, "digests")), "archive")
    replica = archive.where("copy_digest IS NOT NULL").withColumn("digest", F.col("copy_digest"))
    found = fixity.audit(archive, replica)
    return found.join(archive.select("file", "position", "page_id"), ["file", "position"])


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents"), SHARDS)


def op7_covertree(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.embedding_links(table(spark, folder, "embeddings"))


def op8_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of all documents, filed under source and language in folders of sixteen by id."""
    docs = table(spark, folder, "documents")
    number = F.coalesce("doc_id", F.lit(0))
    shelf = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("xx")), F.floor(number / 256).cast("string"))
    inner = F.concat_ws("/", shelf, F.pmod(F.floor(number / 16), F.lit(16)).cast("string"))
    place = (
        F.when(number % 64 == 0, F.concat(shelf, F.lit("/LICENSE")))
        .when(number % 16 == 0, F.concat(inner, F.lit("/LICENSE.txt")))
        .otherwise(F.concat(inner, F.lit("/"), number.cast("string"), F.lit(".txt")))
    )
    return licences.scan_licences(docs.select("doc_id", "text", place.alias("path")))


def op9_repeats(spark: SparkSession, folder: str) -> DataFrame:
    done = repeats.strip_repeats(table(spark, folder, "documents"))
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"))


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Prove all documents against their manifest; every seventh id by checksum claims one more character."""
    docs = table(spark, folder, "documents")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    draw = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    raised = F.col("n_chars").cast("decimal(20,0)") + 1  # the largest number of characters has a successor too
    altered = manifest.leaf_digest(*(raised if f == "n_chars" else F.col(f) for f in fields))
    return manifest.prove(
        docs.select(
            manifest.tree_key(F.col("lang")).alias("tree"),
            "doc_id",
            manifest.leaf_digest(*map(F.col, fields)).alias("leaf"),
            F.when(draw == 0, altered).alias("claimed"),
        )
    )


def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_windows(spark: SparkSession, folder: str) -> DataFrame:
    done = doubling.strip_windows(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_pseudonyms": op2_pseudonyms,
    "op3_packing": op3_packing,
    "op4_decontamination": op4_decontamination,
    "op5_fixity": op5_fixity,
    "op6_sharding": op6_sharding,
    "op7_covertree": op7_covertree,
    "op8_licences": op8_licences,
    "op9_repeats": op9_repeats,
    "op10_simhash": op10_simhash,
    "op11_manifest": op11_manifest,
    "op12_search": op12_search,
    "op13_windows": op13_windows,
}
