"""Stable placement of rows on shards by jump consistent hashing."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agoralytics.plans.staging import staged

# The generator and the word size of the published jump hash.
MULTIPLIER = Decimal(2862933555777941757)
WORD = Decimal(1 << 64)
HIGH_BITS = Decimal(1 << 33)
RANGE = float(1 << 31)

RECORD_OVERHEAD = 16


def jump_shards(key: Column, shards: int) -> Column:
    """``struct(shard, grown)``: the shard among ``shards`` and among one more.

    The jumps of a key do not depend on the number of shards: a shard is the last jump below
    that number. One walk therefore answers both counts, and ``grown`` differs from ``shard``
    only where the walk lands on the new shard. A jump moves up by at least one, so
    ``shards + 1`` steps reach the end; steps after it change nothing. A null key counts as 0.
    """
    unsigned = F.pmod(F.coalesce(key, F.lit(0)).cast("decimal(20,0)"), F.lit(WORD))
    start = F.struct(
        F.lit(-1).cast("bigint").alias("shard"),
        F.lit(-1).cast("bigint").alias("grown"),
        F.lit(0).cast("bigint").alias("jump"),
        unsigned.cast("decimal(20,0)").alias("state"),
    )

    def step(s: Column, _: Column) -> Column:
        state = ((s.state * F.lit(MULTIPLIER) + 1) % F.lit(WORD)).cast("decimal(20,0)")
        high = F.floor(state / F.lit(HIGH_BITS)).cast("double") + 1
        jump = F.floor((s.jump + 1).cast("double") * (F.lit(RANGE) / high)).cast("bigint")
        moved = F.struct(
            F.when(s.jump < shards, s.jump).otherwise(s.shard).alias("shard"),
            s.jump.alias("grown"),
            jump.alias("jump"),
            state.alias("state"),
        )
        return F.when(s.jump <= shards, moved).otherwise(s)

    walked = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return F.transform(
        F.array(walked),
        lambda s: F.struct(s.shard.cast("int").alias("shard"), s.grown.cast("int").alias("grown")),
    )[0]


def assign_shards(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Place every row of ``docs`` on one of ``shards`` shards by its id.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. ``size`` is the UTF-8
    length of the text (null: none) plus 16, ``text_crc32`` its checksum (null: that of no
    bytes, 0). ``slot`` numbers the rows of a shard from 0 without gaps, in the order of the
    rows read; ``grown_shard`` is the place after one shard is added, which is either the same
    or the new one. Repeated rows and repeated ids each keep their own slot; rows without an
    id go where id 0 goes. An empty table gives no rows, other columns are ignored.

    A slot is a position among the rows of one shard that one input task has read, plus the
    rows of earlier tasks, so no shard's rows ever meet in one task, however hot a key is.
    """
    text = F.col(text_col).cast("string").cast("binary")
    place = jump_shards(F.col(id_col).cast("bigint"), shards)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + RECORD_OVERHEAD).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0).cast("bigint")).alias("text_crc32"),
        place.alias("place"),
        F.monotonically_increasing_id().alias("row"),
    ).select(
        "doc_id",
        "size",
        "text_crc32",
        "place.shard",
        F.col("place.grown").alias("grown_shard"),
        "row",
        F.shiftright("row", 33).alias("task"),
    )
    placed = staged(rows, "shards")
    counted = placed.groupBy("shard", "task").agg(F.count(F.lit(1)).alias("n"))
    # One row per shard and input task: counts, not data.
    before = counted.select(
        "shard",
        "task",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("task")) - F.col("n")).alias("before"),
    )
    within = F.row_number().over(Window.partitionBy("shard", "task").orderBy("row")) - 1
    return (
        placed.withColumn("position", within)
        .join(before, ["shard", "task"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("before") + F.col("position")).cast(T.LongType()).alias("slot"),
            "grown_shard",
        )
    )
