"""Monthly cohort retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoralytics.functions.scalars import month_key_of, month_number, parse_month, percent
from agoralytics.operators.common import DELIVERED, with_status

# The default cohort window and the reported month offsets.
FIRST_COHORT = "2017-01"
LAST_COHORT = "2018-01"
OFFSETS = (0, 1, 2, 3, 6, 12)

_WORD = 64  # months held by one bit set


def _month_bits(month: Column, base: int) -> Column:
    """Bit set of the months ``base .. base + 63`` occurring in a group."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), month - base)
    return F.bit_or(F.when(month.between(base, base + _WORD - 1), bit))


def cohort_activity(
    orders: DataFrame,
    customers: DataFrame,
    lo: str,
    hi: str,
    offsets: Sequence[int],
    status: str = DELIVERED,
) -> DataFrame:
    """Per first-purchase month ``lo``..``hi``: customers active ``offsets`` months later.

    One aggregation per customer yields the first month and a bit set of the
    months with a purchase. A customer with very many orders is thus a few
    integers before the shuffle, and no list of purchases is ever built.
    """
    start, last = parse_month(lo), parse_month(hi)
    words = (last - start + max(offsets)) // _WORD + 1
    month = F.col("month")
    bought = (
        with_status(orders, status)
        .select("customer_id", month_number(F.col("order_purchase_timestamp")).alias("month"))
        .join(customers.select("customer_id", "customer_unique_id"), "customer_id")
        .filter(F.col("customer_unique_id").isNotNull())
    )
    per_customer = bought.groupBy("customer_unique_id").agg(
        F.min(month).alias("first"),
        *(_month_bits(month, start + w * _WORD).alias(f"months_{w}") for w in range(words)),
    )

    def active(offset: int) -> Column:
        spot = F.col("first") - start + offset
        bits = F.when(spot < _WORD, F.col("months_0"))
        for w in range(1, words):
            bits = bits.when(spot < (w + 1) * _WORD, F.col(f"months_{w}"))
        shifted = F.call_function("shiftrightunsigned", bits, spot % _WORD)
        return F.coalesce(shifted.bitwiseAND(F.lit(1)), F.lit(0))

    return (
        per_customer.filter(F.col("first").between(start, last))
        .groupBy("first")
        .agg(*(F.sum(active(k)).alias(f"month_{k}") for k in offsets))
        .select(month_key_of(F.col("first")).alias("cohort_month"), *(f"month_{k}" for k in offsets))
    )


def cohort_retention_counts(
    orders: DataFrame,
    customers: DataFrame,
    lo: str = FIRST_COHORT,
    hi: str = LAST_COHORT,
    offsets: Sequence[int] = OFFSETS,
    status: str = DELIVERED,
) -> DataFrame:
    """Active customers by cohort; the column of offset 0 is the cohort size."""
    return (
        cohort_activity(orders, customers, lo, hi, offsets, status)
        .withColumnRenamed("month_0", "month_0_base")
        .orderBy("cohort_month")
    )


def cohort_retention_pct(
    orders: DataFrame,
    customers: DataFrame,
    lo: str = FIRST_COHORT,
    hi: str = LAST_COHORT,
    status: str = DELIVERED,
) -> DataFrame:
    """Cohort size and the share of it active 1, 2, 3 and 6 months later."""
    base = F.col("month_0")
    return (
        cohort_activity(orders, customers, lo, hi, (0, 1, 2, 3, 6), status)
        .select(
            "cohort_month",
            base.alias("cohort_size"),
            *(
                percent(F.col(f"month_{k}"), base).alias(f"retention_month_{k}_pct")
                for k in (1, 2, 3, 6)
            ),
        )
        .orderBy("cohort_month")
    )


def cohort_retention(
    orders: DataFrame,
    customers: DataFrame,
    lo: str = FIRST_COHORT,
    hi: str = LAST_COHORT,
    status: str = DELIVERED,
) -> DataFrame:
    """Counts and shares side by side."""
    counts = cohort_retention_counts(orders, customers, lo, hi, OFFSETS, status)
    return counts.withColumns(
        {
            f"retention_m{k}_pct": percent(F.col(f"month_{k}"), F.col("month_0_base"))
            for k in (1, 3, 6)
        }
    ).orderBy("cohort_month")
