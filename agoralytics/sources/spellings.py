"""One spelling per text key: values that are equal under a collation are stored alike.

The source system compares text without regard to case and accents. Collated columns would say
so too, but hash aggregation and pushed filters do not work on them, and a group would show
whichever spelling came first. Here only the distinct spellings of a key are compared under the
collation, once, while loading; every later join, group and filter is a plain equality.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agoralytics.plans.staging import staged
from agoralytics.schemas import TEXT_KEYS, KeyDomain

COLLATION = "UNICODE_CI_AI"  # case and accents do not count
Tables = Mapping[str, DataFrame]


def _text_places(tables: Tables, domain: KeyDomain) -> list[tuple[str, str]]:
    return [
        (name, column)
        for name, column in domain.places
        if name in tables
        and column in tables[name].columns
        and isinstance(tables[name].schema[column].dataType, T.StringType)
    ]


def _spelling_groups(
    tables: Tables, places: Sequence[tuple[str, str]], fixed: Sequence[str], collation: str
) -> DataFrame:
    # Counted per spelling before the collation is asked, so a hot value is one row by then.
    read = [
        tables[name].select(F.col(f"`{column}`").alias("spelling")).groupBy("spelling").agg(F.count(F.lit(1)).alias("n"))
        for name, column in places
    ]
    spelled = (
        reduce(DataFrame.unionAll, read)
        .where(F.col("spelling").isNotNull())
        .groupBy("spelling")
        .agg(F.sum("n").alias("total_rows"))
    )
    named = spelled.withColumn("is_fixed", F.lit(False))
    if fixed:
        literals = F.explode(F.array(*map(F.lit, fixed))).alias("spelling")
        extra = spelled.sparkSession.range(1).select(literals, F.lit(0).cast("bigint"), F.lit(True))
        named = named.unionAll(extra)
    key = F.collate("spelling", collation)
    least = F.coalesce(F.min(F.when(F.col("is_fixed"), F.col("spelling"))), F.min("spelling"))
    groups = named.groupBy(key.alias("key")).agg(least.alias("stored"))
    return spelled.join(groups, F.collate(spelled["spelling"], collation) == groups["key"]).select(
        "spelling", "stored", "total_rows"
    )


def key_spellings(
    tables: Tables, domains: Mapping[str, KeyDomain] = TEXT_KEYS, collation: str = COLLATION
) -> DataFrame:
    """``key_name, stored, spelling, total_rows``: every spelling of every key, and the one it is stored as.

    Stored is a fixed value of the key that is equal under the collation, else the smallest
    spelling in byte order, over all columns that share the key; upper case comes before lower
    case and plain letters before accented ones. NULL is no spelling. Tables and columns that
    are absent or not text are left out.
    """
    found = [
        _spelling_groups(tables, places, domain.fixed, collation).select(F.lit(name).alias("key_name"), "*")
        for name, domain in domains.items()
        if (places := _text_places(tables, domain))
    ]
    if not found:
        raise ValueError("no text column of these keys in the tables")
    return reduce(DataFrame.unionAll, found).select("key_name", "stored", "spelling", "total_rows")


def _respelled(df: DataFrame, column: str, changes: DataFrame) -> DataFrame:
    spelling, stored = "_spelling", "_stored"
    while {spelling, stored} & set(df.columns):
        spelling, stored = f"_{spelling}", f"_{stored}"
    renamed = changes.select(F.col("spelling").alias(spelling), F.col("stored").alias(stored))
    value = F.coalesce(F.col(stored), F.col(f"`{column}`")).alias(column)
    joined = df.join(renamed, df[f"`{column}`"] == renamed[spelling], "left")
    return joined.select(*(value if c == column else F.col(f"`{c}`") for c in df.columns))


def one_spelling(
    tables: Tables, domains: Mapping[str, KeyDomain] = TEXT_KEYS, collation: str = COLLATION
) -> dict[str, DataFrame]:
    """The tables with each text key in one spelling, as ``key_spellings`` chooses it.

    The spellings that change are written once to the shared folder. Where there are none, as a
    rule, the tables are returned as they are; else each key column costs one left join with
    the changes, which is broadcast only when the optimizer finds them small. Rows, columns and
    their order stay; NULL stays NULL. Use ``domains={**TEXT_KEYS, **ID_KEYS}`` for ids as
    well: that counts every id once, and ``materialize_tables`` then finds keys repeated in
    another case.
    """
    result = dict(tables)
    for name, domain in domains.items():
        places = _text_places(tables, domain)
        if not places:
            continue
        groups = _spelling_groups(tables, places, domain.fixed, collation)
        changes = staged(groups.where("spelling <> stored").select("spelling", "stored"), f"spellings-{name}")
        if changes.isEmpty():
            continue
        for table, column in places:
            result[table] = _respelled(result[table], column, changes)
    return result
