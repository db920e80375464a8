"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with at least this many rows counts as hot, if it is among the MAX_HOT keys with most rows.
HOT_ROWS = 100_000
#: Hot keys that are broadcast at most. A key beyond them has less than 1 / MAX_HOT of all rows.
MAX_HOT = 10_000


def hot_keys(stats: DataFrame, key: str, count: str, hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """The ``max_hot`` rows of ``stats`` with most rows, of those with ``hot_rows`` or more."""
    return stats.where(F.col(count) >= hot_rows).orderBy(F.desc(count), key).limit(max_hot)


def count_join(rows: DataFrame, stats: DataFrame, key: str, count: str, spread: Column, hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """Inner join of ``rows`` with one ``stats`` row per ``key`` without moving hot keys.

    ``stats[count]`` is the number of ``rows`` of the key. The ``max_hot`` keys with most rows, of those with
    ``hot_rows`` or more, are broadcast, a number that does not grow with the data; their rows meet the broadcast copy in
    place, and pass the shuffle join under a salted key (``spread``) that matches nothing. Every other key goes through
    that join; it has fewer than ``hot_rows`` rows or less than 1 / ``max_hot`` of all, and what that leaves
    uneven on a large cluster is split by the adaptive skew join (the side of ``rows`` is the outer one).
    Rows with a null key match nothing and are dropped, as in any inner join.
    """
    cols = [c for c in stats.columns if c != key]
    hot = hot_keys(stats, key, count, hot_rows, max_hot).select(F.col(key).alias("_hk"), F.struct(*cols).alias("_hs"))
    cold = stats.select(F.lit(0).alias("_salt"), F.col(key).alias("_ck"), F.struct(*cols).alias("_cs"))
    marked = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    marked = marked.withColumn("_s", F.when(F.col("_hk").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int") + 1))
    joined = marked.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_s") == F.col("_salt")), "left")
    got = F.coalesce("_hs", "_cs")
    return joined.where(got.isNotNull()).select(*rows.columns, *[got[c].alias(c) for c in cols])


def sized_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is (a shuffle join).

    The size is checked by a count that stops after ``max_rows`` + 1 rows.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


def fits(df: DataFrame, max_rows: int) -> bool:
    """Has ``df`` at most ``max_rows`` rows? Counting stops after one more."""
    return df.limit(max_rows + 1).count() <= max_rows
