"""Bit filters of fixed size: they tell in place which rows cannot have a partner, whatever the number of keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Bits of one row of the bitmap functions.
ROW_BITS = 32_768


def bit_filter(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """One bit per value of the lowest ``bits`` bits of the bigint column ``key``, packed into bytes: does any key have it?

    At most 2 ** bits / 32768 rows of 4 KB reach the driver, however many keys there are; they are combined before and
    in the shuffle. More keys only make the filter let more rows pass (see ``passes``).
    """
    at = keys.where(F.col(key).isNotNull()).select(F.col(key).bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    row = F.floor(F.col("at") / ROW_BITS)
    rows = at.groupBy(row.alias("row")).agg(F.bitmap_construct_agg(F.col("at") % ROW_BITS).alias("bitmap")).collect()
    out = np.zeros(max(1 << bits, ROW_BITS) // 8, np.uint8)
    for r in rows:
        start = int(r["row"]) * ROW_BITS // 8
        out[start : start + ROW_BITS // 8] = np.frombuffer(bytes(r["bitmap"]), np.uint8)
    return out


def passes(packed: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which of the int64 ``keys`` may be among those that the filter was made of; false only for those that are not."""
    at = keys & ((1 << bits) - 1)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


#: Bits of the filters that set rows apart (8 MB).
APART_BITS = 26


def set_apart(rows: DataFrame, key: Column, keys: DataFrame, bits: int = APART_BITS) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` (bigint) may be one of ``keys`` (one column), and the rows with whose key that cannot be.

    The second part needs neither a shuffle nor a join to know that it has no partner; only the keys of the rows go to Python.
    """
    name = keys.columns[0]
    packed = rows.sparkSession.sparkContext.broadcast(bit_filter(keys, name, bits))

    @F.pandas_udf(BooleanType())
    def may(k: pd.Series) -> pd.Series:
        return pd.Series(passes(packed.value, k.to_numpy(), bits))

    marked = rows.withColumn("_may", may(key))
    return marked.where("_may").drop("_may"), marked.where("not _may").drop("_may")


def repeated_keys(rows: DataFrame, key: Column) -> DataFrame:
    """(key): the hashes that more than one row has; eight bytes a row are shuffled."""
    return rows.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")


def distinct_in_place(rows: DataFrame) -> DataFrame:
    """``rows.distinct()`` for rows of which few are repeated: only rows whose hash occurs twice are shuffled."""
    key = F.xxhash64(*rows.columns)
    twice, once = set_apart(rows, key, repeated_keys(rows, key))
    return once.unionAll(twice.distinct())
