"""Running totals over long groups, worked out in stretches so that no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of one stretch.
STRETCH = 2_000


def running_total(df: DataFrame, group: str, order: str, value: Column, name: str, stretch: int = STRETCH) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of its group up to and with the row, by ``order``.

    ``order`` must be a non-negative integer, unique in its group. Totals of each stretch of ``order`` values are
    combined first; their running sum (one row per stretch) is added to the sum inside the stretch.
    """
    # placed once; sums, windows and the join below keep this placement
    rows = df.withColumn("_v", value).withColumn("_cut", F.floor(F.col(order) / stretch)).repartition(group, "_cut")
    sums = rows.groupBy(group, "_cut").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col("_cut").alias("_c"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_cut").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("_here", F.sum("_v").over(inside)).join(sums, (F.col(group) == F.col("_g")) & (F.col("_cut") == F.col("_c")))
    return joined.withColumn(name, F.col("_here") + F.col("_before")).select(*df.columns, name)


def next_value(df: DataFrame, group: str, order: str, value: Column, name: str, stretch: int = STRETCH) -> DataFrame:
    """``df`` with ``name``: the first ``value`` that is not null in the rows of its group after the row, by ``order``.

    Worked out inside stretches of ``order`` values, as in ``running_total``; what a stretch does not hold comes from the
    first values of the stretches, one row each.
    """
    rows = df.withColumn("_v", value).withColumn("_cut", F.floor(F.col(order) / stretch)).repartition(group, "_cut")
    back = Window.partitionBy(group, "_cut").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.where("_v is not null").groupBy(group, "_cut").agg(F.min_by("_v", order).alias("_f"))
    every = rows.select(group, "_cut").distinct().join(firsts, [group, "_cut"], "left")
    later = Window.partitionBy(group).orderBy(F.desc("_cut")).rowsBetween(Window.unboundedPreceding, -1)
    every = every.select(F.col(group).alias("_g"), F.col("_cut").alias("_c"), F.last("_f", ignorenulls=True).over(later).alias("_later"))
    joined = rows.withColumn("_here", F.last("_v", ignorenulls=True).over(back)).join(every, (F.col(group) == F.col("_g")) & (F.col("_cut") == F.col("_c")))
    return joined.withColumn(name, F.coalesce("_here", "_later")).select(*df.columns, name)


def numbered(df: DataFrame, group: str, part: str, order: list, name: str, stretch: int = STRETCH) -> DataFrame:
    """``df`` with ``name``: rows of each group counted from 0 by ``part`` (a non-negative integer, such as the page) and ``order``.

    Rows are counted inside each part; the rows of the parts before it come from a running total with one row per part.
    """
    inside = Window.partitionBy(group, part).orderBy(*order)
    sizes = running_total(df.groupBy(group, part).agg(F.count("*").alias("_n")), group, part, F.col("_n"), "_upto", stretch)
    before = sizes.select(group, part, (F.col("_upto") - F.col("_n")).alias("_before"))
    return df.withColumn("_at", F.row_number().over(inside) - 1).join(before, [group, part]).withColumn(name, (F.col("_at") + F.col("_before")).cast("int")).select(*df.columns, name)
