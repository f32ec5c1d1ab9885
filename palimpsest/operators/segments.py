"""Ordered scans whose groups may be too large for one task.

A plain window function hands each group to one task. Here a group is cut into blocks (say, by week); each block is
scanned on its own, a row per block carries the block's last value on, and only these rows are scanned by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_last(df: DataFrame, keys: list[str], block: str, order: str, value: Column, out: str) -> DataFrame:
    """Adds ``out``: the last value that isn't null of the rows before this one, by ``order`` within ``keys``.

    ``block`` must not fall while ``order`` rises. Keys, block and order must not be null; rows of equal order
    within a group have no defined order among themselves, so make it unique first.
    """
    df = df.withColumn("_value", value)
    before = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*keys, block).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, block, F.last("_last", True).over(earlier).alias("_carried"))
    return (
        df.withColumn(out, F.last("_value", True).over(before))
        .join(carried, [*keys, block], "left")
        .withColumn(out, F.coalesce(out, "_carried"))
        .drop("_value", "_carried")
    )


def carry_next(df: DataFrame, keys: list[str], block: str, order: str, value: Column, out: str) -> DataFrame:
    """As carry_last, of the rows after this one."""
    turned = df.withColumns({"_block": -F.col(block), "_order": -F.col(order)})
    return carry_last(turned, keys, "_block", "_order", value, out).drop("_block", "_order")


def ranked(df: DataFrame, keys: list[str], block: str, order: list[str], out: str = "rank") -> DataFrame:
    """Adds ``out``: the row's number from 1 within ``keys`` by ``block`` and then ``order``; blocks are numbered on their own."""
    within = F.row_number().over(Window.partitionBy(*keys, block).orderBy(*order))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*keys, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return df.withColumn(out, within).join(offsets, [*keys, block]).withColumn(out, (F.col(out) + F.col("_offset")).cast("bigint")).drop("_offset")


def running_sum(df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows up to this one, by ``block`` and then ``order``."""
    df = df.withColumn("_value", value)
    upto = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, block).agg(F.sum("_value").alias("_s"))
    offsets = sums.select(*keys, block, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))
    return df.withColumn(out, F.sum("_value").over(upto)).join(offsets, [*keys, block]).withColumn(out, F.col(out) + F.col("_offset")).drop("_value", "_offset")


def value_at(df: DataFrame, keys: list[str], value: str, width: float, ranks: dict[str, Column]) -> DataFrame:
    """Values at places of each group's ascending order: keys, n, and a column for each of ``ranks`` (0-based, from column n).

    Equal values are counted first, counts are summed in bins of ``width``, so no group is sorted in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_bin", F.floor(F.col(value) / width))
    upto = running_sum(counts, keys, "_bin", [value], F.col("_c"), "_upto")
    n = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    at = upto.join(n, keys).withColumn("_from", F.col("_upto") - F.col("_c"))
    found = [F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_upto")), F.col(value))).alias(name) for name, rank in ranks.items()]
    return at.groupBy(*keys).agg(F.max("n").alias("n"), *found)


def exact_median(df: DataFrame, keys: list[str], value: str, width: float, out: str = "median") -> DataFrame:
    """Median of each group, the mean of the two middle values: keys, n, ``out``."""
    n = F.col("n")
    found = value_at(df, keys, value, width, {"_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2)})
    return found.select(*keys, "n", ((F.col("_low") + F.col("_high")) / 2).alias(out))
