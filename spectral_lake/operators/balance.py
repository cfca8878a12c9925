"""Prefix sums over an ordered key, and cuts of it into stretches of equal weight."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a task sorts, about: some 20 MB of five numbers each.
ROWS_A_TASK = 1 << 18


def tasks(spark: SparkSession, rows: int) -> int:
    """Into how many partitions to deal ``rows``, so that a task's share does not grow with them; a task for each core at least."""
    return max(ceil(rows / ROWS_A_TASK), spark.sparkContext.defaultParallelism)


def prefix_sums(df: DataFrame, key: str, weight: Column, width: int = 4096, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``weight`` over all lesser keys; keys are distinct whole numbers.

    Two levels: sums of blocks of ``width`` keys, themselves summed up in order (one row a block), and
    windows within blocks.  No task sees all rows.  A null weight counts 0.
    """
    d = df.withColumn("_w", F.coalesce(weight.cast("bigint"), F.lit(0).cast("bigint"))).withColumn("_block", F.floor(F.col(key) / width))
    blocks = d.groupBy("_block").agg(F.sum("_w").alias("_sum"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_w").over(W.partitionBy("_block").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_in", inside).join(blocks, "_block").withColumn(name, F.col("_base") + F.col("_in")).select(*df.columns, name)


def balanced(df: DataFrame, key: str, weight: Column, parts: int, width: int = 4096) -> DataFrame:
    """``df`` with ``part``: stretches of ascending keys, of near equal weight.

    A row goes to the part that holds the middle of its weight, so that a part weighs at most the mean and the
    heaviest row together.  Rows without weight go with their neighbours; without any weight all go to part 0.
    """
    d = prefix_sums(df.withColumn("_weight", F.coalesce(weight.cast("bigint"), F.lit(0).cast("bigint"))), key, F.col("_weight"), width, "_before")
    total = df.agg(F.coalesce(F.sum(weight.cast("bigint")), F.lit(0)).alias("_total"))  # one row
    middle = (2 * F.col("_before") + F.col("_weight")).cast("decimal(20,0)") * F.lit(parts).cast("decimal(10,0)")
    place = F.call_function("div", middle, F.nullif(2 * F.col("_total"), F.lit(0).cast("bigint")).cast("decimal(20,0)"))
    part = F.least(F.coalesce(place, F.lit(0).cast("bigint")), F.lit(parts - 1).cast("bigint"))
    return d.crossJoin(F.broadcast(total)).withColumn("part", part).select(*df.columns, "part")


def cuts(df: DataFrame, key: str, weight: Column, parts: int, width: int = 4096) -> DataFrame:
    """(part, first, last, n, weight) of the parts that have rows: at most ``parts`` of them."""
    b = balanced(df.withColumn("_own", F.coalesce(weight.cast("bigint"), F.lit(0).cast("bigint"))), key, F.col("_own"), parts, width)
    return b.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"), F.sum("_own").alias("weight"))
