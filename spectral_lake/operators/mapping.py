"""From peaks to axis places: the first axis value not below a peak's m/z, if close enough.

A peak beyond the last axis value is held against the last one.  Three plans, one result:
``map_exact`` for axes made of the same peaks (equality), ``map_vectorised`` for axes whose size
is checked, ``map_bucketed`` for any axis.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ResourceError
from . import balance

TOLERANCE = 1e-6
#: Axis values a task may hold: 8 MB of doubles.
MOST_SHIPPED = 1_000_000


def map_exact(peaks: DataFrame, axis: DataFrame, parts: int | None = None) -> DataFrame:
    """Equality join; the same as the rule if every peak's m/z is on the axis.

    ``parts`` (see ``balance.tasks``): partitions by m/z, else as many as the session has for any input. They are dealt
    by a digest, as a join on floating-point keys deals its input anew.
    """
    if not parts:
        return peaks.join(axis, "mz")
    own = peaks.withColumn("_key", F.xxhash64("mz")).repartition(parts, "_key").alias("p")
    a = axis.select("mz_idx", F.col("mz").alias("_mz"), F.xxhash64("mz").alias("_key")).alias("a")
    met = own.join(a, (F.col("p._key") == F.col("a._key")) & (F.col("mz") >= F.col("_mz")) & (F.col("mz") <= F.col("_mz")))
    return met.select("mz", *[F.col(f"p.`{c}`") for c in peaks.columns if c != "mz"], "mz_idx")


def map_bucketed(peaks: DataFrame, axis: DataFrame, tolerance: float = TOLERANCE, width: float = 1e-3) -> DataFrame:
    """One equi-join on buckets of m/z, in which the axis is one row a bucket.

    A bucket's row lists the axis values that its peaks may find: its own, and those of the next
    bucket within the tolerance of the edge.  Each peak meets one row and picks the first value
    that is near enough, so that peaks are shuffled once and equal ones stay as many as they are.
    """
    if width < tolerance:
        raise ValueError("a bucket must be at least as wide as the tolerance")
    bucket = F.floor(F.col("mz") / width)
    reach = F.array(bucket, F.floor((F.col("mz") - tolerance) / width), bucket - 1)  # the last: rounding at an edge
    a = axis.select("mz_idx", "mz", F.explode(F.array_distinct(reach)).alias("bucket"))
    rows = a.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("mz", "mz_idx"))).alias("near"))
    last = axis.agg(F.max_by("mz_idx", F.struct("mz", -F.col("mz_idx"))).alias("last_idx"), F.max("mz").alias("top"))  # one row
    p = peaks.withColumn("bucket", bucket).join(rows, "bucket", "left").crossJoin(F.broadcast(last))
    first = F.get(F.filter("near", lambda c: (c["mz"] >= F.col("mz")) & (c["mz"] - F.col("mz") <= tolerance)), 0)["mz_idx"]
    tail = F.when((F.col("mz") > F.col("top")) & (F.col("mz") - F.col("top") <= tolerance), F.col("last_idx"))
    return p.withColumn("mz_idx", F.coalesce(first, tail)).where("mz_idx is not null").select(*peaks.columns, "mz_idx")


def map_vectorised(peaks: DataFrame, axis: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Binary search in the axis, which each task holds; larger axes go to ``map_bucketed``."""
    held = axis.select("mz_idx", "mz").limit(MOST_SHIPPED + 1).toPandas()  # the axis is computed once
    if len(held) > MOST_SHIPPED:
        return map_bucketed(peaks, axis, tolerance)
    shared = peaks.sparkSession.sparkContext.broadcast(held.sort_values("mz_idx")["mz"].to_numpy(float))

    @F.pandas_udf("bigint")
    def place(mz: pd.Series) -> pd.Series:
        values, wanted = shared.value, mz.to_numpy(float)
        if not len(values):
            return pd.Series([-1] * len(mz))
        i = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        return pd.Series(np.where(np.abs(values[i] - wanted) <= tolerance, i, -1))

    return peaks.withColumn("mz_idx", place("mz")).where("mz_idx >= 0")


def map_next(peaks: DataFrame, axis: DataFrame) -> DataFrame:
    """The first value of an ascending axis not below a peak's m/z, however far; peaks beyond the last are left out.

    Binary search in the axis, which each task holds; larger axes go to ``map_next_bucketed``.
    """
    held = axis.select("mz_idx", "mz").limit(MOST_SHIPPED + 1).toPandas()
    if len(held) > MOST_SHIPPED:
        return map_next_bucketed(peaks, axis)
    shared = peaks.sparkSession.sparkContext.broadcast(held.sort_values("mz_idx")["mz"].to_numpy(float))

    @F.pandas_udf("bigint")
    def place(mz: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, mz.to_numpy(float)))

    return peaks.withColumn("mz_idx", place("mz")).where(F.col("mz_idx") < len(held))


def map_next_bucketed(peaks: DataFrame, axis: DataFrame, width: float = 1e-3) -> DataFrame:
    """The same for an axis of any size: a peak's place is how many axis values are below it.

    These are those of lesser buckets, by prefix sums over the buckets of axis and peaks, and the lesser ones of its own bucket.
    """
    bucket = F.floor(F.col("mz") / width)
    own = axis.groupBy(bucket.alias("bucket")).agg(F.collect_list("mz").alias("near"))
    every = own.select("bucket", F.size("near").alias("n")).union(peaks.select(bucket.alias("bucket"), F.lit(0).alias("n")).distinct())
    below = balance.prefix_sums(every.groupBy("bucket").agg(F.sum("n").alias("n")), "bucket", F.col("n"))
    rows = below.join(own, "bucket", "left").select("bucket", "before", "near")
    total = axis.agg(F.count("*").alias("_total"))  # one row
    p = peaks.withColumn("bucket", bucket).join(rows, "bucket").crossJoin(F.broadcast(total))
    lesser = F.coalesce(F.size(F.filter("near", lambda v: v < F.col("mz"))), F.lit(0))
    return p.withColumn("mz_idx", F.col("before") + F.when(F.col("near").isNull(), 0).otherwise(lesser)).where("mz_idx < _total").select(*peaks.columns, "mz_idx")


def dense(mapped: DataFrame, size: int) -> DataFrame:
    """(spectrum_idx, intensities): an array over the whole axis of ``size``, 0 where nothing is; the last peak of a place stays.

    A row is as long as the axis: one of over ``MOST_SHIPPED`` values is refused, and the sparse matrix is the way.
    """
    if size > MOST_SHIPPED:
        raise ResourceError(f"a dense row would have {size} values, more than {MOST_SHIPPED}")
    last = mapped.groupBy("spectrum_idx", "mz_idx").agg(F.max_by("intensity", "peak_pos").alias("v"))
    per = last.groupBy("spectrum_idx").agg(F.map_from_entries(F.collect_list(F.struct("mz_idx", "v"))).alias("m"))
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))
    return per.select("spectrum_idx", F.transform(places, lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("intensities"))


def dropped(peaks: DataFrame, mapped: DataFrame) -> DataFrame:
    """Peaks that found no place on the axis."""
    return peaks.join(mapped.select("spectrum_idx", "peak_pos"), ["spectrum_idx", "peak_pos"], "left_anti")
