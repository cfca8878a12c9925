"""Acquisition metadata: dimensions, ranges, key-value tables, memory models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GIB, MIB = 1024.0**3, 1024.0**2


def grid_dimensions(coords: DataFrame) -> DataFrame:
    """Largest 1-based coordinate of each axis: the grid starts at 1 whatever the least is."""
    return coords.agg(*[F.max(c).cast("bigint").alias(f"n{c}") for c in "xyz"])


def coord_bounds(coords: DataFrame) -> DataFrame:
    return coords.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])


def sample_positions(n: int) -> list[int]:
    return sorted({0, n // 4, n // 2, 3 * n // 4, n - 1}) if n > 0 else []


def mass_range(spectra: DataFrame, positions: list[int] | None = None) -> DataFrame:
    """Least and greatest m/z, of all spectra or of some; (0, 1000) if there is none."""
    if positions is not None:
        spectra = spectra.where(F.col("spectrum_idx").isin(positions))
    lo, hi = F.min(F.array_min("mzs")), F.max(F.array_max("mzs"))
    return spectra.agg(F.coalesce(lo, F.lit(0.0)).alias("mz_min"), F.coalesce(hi, F.lit(1000.0)).alias("mz_max"))


def frame_stats(frames: DataFrame, x: str, y: str) -> DataFrame:
    return frames.agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"), F.count("*").alias("n"))


def frame_dimensions(stats: DataFrame) -> DataFrame:
    """From inclusive bounds; at least 1 by 1, always one slice."""
    side = lambda a, b: F.greatest((F.col(b) - F.col(a)).cast("bigint") + 1, F.lit(1)).cast("bigint")
    return stats.select(side("min_x", "max_x").alias("nx"), side("min_y", "max_y").alias("ny"), F.lit(1).cast("bigint").alias("nz"))


def pivot_keys(pairs: DataFrame, keys: dict[str, str], kind: str = "string") -> DataFrame:
    """One row with a column for each wanted key of ``pairs(key, value)``; null where it is missing."""
    wanted = pairs.where(F.col("key").isin(list(keys)))
    return wanted.agg(*[F.max(F.when(F.col("key") == k, F.col("value").cast(kind))).alias(name) for k, name in keys.items()])


def renamed_keys(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.replace(F.lower("key"), F.lit(" "), F.lit("_")).alias("key"), "value")


def memory_gb(n: Column, peaks: int) -> Column:
    """Two arrays of doubles for each spectrum."""
    return F.when(n > 0, n * peaks * 2 * 8 / GIB).otherwise(0.0)


def memory_model(n: Column, peaks: Column, axis: Column) -> dict[str, Column]:
    """MB of raw peaks, axis, sparse matrix at a fill of a tenth, coordinates, overhead, and all of it."""
    raw = n * peaks * 12 / MIB
    parts = {"raw_mb": raw, "axis_mb": axis * 8 / MIB, "sparse_mb": n * axis * F.lit(0.1).cast("double") * 4 / MIB, "coords_mb": n * 12 / MIB, "overhead_mb": F.greatest(F.lit(100.0), raw * F.lit(0.1).cast("double"))}
    total = None
    for c in parts.values():
        total = c if total is None else total + c
    return parts | {"total_mb": total}


def batch_size(target_mb: Column, item_mb: Column, least: int, most: int, total: Column) -> Column:
    return F.least(F.greatest(F.least(F.floor(target_mb / item_mb).cast("bigint"), F.lit(most)), F.lit(least)), total)


def batch_size_by_peaks(target_mb: Column, peaks: Column, total: Column) -> Column:
    """Spectra of 12 bytes a peak that ``target_mb`` holds, between 10 and 1000."""
    return F.greatest(F.lit(10), F.least(F.floor(target_mb * MIB / (peaks * 12)).cast("bigint"), total, F.lit(1000)))


def consecutive_ranges(ids: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(first_id, last_id, n) of each run of consecutive ``ids(id)``.

    A run starts where id - 1 is missing and ends where id + 1 is; starts and ends pair up in
    order, bucket by bucket, so no task sees all ids.
    """
    i = ids.select("id").distinct()
    less, more = i.select((F.col("id") + 1).alias("id")), i.select((F.col("id") - 1).alias("id"))
    starts, ends = i.join(less, "id", "left_anti"), i.join(more, "id", "left_anti")
    return _numbered(starts, width).withColumnRenamed("id", "first_id").join(_numbered(ends, width).withColumnRenamed("id", "last_id"), "k").select("first_id", "last_id", (F.col("last_id") - F.col("first_id") + 1).alias("n"))


def _numbered(ids: DataFrame, width: int) -> DataFrame:
    b = ids.withColumn("bucket", F.floor(F.col("id") / width))
    per = b.groupBy("bucket").agg(F.count("*").alias("c")).select("bucket", F.coalesce(F.sum("c").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    return b.join(per, "bucket").select("id", (F.row_number().over(W.partitionBy("bucket").orderBy("id")) + F.col("o")).alias("k"))


def batches(n: int, size: int) -> list[tuple[int, int, int]]:
    """(batch, first, last) of ``n`` items dealt in order."""
    return [(i, i * size, min(n, (i + 1) * size) - 1) for i in range(-(-n // size))]
