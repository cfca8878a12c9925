"""The sparse pixel x m/z matrix: last write wins, rows on demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_in_spectrum(mapped: DataFrame) -> DataFrame:
    """One intensity for each (spectrum, place): that of the last peak."""
    keys = [c for c in ("spectrum_idx", "pixel_idx", "z") if c in mapped.columns]
    return mapped.groupBy(*keys, "mz_idx").agg(F.max_by("intensity", F.struct("peak_pos", "intensity")).alias("intensity"))


def assemble(mapped: DataFrame, positive_only: bool = False, parts: int | None = None) -> DataFrame:
    """(pixel_idx, mz_idx, intensity); of several writes to a cell the last spectrum's last peak stays.

    Zeros are not stored; ``positive_only`` leaves out negative intensities too, before any is written.
    ``parts`` (see ``balance.tasks``): partitions by pixel, in which cells are made and rows stay together.
    """
    if positive_only:
        mapped = mapped.where("intensity > 0")
    if parts:
        mapped = mapped.repartition(parts, "pixel_idx")
    cells = mapped.groupBy("pixel_idx", "mz_idx").agg(F.max_by("intensity", F.struct("spectrum_idx", "peak_pos", "intensity")).alias("intensity"))
    return cells.where("intensity <> 0")


def rows(matrix: DataFrame) -> DataFrame:
    """A row of the matrix as two arrays in m/z order."""
    cells = F.array_sort(F.collect_list(F.struct("mz_idx", "intensity")))
    return matrix.groupBy("pixel_idx").agg(cells.alias("c")).select("pixel_idx", F.col("c.mz_idx").alias("indices"), F.col("c.intensity").alias("data"))


def dense_row(matrix: DataFrame, axis: DataFrame, where: Column) -> DataFrame:
    """One pixel over the whole axis, 0 where it has nothing."""
    own = matrix.where(where).select("mz_idx", "intensity")
    return axis.join(own, "mz_idx", "left").select("mz_idx", "mz", F.coalesce("intensity", F.lit(0.0)).alias("intensity"))
