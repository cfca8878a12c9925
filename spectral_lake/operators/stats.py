"""Totals, averages, counts and ion images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matrix import assemble, last_in_spectrum


def tic_of_spectra(peaks: DataFrame, keys: tuple[str, ...] = ("spectrum_idx",)) -> DataFrame:
    """Sum of all intensities of a spectrum, mapped or not."""
    return peaks.groupBy(*keys).agg(F.sum("intensity").alias("tic"))


def last_tic(tic: DataFrame) -> DataFrame:
    """Of several spectra on a pixel the last one's total stays."""
    return tic.groupBy("pixel_idx").agg(F.max_by("tic", "spectrum_idx").alias("tic"), F.max("spectrum_idx").alias("spectrum_idx"))


def total_spectrum(mapped: DataFrame, axis: DataFrame) -> DataFrame:
    """Sum over spectra at each axis place; in a spectrum the last peak of a place counts."""
    sums = last_in_spectrum(mapped).groupBy("mz_idx").agg(F.sum("intensity").alias("total"))
    return axis.join(sums, "mz_idx", "left").select("mz_idx", "mz", F.coalesce("total", F.lit(0.0)).alias("total"))


def average_spectrum(total: DataFrame, n_spectra: DataFrame) -> DataFrame:
    """``total`` over the count in ``n_spectra(n)``, one row; a count of 0 leaves the total."""
    out = total.crossJoin(F.broadcast(n_spectra))
    return out.select("mz_idx", "mz", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(F.col("total")).alias("average"))


def tic_of_matrix(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("pixel_idx").agg(F.sum("intensity").alias("tic"))


def nearest_place(axis: DataFrame, target: float, tolerance: float) -> DataFrame:
    """The axis place nearest to ``target``, the first of equals; none if it is too far."""
    return axis.orderBy(F.abs(F.col("mz") - target), "mz_idx").limit(1).where(F.abs(F.col("mz") - target) <= tolerance)


def ion_image(matrix: DataFrame, axis: DataFrame, grid: DataFrame, target: float, tolerance: float) -> DataFrame:
    """Intensity at the place nearest to ``target`` for every pixel of ``grid``."""
    own = matrix.join(F.broadcast(nearest_place(axis, target, tolerance)), "mz_idx").select("pixel_idx", "intensity")
    return grid.join(own, "pixel_idx", "left").select(*grid.columns, F.coalesce("intensity", F.lit(0.0)).alias("value"))


def ion_image_of_peaks(mapped: DataFrame, axis: DataFrame, grid: DataFrame, target: float, tolerance: float) -> DataFrame:
    """``ion_image`` without a matrix: last write wins cell by cell, so one place's peaks are enough."""
    place = nearest_place(axis, target, tolerance).select("mz_idx")
    return ion_image(assemble(mapped.join(F.broadcast(place), "mz_idx", "left_semi")), axis, grid, target, tolerance)


def covered(frames: DataFrame, cached: str) -> DataFrame:
    """Frames, those whose ``cached`` column is known, and their share in percent."""
    return frames.agg(F.count("*").alias("total"), F.count(cached).alias("cached"), (F.count(cached) * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias("percent"))


def coverage(grid_tic: DataFrame) -> DataFrame:
    """Pixels, pixels with signal and their share in percent."""
    n, full = F.count("*"), F.count_if(F.col("value") > 0)
    return grid_tic.agg(n.alias("pixels"), full.alias("non_empty"), (full * 100.0 / F.greatest(n, F.lit(1))).alias("percent"))


def slice_membership(spectra: DataFrame, known: Column) -> DataFrame:
    """One row: spectra and their total current, of all and of those in a ``known`` slice.  Means are over all: a spectrum of no slice counts."""
    own = F.when(known, F.col("tic"))
    return spectra.agg(F.count("*").alias("spectra"), F.count_if(known).alias("in_slices"), F.sum("tic").alias("total"), F.coalesce(F.sum(own), F.lit(0.0)).alias("in_slices_total"))
