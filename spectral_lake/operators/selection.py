"""Which frames and spectra take part: predicates and ranges that readers and queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Peaks that a frame may hold: what its counter in the database can say.
MOST_PEAKS = 65_535
#: The predicate in the words of any SQL.
VALID = f"{{0}} > 0 AND {{0}} <= {MOST_PEAKS}"


def valid_frames(frames: DataFrame, column: str = "num_peaks") -> DataFrame:
    """Frames that hold a spectrum of a possible size; a null count is none."""
    return frames.where(VALID.format(f"`{column}`"))


def frames_between(frames: DataFrame, first: int, last: int, column: str = "frame") -> DataFrame:
    """Frames from ``first`` to ``last``, both included."""
    return frames.where(F.col(column).between(first, last))


def id_range(frames: DataFrame, column: str = "frame_id") -> DataFrame:
    """(first_id, last_id, n) of all frames, one row; nulls and 0 without any."""
    return frames.agg(F.min(column).alias("first_id"), F.max(column).alias("last_id"), F.count("*").alias("n"))


def with_peaks(spectra: DataFrame, peaks: DataFrame, spectrum: str, peak: str) -> DataFrame:
    """Spectra that have a peak."""
    return spectra.join(peaks.select(F.col(peak).alias("_peak")), F.col(spectrum) == F.col("_peak"), "left_semi")


def without_peaks(spectra: DataFrame, peaks: DataFrame, spectrum: str, peak: str) -> DataFrame:
    """Spectra that have none: they are skipped, and counted as empty."""
    return spectra.join(peaks.select(F.col(peak).alias("_peak")), F.col(spectrum) == F.col("_peak"), "left_anti")


def peak_range(peaks: DataFrame) -> DataFrame:
    """(mz_min, mz_max) over every peak, one row: exact, where ``metadata.mass_range`` looks at five spectra."""
    return peaks.agg(F.min("mz").alias("mz_min"), F.max("mz").alias("mz_max"))


def laser_count(laser: DataFrame) -> DataFrame:
    """(n, is_maldi): laser rows, and whether there are any."""
    return laser.agg(F.count("*").alias("n"), (F.count("*") > 0).alias("is_maldi"))


def laser_spots(laser: DataFrame) -> DataFrame:
    """Place and beam of every laser row."""
    return laser.select("id", "spot_x", "spot_y", "beam_x", "beam_y")
