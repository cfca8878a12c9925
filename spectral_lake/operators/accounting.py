"""What became of each spectrum: read, empty, or skipped and why, with peaks; as a table or while a table is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.decoding import CAUSES


def outcome() -> Column:
    """``read``, ``empty`` (a list without values), or the cause before the colon of ``error``; another cause is ``other``."""
    cause = F.substring_index("error", ":", 1)
    skipped = F.when(cause.isin(*CAUSES), cause).otherwise("other")
    full = (F.size("mzs") > 0) & (F.size("intensities") > 0)
    return F.when(F.col("error").isNotNull(), skipped).when(F.coalesce(full, F.lit(False)), "read").otherwise("empty")


def usable(spectra: DataFrame) -> DataFrame:
    """Spectra that were read and have peaks, without ``error``."""
    return spectra.where("error is null and size(mzs) > 0 and size(intensities) > 0").drop("error")


def figures() -> list[Column]:
    """One aggregate a figure: spectra, each outcome, peaks, the most peaks of a spectrum."""
    peaks = F.when(outcome() == "read", F.size("mzs")).otherwise(0).cast("bigint")
    kinds = ("read", "empty", *CAUSES, "other")
    return [F.count(F.lit(1)).alias("spectra"), *(F.count_if(outcome() == k).alias(k) for k in kinds), F.coalesce(F.sum(peaks), F.lit(0)).cast("bigint").alias("peaks"), F.coalesce(F.max(peaks), F.lit(0)).cast("bigint").alias("most_peaks")]


def account(spectra: DataFrame) -> DataFrame:
    """One row of ``figures`` of ``spectra(mzs, intensities, error)``."""
    return spectra.agg(*figures())


def observed(spectra: DataFrame) -> tuple[DataFrame, Observation]:
    """``spectra``, and the figures that whatever reads them once will leave: no second pass."""
    told = Observation("spectra")
    return spectra.observe(told, *figures()), told
