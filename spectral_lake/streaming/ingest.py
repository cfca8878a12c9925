"""Spectra files that arrive over time: running totals a pixel, and an append-only table of peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import storage
from ..sources.imzml import peaks

SCHEMA = "spectrum_idx bigint, x int, y int, z int, mzs array<double>, intensities array<double>"


def arriving(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def append_peaks(spectra: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each spectrum's peaks once, whichever batch brings it again; a batch that runs again replaces its own folder.

    The first batch that has a spectrum keeps it; within a batch the least by m/z, then by intensities.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != "spectrum_idx"]
        one = batch.groupBy("spectrum_idx").agg(F.min(F.struct("mzs", "intensities", *(c for c in rest if c not in ("mzs", "intensities")))).alias("s")).select("spectrum_idx", *(f"s.{c}" for c in rest))
        if storage.exists(spark, out):  # batches before this one, and not its own of a former try
            stored = spark.read.option("basePath", out).schema("spectrum_idx bigint, batch bigint").parquet(out).where(F.col("batch") < number)
            one = one.join(stored.select("spectrum_idx").distinct(), "spectrum_idx", "left_anti")
        peaks(one.select(batch.columns)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spectra.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def running_tic(spectra: DataFrame) -> DataFrame:
    """Total ion current of each pixel over all that has arrived."""
    tic = F.aggregate("intensities", F.lit(0.0), lambda a, v: a + v)
    return spectra.groupBy("x", "y", "z").agg(F.max_by(tic, F.col("spectrum_idx")).alias("tic"), F.count("*").alias("spectra"))
