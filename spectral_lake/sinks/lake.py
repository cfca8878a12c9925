"""The primary output: a folder of Parquet tables with one JSON document of attributes."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..config import SETTINGS
from ..sources.registry import register_converter


def stored(path: str, df: DataFrame) -> DataFrame:
    """``df`` written once: what reads the result reads files."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_spectra(path: str, spectra: DataFrame) -> DataFrame:
    """Decoded spectra, written once: all other tables are made from what is read back."""
    return stored(f"{path}/spectra", spectra)


@register_converter("lake")
def write(path: str, matrix: DataFrame, obs: DataFrame, var: DataFrame, tic: DataFrame, shapes: DataFrame, spectrum: DataFrame, attrs: DataFrame, metadata: DataFrame | None = None, parts: int | None = None) -> None:
    """Fails if any table exists.  The matrix is range-partitioned by pixel and sorted in its files.

    Tables with a slice_id are partitioned by it: each slice is then a folder of its own.
    """
    n = parts or int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = {"X": matrix.repartitionByRange(n, "pixel_idx").sortWithinPartitions("pixel_idx", "mz_idx"), "obs": obs, "var": var, "tic": tic, "shapes": shapes, "average_spectrum": spectrum}
    if metadata is not None:
        tables["metadata"] = metadata
    for name, df in tables.items():
        to = df.write.partitionBy("slice_id") if "slice_id" in df.columns else df.write
        to.parquet(f"{path}/{name}")
    attrs.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(f"{path}/attrs")


def attributes(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/attrs").first()["value"])


def compact(path: str, out: str, tile: int = SETTINGS.tile, nx: int | None = None, rows: int = SETTINGS.rows_per_file) -> None:
    """The matrix again with pixels of one tile together, for reading small regions; ``nx`` is the attributes' if not given."""
    spark = SparkSession.active()
    width = nx or attributes(spark, path)["dimensions_xyz"][0]
    x = spark.read.parquet(f"{path}/X")
    place = (F.floor(F.floor(F.col("pixel_idx") / width) / tile), F.floor((F.col("pixel_idx") % width) / tile))
    ordered = x.repartitionByRange(*place, "pixel_idx").sortWithinPartitions(*place, "pixel_idx", "mz_idx")
    to = ordered.write.partitionBy("slice_id") if "slice_id" in x.columns else ordered.write
    to.option("maxRecordsPerFile", rows).parquet(out)


def optimise(path: str, tile: int = SETTINGS.tile, nx: int | None = None) -> bool:
    """``compact`` in place: the matrix stays as it was until the new one is whole.  False if it failed."""
    try:
        with storage.whole(SparkSession.active(), f"{path}/X", replace=True) as stage:
            compact(path, stage, tile, nx)
        return True
    except Exception:
        logging.getLogger("spectral_lake").exception("optimising failed")
        return False
