"""The lake's tables with its matrices and images as Zarr arrays beside them, under the names of their elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.registry import register_converter
from . import lake, zarr_v2


@register_converter("zarr")
def write(path: str, matrix: DataFrame, obs: DataFrame, var: DataFrame, tic: DataFrame, shapes: DataFrame, spectrum: DataFrame, attrs: DataFrame, metadata: DataFrame | None = None) -> None:
    """The folder that ``lake.write`` makes, and in it ``tables/{id}/X`` as compressed sparse rows and ``images/{id}_tic``.

    A sliced volume has one of each for every slice, ``{id}_z{k}``, with the slice's pixels as rows.  Arrays are made
    from the tables as stored, so that nothing is computed again.
    """
    spark = matrix.sparkSession
    lake.write(path, matrix, obs, var, tic, shapes, spectrum, attrs, metadata)
    told = lake.attributes(spark, path)
    (nx, ny, nz), name = told["dimensions_xyz"], told["dataset_id"]
    cells, image, columns = spark.read.parquet(f"{path}/X"), spark.read.parquet(f"{path}/tic"), spark.read.parquet(f"{path}/var").count()
    if "slice_id" not in cells.columns and "slice_id" not in image.columns:
        zarr_v2.write_csr(cells, f"{path}/tables/{name}/X", (nx * ny * nz, columns))
        zarr_v2.write_image(image, f"{path}/images/{name}_tic", (nz, ny, nx))
        return
    for z in range(nz):  # a slice's files only are read for it
        own = F.col("slice_id") == f"{name}_z{z}"
        of = cells.where(own).withColumn("pixel_idx", F.col("pixel_idx") - z * nx * ny)
        zarr_v2.write_csr(of, f"{path}/tables/{name}_z{z}/X", (nx * ny, columns))
        zarr_v2.write_image(image.where(own).withColumn("z", F.lit(0)), f"{path}/images/{name}_z{z}_tic", (1, ny, nx))
