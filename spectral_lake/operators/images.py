"""The pixel grid and what is drawn on it.  Grids are generated; the matrix stays sparse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords


def grid(spark: SparkSession, nx: int, ny: int, nz: int = 1) -> DataFrame:
    if min(nx, ny, nz) <= 0:
        raise ValueError(f"Invalid dimensions: {(nx, ny, nz)}")
    x, y, z = coords.pixel_xyz(F.col("id"), nx, ny)
    return spark.range(nx * ny * nz).select(F.col("id").alias("pixel_idx"), x.alias("x"), y.alias("y"), z.alias("z"))


def on_grid(pixels: DataFrame, values: DataFrame, value: Column) -> DataFrame:
    """``value`` of ``values(pixel_idx, ...)`` on every pixel, 0 where there is none."""
    v = values.select("pixel_idx", value.alias("value"))
    return pixels.join(v, "pixel_idx", "left").select(*pixels.columns, F.coalesce("value", F.lit(0.0)).alias("value"))


def obs_table(pixels: DataFrame, dataset_id: str, pixel_size: float, nz: int = 1) -> DataFrame:
    """One row a pixel with its name, region and place in micrometres; a flat grid has z 0."""
    flat = nz == 1
    return pixels.select(
        F.col("pixel_idx").cast("string").alias("instance_id"),
        "x",
        "y",
        (F.lit(0).cast("bigint") if flat else F.col("z")).alias("z"),
        F.lit(f"{dataset_id}_pixels").alias("region"),
        coords.physical(F.col("x"), pixel_size).alias("spatial_x"),
        coords.physical(F.col("y"), pixel_size).alias("spatial_y"),
        (F.lit(0.0) if flat else coords.physical(F.col("z"), pixel_size)).alias("spatial_z"),
        F.col("pixel_idx").cast("string").alias("instance_key"),
    )


def obs_slices(pixels: DataFrame, dataset_id: str, pixel_size: float, nx: int) -> DataFrame:
    """The same, slice by slice: names count from 0 in each slice."""
    inside = F.col("y") * nx + F.col("x")
    name = F.concat(F.lit(f"{dataset_id}_z"), F.col("z").cast("string"))
    return pixels.select(
        name.alias("slice_id"),
        inside.cast("string").alias("instance_id"),
        F.col("x").cast("int").alias("x"),
        F.col("y").cast("int").alias("y"),
        F.concat(name, F.lit("_pixels")).alias("region"),
        coords.physical(F.col("x"), pixel_size).alias("spatial_x"),
        coords.physical(F.col("y"), pixel_size).alias("spatial_y"),
    )


def var_table(axis: DataFrame) -> DataFrame:
    return axis.select(F.concat(F.lit("mz_"), F.col("mz_idx").cast("string")).alias("mz_id"), "mz")


def pixel_shapes(obs: DataFrame, pixel_size: float, keys: tuple[str, ...] = ("instance_id",)) -> DataFrame:
    b = coords.box(F.col("spatial_x"), F.col("spatial_y"), pixel_size)
    return obs.select(*keys, *[c.alias(k) for k, c in b.items()], coords.box_wkt(b).alias("wkt"))


def tiles(pixels: DataFrame, height: int = 64, width: int = 64) -> DataFrame:
    """How many pixels fall in each storage tile."""
    cell = lambda c, n: F.floor(F.col(c) / n).cast("bigint")
    return pixels.groupBy("z", cell("y", height).alias("tile_y"), cell("x", width).alias("tile_x")).agg(F.count("*").alias("pixels"))


def in_slices(df: DataFrame, nz: int, z: str = "z") -> DataFrame:
    """Rows whose slice is one of ``nz``: others are in no slice's table, though sums over all spectra have them."""
    return df.where(F.col(z).between(0, nz - 1))
