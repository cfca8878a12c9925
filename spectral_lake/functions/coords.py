"""Pixel coordinates as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_based(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """File coordinates count from 1; z may be absent and is then 0."""
    return x - 1, y - 1, F.when(z > 0, z - 1).otherwise(0)


def normalised(x: Column, y: Column, frame: Column, off_x: Column, off_y: Column) -> tuple[Column, Column, Column]:
    """Frame coordinates less their offset; a frame without any lies on a line by its number."""
    missing = x.isNull()
    return F.when(missing, frame - 1).otherwise(x - off_x), F.when(missing, 0).otherwise(y - off_y), F.lit(0)


def pixel_index(x: Column, y: Column, z: Column, nx: Column | int, ny: Column | int) -> Column:
    nx, ny = _col(nx).cast("bigint"), _col(ny).cast("bigint")
    return (z * (nx * ny) + y * nx + x).cast("bigint")


def pixel_xyz(index: Column, nx: int, ny: int) -> tuple[Column, Column, Column]:
    cell = lambda c: F.floor(c).cast("bigint")
    return index % nx, cell(index / nx) % ny, cell(index / (nx * ny))


def physical(i: Column, pixel_size: float) -> Column:
    return i.cast("double") * F.lit(float(pixel_size))


def box(sx: Column, sy: Column, pixel_size: float) -> dict[str, Column]:
    half = pixel_size / 2
    return {"xmin": sx - half, "ymin": sy - half, "xmax": sx + half, "ymax": sy + half}


def box_wkt(b: dict[str, Column]) -> Column:
    point = lambda x, y: F.concat(b[x].cast("string"), F.lit(" "), b[y].cast("string"))
    ring = [("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"), ("xmax", "ymin")]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[point(x, y) for x, y in ring]), F.lit("))"))


def _col(v: Column | int) -> Column:
    return F.lit(v) if isinstance(v, int) else v
