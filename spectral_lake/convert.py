"""From an imaging file to a lake folder."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__, storage
from .config import SETTINGS
from .errors import ConfigurationError, DataError
from .functions import coords
from .operators import accounting, axis, extract, images, mapping, matrix, metadata, stats
from .progress import reported as progress_of
from .sinks import bundle, lake  # noqa: F401  (bundle registers its format)
from .sources import frames, imzml, registry
from .sources.decoding import CAUSES

log = logging.getLogger("spectral_lake")


def common_axis(spectra: DataFrame, continuous: bool = False) -> DataFrame:
    """The axis that all spectra share: that of the first one, or every distinct m/z."""
    return axis.continuous_axis(spectra) if continuous else axis.processed_axis(imzml.peaks(spectra.select("mzs", "intensities")))


def assemble(spectra: DataFrame, dims: tuple[int, int, int], dataset_id: str, pixel_size: float, handle_3d: bool = False, continuous: bool = False, common: DataFrame | None = None) -> dict[str, DataFrame]:
    """All output tables of ``spectra``; lazy.  Three of them read ``common``, the axis: give a stored one.

    A volume without ``handle_3d`` is a set of slices, whose average spectrum is the mean; else the
    total stands in its place.  Coordinates outside the grid are an error, not wrapped; only a slice that is
    not in it is left out of matrix and image, and its spectra count in totals and means.
    """
    nx, ny, nz = dims
    spark = spectra.sparkSession
    sliced = nz > 1 and not handle_3d
    inside = F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1) & (F.lit(sliced) | F.col("z").between(0, nz - 1))
    spectra = spectra.withColumn("pixel_idx", F.when(inside, coords.pixel_index(F.col("x"), F.col("y"), F.col("z"), nx, ny)).otherwise(F.raise_error(F.lit("a coordinate lies outside the grid")).cast("bigint")))
    peaks = imzml.peaks(spectra)
    common = common if common is not None else common_axis(spectra, continuous)
    mapped = mapping.map_bucketed(peaks, common) if continuous else mapping.map_exact(peaks, common)
    own = (lambda df: images.in_slices(df, nz)) if sliced else (lambda df: df)
    x = matrix.assemble(own(mapped))
    total = stats.total_spectrum(mapped, common)
    spectrum = stats.average_spectrum(total, spectra.agg(F.count("*").alias("n"))) if sliced else total.withColumnRenamed("total", "average")
    grid = images.grid(spark, nx, ny, nz)
    tic = stats.last_tic(own(spectra).select("pixel_idx", "spectrum_idx", F.aggregate("intensities", F.lit(0.0), lambda a, v: a + v).alias("tic")))
    tic = images.on_grid(grid, tic, F.col("tic"))
    obs = images.obs_slices(grid, dataset_id, pixel_size, nx) if sliced else images.obs_table(grid, dataset_id, pixel_size, nz)
    shapes = images.pixel_shapes(obs, pixel_size)
    if sliced:  # each slice is a table of its own, named {dataset_id}_z{k}
        name = lambda z: F.concat(F.lit(f"{dataset_id}_z"), z.cast("string"))
        x = x.withColumn("slice_id", name(F.floor(F.col("pixel_idx") / (nx * ny)).cast("bigint")))
        tic = tic.withColumn("slice_id", name(F.col("z")))
        shapes = images.pixel_shapes(obs, pixel_size, keys=("slice_id", "instance_id"))
    attrs = spectra.agg(F.count("*").alias("non_empty_pixels")).select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(nx * ny * nz).alias("total_grid_pixels"), "non_empty_pixels", F.array(*map(F.lit, dims)).alias("dimensions_xyz"),
        F.lit(pixel_size).alias("pixel_size_x_um"), F.lit(pixel_size).alias("pixel_size_y_um"), F.lit("micrometer").alias("pixel_size_units"), F.lit("physical_micrometers").alias("coordinate_system"),
        F.lit(__version__).alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created"), F.array(F.lit(dataset_id), F.lit("global")).alias("identity_transforms"),
    )
    return {"matrix": x, "obs": obs, "var": images.var_table(common), "tic": tic, "shapes": shapes, "spectrum": spectrum, "attrs": attrs}


def grid_of(spark: SparkSession, kind: str, source: str) -> tuple[int, int, int]:
    """Pixels of each axis, from the XML or the frame database: no spectrum is decoded for it."""
    if kind == "imzml":
        row = metadata.grid_dimensions(imzml.places(spark, source)).first()
    else:
        db = frames.database(source)
        places = frames.frames(spark, db, frames.offset(spark, db)).where("num_peaks > 0")
        row = None if places.isEmpty() else extract.dimensions_of_places(places).first()
    if row is None or row["nx"] is None:
        raise DataError(f"{source}: no spectra")
    if min(row) < 1:
        raise DataError(f"{source}: dimensions {tuple(row)} are not positive")
    return tuple(row)


def convert(
    spark: SparkSession, source: str, output: str, dataset_id: str = SETTINGS.dataset_id, pixel_size_um: float | None = None, handle_3d: bool = False, decode=None, output_format: str = SETTINGS.output_format, progress: Callable[[int, int], None] | None = None
) -> bool:
    """Convert ``source`` to the folder ``output``; True if it worked.  A given pixel size wins, 1.0 included.

    The folder appears when all of it is written; a conversion that fails leaves nothing, and can be
    tried again.  Each spectrum is decoded once, into the table ``spectra``; the axis is computed once;
    the rest is made from these.  Attributes tell how the pixel size was found, and how many spectra
    were read, empty or skipped and why; ``metadata`` lists what the file says of itself by section.
    ``progress`` is called with the tasks finished and known so far.
    """
    try:
        if not isinstance(dataset_id, str) or not dataset_id.strip():
            raise ConfigurationError("dataset_id is blank")
        if pixel_size_um is not None and pixel_size_um <= 0:
            raise ConfigurationError("the pixel size must be positive")
        with progress_of(spark, progress), storage.whole(spark, output) as stage:
            _convert(spark, source, stage, dataset_id, pixel_size_um, handle_3d, decode, output_format)
        return True
    except Exception:
        log.exception("conversion failed")
        return False


def _convert(spark: SparkSession, source: str, stage: str, dataset_id: str, pixel_size_um: float | None, handle_3d: bool, decode, output_format: str) -> None:
    kind, began = registry.detect(source), time.time()
    write, module = registry.converter(output_format), {"imzml": imzml, "frames": frames}.get(kind)
    dims = found = None
    if module is None:  # a reader that a user has registered: what it yields says all
        spectra = registry.reader(kind)(spark, source)
        spectra = spectra if "error" in spectra.columns else spectra.withColumn("error", F.lit(None).cast("string"))
    else:
        spectra = imzml.read(spark, source, keep_bad=True) if kind == "imzml" else frames.read(spark, source, decode, keep_bad=True)
        found = imzml.pixel_size(spark, source) if kind == "imzml" else frames.pixel_size(spark, frames.database(source))
        dims = grid_of(spark, kind, source)
    if pixel_size_um is None and found is None:
        raise ConfigurationError("the file states no pixel size; give one")
    size = float(pixel_size_um if pixel_size_um is not None else found[0])
    spectra, told = accounting.observed(spectra)
    spectra = lake.write_spectra(stage, accounting.usable(spectra))
    stats_of = told.get | {"seconds": round(time.time() - began, 3)}
    if skipped := {k: v for k, v in stats_of.items() if k in (*CAUSES, "other") and v}:
        log.warning("%s: %d of %d spectra were skipped: %s", source, sum(skipped.values()), stats_of["spectra"], skipped)
    if not stats_of["read"]:
        raise DataError(f"{source}: no spectrum with peaks could be read")
    if dims is None:
        dims = tuple(extract.dimensions_of_places(spectra).first())
    continuous = kind == "imzml" and imzml.mode(spark, source) == "continuous"
    common = lake.stored(f"{stage}/_axis", common_axis(spectra, continuous))
    tables = assemble(spectra, dims, dataset_id, size, handle_3d, continuous, common)
    known = [F.lit(v).cast("double") for v in (pixel_size_um, *(found or (None, None)))]
    detection = F.struct(*[c.alias(k) for k, c in extract.chosen_pixel_size(*known).items()])
    info = {"source": source, "kind": kind, "output_format": output_format, "handle_3d": handle_3d, "continuous": continuous}
    tables["attrs"] = tables["attrs"].withColumns({"pixel_size_detection": detection, "conversion_info": _struct(info), "processing_stats": _struct(stats_of)})
    write(stage, **tables, metadata=extract.nonempty(module.sections(spark, source)) if module else None)
    storage.remove(spark, f"{stage}/_axis")


def _struct(values: dict):
    return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])
