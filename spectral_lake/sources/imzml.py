"""imzML: an XML file of spectra with the byte ranges of their arrays in a binary file beside it.

Header and places are read by Spark's own XML reader; spectra by the data source ``imzml``, whose
tasks read byte ranges of both files on any file system that they can reach.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..errors import FormatError
from ..operators import accounting, extract, metadata, ontology
from .accessions import BYTES, CONTINUOUS, INTENSITY, LENGTH, MZ, OFFSET, PIXEL_X, PIXEL_Y, PROCESSED, UUID, ZLIB, X, Y, Z  # noqa: F401
from .decoding import SCHEMA
from .imzml_source import register
from .registry import register_reader

_PARAM = "cvParam array<struct<_accession: string, _value: string>>"
_SPECTRUM = f"_index bigint, scanList struct<scan: array<struct<{_PARAM.replace(' ', ': ', 1)}>>>"


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def _value(params: Column, accession: str) -> Column:
    return F.element_at(F.filter(params, lambda p: p["_accession"] == accession), -1)["_value"]


def file_params(spark: SparkSession, path: str) -> DataFrame:
    """(seq, accession, value) of every parameter outside spectra: a bounded header."""
    raw = _xml(spark, path, "cvParam", "_accession string, _value string")
    return raw.select(F.monotonically_increasing_id().alias("seq"), F.col("_accession").alias("accession"), F.col("_value").alias("value"))


def mode(spark: SparkSession, path: str) -> str:
    """``continuous`` or ``processed``; exactly one must be stated."""
    found = {r[0] for r in file_params(spark, path).where(F.col("accession").isin(CONTINUOUS, PROCESSED)).select("accession").distinct().collect()}
    if len(found) != 1:
        raise FormatError(f"{path}: exactly one of continuous and processed must be stated")
    return "continuous" if found == {CONTINUOUS} else "processed"


def pixel_size(spark: SparkSession, path: str) -> tuple[float, float] | None:
    """Pixel size in micrometres, the last one stated; None without any."""
    p = file_params(spark, path).where(F.col("accession").isin(PIXEL_X, PIXEL_Y))
    row = p.agg(*[F.max_by(F.when(F.col("accession") == a, F.expr("try_cast(value as double)")), F.when(F.col("accession") == a, F.col("seq"))).alias(n) for n, a in (("x", PIXEL_X), ("y", PIXEL_Y))]).first()
    return None if row["x"] is None else (row["x"], row["y"] if row["y"] is not None else row["x"])


def _check_binary(path: str) -> None:
    if not storage.there(os.path.splitext(path)[0] + ".ibd"):
        raise FormatError(f"{path}: no .ibd file beside it")


def places(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z) of every spectrum, from 1, read from the XML alone."""
    s = _xml(spark, path, "spectrum", _SPECTRUM).select(F.flatten(F.transform("scanList.scan", lambda x: x["cvParam"])).alias("scan"))
    return s.select(*[F.coalesce(_value(F.col("scan"), a).cast("int"), F.lit(d)).alias(n) for n, a, d in (("x", X, 1), ("y", Y, 1), ("z", Z, 0))])


def scan(spark: SparkSession, path: str, schema: str = SCHEMA, **options: str) -> DataFrame:
    """``spectra`` with their ``error``, as the data source ``imzml`` reads them.

    A ``schema`` without arrays and error, and filters on places, keep the binary file closed.
    """
    register(spark)
    return spark.read.format("imzml").schema(schema).options(**options).load(path)


@register_reader("imzml", ".imzml", _check_binary)
def read(spark: SparkSession, path: str, keep_bad: bool = False, **options: str) -> DataFrame:
    """``spectra(spectrum_idx, x, y, z, mzs, intensities)`` with coordinates from 0.

    Unreadable spectra and those with an empty array are left out, or kept with their ``error``.
    Options are the data source's.
    """
    mode(spark, path)
    s = scan(spark, path, **options)
    return s if keep_bad else accounting.usable(s)


def peaks(spectra: DataFrame) -> DataFrame:
    """One row a peak, with its place in the spectrum."""
    keep = [c for c in spectra.columns if c not in ("mzs", "intensities")]
    return spectra.select(*keep, F.posexplode(F.arrays_zip("mzs", "intensities")).alias("peak_pos", "p")).select(*keep, F.col("peak_pos").cast("bigint").alias("peak_pos"), F.col("p.mzs").alias("mz"), F.col("p.intensities").alias("intensity"))


def essential(spark: SparkSession, path: str) -> DataFrame:
    """What processing needs to know, one row, from the XML alone: dimensions, bounds, extent, pixel size, count, memory."""
    at = places(spark, path)
    size = pixel_size(spark, path)
    n = at.agg(F.count("*").alias("n_spectra"))
    out = metadata.grid_dimensions(at).crossJoin(F.broadcast(metadata.coord_bounds(at))).crossJoin(F.broadcast(n))
    x, y = size or (None, None)
    return out.select(
        "*", (F.col("max_x") - F.col("min_x")).alias("extent_x"), (F.col("max_y") - F.col("min_y")).alias("extent_y"), F.lit(x).cast("double").alias("pixel_size_x"), F.lit(y).cast("double").alias("pixel_size_y"),
        F.lit(size is not None).alias("has_pixel_size"), (F.col("nz") > 1).alias("is_3d"), metadata.memory_gb(F.col("n_spectra"), 1000).alias("memory_gb"),
    )


def sections(spark: SparkSession, path: str) -> DataFrame:
    """(section, key, value) of the header: format, acquisition, instrument, raw; parameters of single spectra are left out."""
    own = (X, Y, Z, OFFSET, LENGTH, BYTES)
    params = ontology.read_params(spark, path).where(~F.col("accession").isin(*own) & F.col("name").isNotNull())
    pairs = params.groupBy(F.col("name").alias("key")).agg(F.max_by("value", "seq").alias("value"))
    uuid = params.where(F.col("accession") == UUID).agg(F.max_by("value", "seq").alias("uuid"))
    n = places(spark, path).agg(F.count("*").cast("string").alias("spectrum_count"))
    given = {"imzml_version": "1.1.0", "file_mode": mode(spark, path), "ibd_file": os.path.splitext(path)[0] + ".ibd"}
    known = uuid.crossJoin(F.broadcast(n)).select(*[F.lit(v).alias(k) for k, v in given.items()], "uuid", "spectrum_count")
    return extract.rows_of(known, "format_specific").union(extract.header_sections(pairs))
