"""Vendor folders: an SQLite frame database and spectra only a vendor decoder can read.

The folder must be on a local or mounted path of every executor: neither SQLite nor a vendor's library opens anything else.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DecoderError, FormatError
from ..functions import coords
from ..operators import accounting, balance, extract, selection
from .decoding import ROW, SCHEMA, Batches
from .registry import detect, register_reader  # noqa: F401  (detect is part of this module's surface)

SPECTRA = "spectrum_idx bigint, x int, y int, z int, mzs array<double>, intensities array<double>"
_VALID = selection.VALID.format("NumPeaks")
#: Peaks and rows that a task is planned for.
PEAKS_A_TASK, ROWS_A_TASK = 20_000_000, 100_000


def _parts(spark: SparkSession, db: str) -> int:
    """Tasks for all frames: by their peaks, and as many as the session has cores where there is enough to do."""
    got = selection.valid_frames(table(spark, db, "Frames", "Id bigint, NumPeaks bigint"), "NumPeaks").agg(F.sum("NumPeaks"), F.count("*")).first()
    return max(1, min(spark.sparkContext.defaultParallelism, got[1]), -(-(got[0] or 0) // PEAKS_A_TASK))


def database(path: str) -> str:
    """The frame database of a vendor folder; the first kind is preferred."""
    for name in ("analysis.tsf", "analysis.tdf"):
        if os.path.exists(os.path.join(path, name)):
            return os.path.join(path, name)
    raise FormatError(f"{path}: no analysis.tsf or analysis.tdf")


def _check_folder(path: str) -> None:
    if not os.path.isdir(path):
        raise FormatError(f"{path}: is not a folder")
    database(path)


def _open(db: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{db}?mode=ro", uri=True)


def table(spark: SparkSession, db: str, name: str, schema: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """A table of the database, read-only, in ranges of ``rows`` rowids; none if the table is missing, nulls for a missing column."""
    columns = [c.split()[0] for c in schema.split(",")]
    with _open(db) as con:
        if not con.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (name,)).fetchone():
            return spark.createDataFrame([], schema)
        there = {r[1] for r in con.execute(f'PRAGMA table_info("{name}")')}
        lo, hi = con.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{name}"').fetchone()
    step = max(1, rows)
    columns = [c if c in there else f"NULL AS {c}" for c in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _open(db) as con:
            for b in batches:
                for a in b["id"].tolist():
                    yield pd.read_sql_query(f'SELECT {", ".join(columns)} FROM "{name}" WHERE rowid BETWEEN {a} AND {a + step - 1}', con)

    return spark.range(lo, hi + 1, step, numPartitions=max(1, -(-(hi - lo + 1) // step))).mapInPandas(run, schema)


def frames(spark: SparkSession, db: str, offset: tuple[int, int] = (0, 0)) -> DataFrame:
    """(frame_id, num_peaks, x, y, z): frames with a place less the offset, others on a line."""
    f = table(spark, db, "Frames", "Id bigint, NumPeaks bigint")
    m = table(spark, db, "MaldiFrameInfo", "Frame bigint, XIndexPos int, YIndexPos int")
    x, y, z = coords.normalised(F.col("XIndexPos"), F.col("YIndexPos"), F.col("Id"), F.lit(offset[0]), F.lit(offset[1]))
    return f.join(m, f["Id"] == m["Frame"], "left").select(F.col("Id").alias("frame_id"), F.col("NumPeaks").alias("num_peaks"), x.cast("int").alias("x"), y.cast("int").alias("y"), z.alias("z"))


def global_metadata(spark: SparkSession, db: str) -> DataFrame:
    return table(spark, db, "GlobalMetadata", "Key string, Value string").withColumnsRenamed({"Key": "key", "Value": "value"})


def mass_range(spark: SparkSession, db: str) -> tuple[float, float]:
    keys = ("MzAcqRangeLower", "MzAcqRangeUpper")
    got = {r["key"]: r["value"] for r in global_metadata(spark, db).where(F.col("key").isin(*keys)).collect()}
    missing = [k for k in keys if k not in got]
    if missing:
        raise FormatError(f"{db}: GlobalMetadata lacks {', '.join(missing)}")
    return float(got[keys[0]]), float(got[keys[1]])


LASER = "Id bigint, BeamScanSizeX double, BeamScanSizeY double, SpotSize double, LaserPower double, LaserFrequency double"


def laser(spark: SparkSession, db: str) -> dict | None:
    """Laser parameters: the first row by Id, none without any."""
    row = table(spark, db, "MaldiFrameLaserInfo", LASER).orderBy("Id").first()
    return row.asDict() if row else None


def pixel_size(spark: SparkSession, db: str) -> tuple[float, float] | None:
    row = laser(spark, db)
    if row is None or row["BeamScanSizeX"] is None or row["BeamScanSizeY"] is None:
        return None
    return row["BeamScanSizeX"], row["BeamScanSizeY"]


def offset(spark: SparkSession, db: str) -> tuple[int, int]:
    """The imaging area's least place, else the frames' least, else 0."""
    keys = ("ImagingAreaMinXIndexPos", "ImagingAreaMinYIndexPos")
    got = {r["key"]: int(float(r["value"])) for r in global_metadata(spark, db).where(F.col("key").isin(*keys)).collect()}
    least = table(spark, db, "MaldiFrameInfo", "Frame bigint, XIndexPos int, YIndexPos int").agg(F.min("XIndexPos"), F.min("YIndexPos")).first()
    x, y = (got.get(k, v or 0) for k, v in zip(keys, least, strict=True))
    return x, y


def spectrum_count(spark: SparkSession, db: str, dims: tuple[int, int, int] = (1, 1, 1)) -> int:
    """Frames of the database, else places, else the pixels of the grid ``dims``."""
    n = table(spark, db, "Frames", "Id bigint").count() or table(spark, db, "MaldiFrameInfo", "Frame bigint").count()
    return n or dims[0] * dims[1] * dims[2]


def is_maldi(spark: SparkSession, db: str) -> bool:
    return selection.laser_count(table(spark, db, "MaldiFrameLaserInfo", "Id bigint")).first()["is_maldi"]


def laser_spots(spark: SparkSession, db: str) -> DataFrame:
    """(id, x, y, beam_x, beam_y) of every laser row."""
    t = table(spark, db, "MaldiFrameLaserInfo", "Id bigint, SpotXPos double, SpotYPos double, BeamScanSizeX double, BeamScanSizeY double")
    return selection.laser_spots(t.toDF("id", "spot_x", "spot_y", "beam_x", "beam_y")).toDF("id", "x", "y", "beam_x", "beam_y")


def partitions(spark: SparkSession, db: str, parts: int) -> list[tuple[int, int]]:
    """First and last id of stretches of frames with near equal peaks; one stretch is one task of ``read``."""
    f = selection.valid_frames(table(spark, db, "Frames", "Id bigint, NumPeaks bigint"), "NumPeaks")
    found = balance.cuts(f, "Id", F.col("NumPeaks"), parts).orderBy("part").collect()  # ``parts`` rows at most
    return [(r["first"], r["last"]) for r in found]


def _stretch(con: sqlite3.Connection, first: int, last: int, off: tuple[int, int]) -> Iterator[tuple[int, int, tuple[int, int, int, int]]]:
    """Id, peaks and place of each frame of a stretch, in order of id."""
    tables = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    where = f"FROM Frames WHERE Id BETWEEN {first} AND {last} AND {_VALID} ORDER BY Id"
    if "MaldiFrameInfo" in tables:
        where = where.replace("FROM Frames", "FROM Frames LEFT JOIN MaldiFrameInfo ON Frame = Id")
    x, y = ("XIndexPos", "YIndexPos") if "MaldiFrameInfo" in tables else ("NULL", "NULL")
    for i, n, a, b in con.execute(f"SELECT Id, NumPeaks, {x}, {y} {where}"):
        yield i, n, (i - 1, i - 1, 0, 0) if a is None or b is None else (i - 1, a - off[0], b - off[1], 0)


@register_reader("frames", ".d", _check_folder)
def read(spark: SparkSession, path: str, decode: Callable[[str, int, int], tuple[list[float], list[float]]] | None = None, keep_bad: bool = False, parts: int | None = None) -> DataFrame:
    """Spectra of a vendor folder.  ``decode(path, frame_id, num_peaks)`` gives m/z and intensities of a frame.

    Frames are dealt by their peaks, so that no task has much more than the mean.  A frame that the
    decoder fails on, or gives arrays of different length for, is left out, or kept with its ``error``.
    """
    if decode is None:
        raise DecoderError("vendor spectra need a decoder; metadata can be read without")
    db = database(path)
    off, stretches = offset(spark, db), partitions(spark, db, parts or _parts(spark, db))
    if not stretches:
        found = spark.createDataFrame([], SCHEMA)
        return found if keep_bad else accounting.usable(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches([name for name, _ in ROW])
        with _open(db) as con:
            for k in (k for b in batches for k in b.column("id").to_pylist()):
                for i, n, place in _stretch(con, *stretches[k], off):
                    got, why = (None, None), None
                    try:
                        got = tuple(np.asarray(v, np.float64) for v in decode(path, i, n))
                        if len(got[0]) != len(got[1]):
                            got, why = (None, None), f"lengths: {len(got[0])} m/z, {len(got[1])} intensities"
                    except Exception as e:  # a decoder of the user's may raise anything
                        got, why = (None, None), f"decoder: {type(e).__name__} {e}"
                    yield from out.add(place, *got, why)
        yield from out.rest()

    found = spark.range(0, len(stretches), 1, numPartitions=len(stretches)).mapInArrow(run, SCHEMA)
    return found if keep_bad else accounting.usable(found)


def _inputs(spark: SparkSession, db: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pairs, places, laser rows and frames of a database, as ``operators.extract`` reads them."""
    schema = "Id bigint, SpotXPos double, SpotYPos double, BeamScanSizeX double, BeamScanSizeY double, SpotSize double, LaserPower double, LaserFrequency double"
    rays = table(spark, db, "MaldiFrameLaserInfo", schema).toDF("id", "spot_x", "spot_y", "beam_x", "beam_y", "spot", "power", "frequency")
    at = table(spark, db, "MaldiFrameInfo", "Frame bigint, XIndexPos int, YIndexPos int").select(F.col("XIndexPos").alias("x"), F.col("YIndexPos").alias("y"))
    return global_metadata(spark, db), at, rays, table(spark, db, "Frames", "Id bigint").select(F.col("Id").alias("frame_id"))


def essential(spark: SparkSession, path: str) -> DataFrame:
    """What processing needs to know, one row, without decoding a spectrum."""
    return extract.essential(*_inputs(spark, database(path)))


def sections(spark: SparkSession, path: str) -> DataFrame:
    """(section, key, value) of the database: format, acquisition, instrument, raw."""
    db = database(path)
    pairs, _, rays, _ = _inputs(spark, db)
    kind = os.path.splitext(db)[1].lstrip(".")
    given = {"data_format": kind, "data_path": path, "database_path": db, "binary_file": db + "_bin", "is_maldi": str(is_maldi(spark, db)).lower()}
    known = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()])
    return extract.rows_of(known, "format_specific").union(extract.sections(pairs, rays))
