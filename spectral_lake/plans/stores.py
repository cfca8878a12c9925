"""Queries of stored arrays, prefix sums, weighted cuts and accounting: what is written is read back and compared with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import storage
from ..operators import accounting, balance
from ..sinks import zarr_v2
from ..sources import adapters as src
from ..sources.decoding import CAUSES
from .catalogue import NX, NY, _matrix, _nz, query, tic_image


def _place(spark, name):
    """A folder of its own; the result reads it, so it stays until the shared folder is cleared."""
    return f"{storage.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT frame_id, num_peaks, coalesce(sum(num_peaks) OVER (ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM frames", "frames")
def frame_prefix_sums(spark, d):
    return balance.prefix_sums(src.frames(spark, d), "frame_id", F.col("num_peaks"))


@query(
    """SELECT part, min(frame_id) AS first, max(frame_id) AS last, count(*) AS n, sum(num_peaks)::BIGINT AS weight FROM (
    SELECT frame_id, num_peaks, least(15, (2 * (sum(num_peaks) OVER (ORDER BY frame_id) - num_peaks) + num_peaks) * 16 // (2 * sum(num_peaks) OVER ()))::BIGINT AS part FROM frames WHERE num_peaks > 0) GROUP BY part""",
    "frames",
)
def weighted_partitions(spark, d):
    return balance.cuts(src.frames(spark, d).where("num_peaks > 0"), "frame_id", F.col("num_peaks"), 16)


_OUTCOMES = ("read", "empty", *CAUSES, "other")


@query(
    "SELECT count(*) AS spectra, "
    + ", ".join(f"count(*) FILTER (outcome = '{k}') AS {k}" for k in _OUTCOMES)
    + ", coalesce(sum(len(mzs)) FILTER (outcome = 'read'), 0)::BIGINT AS peaks, coalesce(max(len(mzs)) FILTER (outcome = 'read'), 0)::BIGINT AS most_peaks FROM (SELECT mzs, CASE WHEN spectrum_idx % 9 < 6 THEN ['missing', 'lengths', 'range', 'corrupt', 'decoder', 'other'][spectrum_idx % 9 + 1] WHEN spectrum_idx % 4 = 0 THEN 'empty' ELSE 'read' END AS outcome FROM spectra)",
    "spectra",
)
def spectrum_accounting(spark, d):
    """Two thirds of the spectra with an error of some kind, and a quarter of the rest without values."""
    k = F.col("spectrum_idx") % 9
    told = F.get(F.array(*[F.lit(f"{c}: detail") for c in CAUSES], F.lit("unheard of")), k.cast("int"))
    empty = (k >= 6) & (F.col("spectrum_idx") % 4 == 0)
    spectra = src.spectra(spark, d).withColumn("error", F.when(k < 6, told))
    return accounting.account(spectra.withColumns({c: F.when(k < 6, None).when(empty, F.array().cast("array<double>")).otherwise(F.col(c)) for c in ("mzs", "intensities")}))


@query("SELECT pixel_idx, count(*) AS n, (sum(count(*)) OVER (ORDER BY pixel_idx) - count(*))::BIGINT AS start FROM x GROUP BY pixel_idx", "x")
def row_starts(spark, d):
    return zarr_v2.row_starts(_matrix(spark, d)[0])


@query("SELECT pixel_idx, mz_idx, intensity FROM x", "x")
def csr_store(spark, d):
    """The sparse matrix as compressed rows on disk, read back."""
    matrix, axis = _matrix(spark, d)
    path = _place(spark, "csr")
    zarr_v2.write_csr(matrix, path, (NX * NY * _nz(spark, d), axis.count()))
    return zarr_v2.read_csr(spark, path)


@query("SELECT z, y, x, coalesce(tic, 0.0) AS value FROM grid LEFT JOIN (SELECT spectrum_idx, sum(intensity) AS tic FROM peaks GROUP BY 1) ON pixel_idx = spectrum_idx", "peaks grid")
def rechunked_volume(spark, d):
    """The image volume in tiles of a plane, stored again in columns through all planes, read back."""
    path, nz = _place(spark, "volume"), _nz(spark, d)
    zarr_v2.write_image(tic_image(spark, d), f"{path}/tiles", (nz, NY, NX))
    zarr_v2.rechunk(spark, f"{path}/tiles", f"{path}/columns", (nz, 32, 48))
    return zarr_v2.read_cells(spark, f"{path}/columns")
