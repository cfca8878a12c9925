"""One registered query an operator, with the same rows as SQL.

The SQL side names its inputs by common table expressions over the driver's tables; numbers
stated in both places are the operators' documented constants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import coords
from ..operators import axis, balance, images, mapping, matrix, metadata, ontology, selection, stats
from ..sources import adapters as src

NX, NY = src.NX, src.NY
PS = 25.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CTE = {
    "peaks": """peaks AS (SELECT l_orderkey AS spectrum_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity, l_partkey) - 1 AS peak_pos,
  100.0::DOUBLE + l_partkey * 0.5::DOUBLE AS mz, l_quantity AS intensity FROM lineitem)""",
    "axis": "axis AS (SELECT row_number() OVER (ORDER BY mz) - 1 AS mz_idx, mz FROM (SELECT DISTINCT 100.0::DOUBLE + l_partkey * 0.5::DOUBLE AS mz FROM lineitem))",
    "nz": f"nz AS (SELECT max(l_orderkey) // {NX * NY} + 1 AS nz FROM lineitem)",
    "grid": f"grid AS (SELECT range AS pixel_idx, range % {NX} AS x, (range // {NX}) % {NY} AS y, range // {NX * NY} AS z FROM range((SELECT nz * {NX * NY} FROM nz)))",
    "mapped": "mapped AS (SELECT p.*, a.mz_idx FROM peaks p JOIN axis a USING (mz))",
    "deduped": "deduped AS (SELECT spectrum_idx, mz_idx, arg_max(intensity, row(peak_pos, intensity)) AS intensity FROM mapped GROUP BY ALL)",
    "x": "x AS (SELECT spectrum_idx AS pixel_idx, mz_idx, intensity FROM deduped WHERE intensity <> 0)",
    "spectra": "spectra AS (SELECT vec_id AS spectrum_idx, list_transform(range(len(embedding)), lambda i: 100.0::DOUBLE + i) AS mzs, embedding::DOUBLE[] AS intensities FROM embeddings)",
    "frames": "frames AS (SELECT o_orderkey + 1 AS frame_id, coalesce(n, 0)::BIGINT AS num_peaks FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)",
    "pos": f"pos AS (SELECT o_orderkey + 1 AS frame, 669 + o_orderkey % {NX} AS x_pos, (109 + o_orderkey // {NX})::BIGINT AS y_pos FROM orders WHERE o_orderkey % 50 <> 7)",
    "params": "params AS (SELECT event_type AS file, event_id AS seq, CASE WHEN user_id % 2 = 0 THEN 'MS:' ELSE 'IMS:' END || user_id AS accession FROM events)",
    "terms": "terms AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'MS:' ELSE 'IMS:' END || n_nationkey AS accession, n_name AS name, n_nationkey AS load_order FROM nation)",
}
NEEDS = {"grid": ["nz"], "mapped": ["peaks", "axis"], "deduped": ["mapped"], "x": ["deduped"]}


def _with(names: str, body: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    if body.startswith("RECURSIVE_"):
        return "WITH RECURSIVE " + ", ".join(CTE[n] for n in order) + ", " + body.removeprefix("RECURSIVE_")
    return ("WITH " + ", ".join(CTE[n] for n in order) + " " if order else "") + body


def query(sql: str | None = None, uses: str = ""):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = _with(uses, sql)
        return f

    return keep


def _nz(spark, d) -> int:
    return (src.read(spark, d, "lineitem").agg(F.max("l_orderkey")).first()[0] or 0) // (NX * NY) + 1


def _grid(spark, d) -> DataFrame:
    return images.grid(spark, NX, NY, _nz(spark, d))


def _tasks(spark, d) -> int:
    return balance.tasks(spark, src.read(spark, d, "lineitem").count())


def _mapped(spark, d) -> tuple[DataFrame, DataFrame]:
    n, a = _tasks(spark, d), axis.processed_axis(src.peaks(spark, d))
    return mapping.map_exact(src.peaks(spark, d, n), a, n), a


def _matrix(spark, d) -> tuple[DataFrame, DataFrame]:
    m, a = _mapped(spark, d)
    return matrix.assemble(m.withColumn("pixel_idx", F.col("spectrum_idx")), parts=_tasks(spark, d)), a


def _tic(spark, d) -> DataFrame:
    return stats.tic_of_spectra(src.peaks(spark, d)).withColumnRenamed("spectrum_idx", "pixel_idx")


# --- images ----------------------------------------------------------------------------


@query("SELECT z, y, x, coalesce(tic, 0.0) AS value FROM grid LEFT JOIN (SELECT spectrum_idx, sum(intensity) AS tic FROM peaks GROUP BY 1) ON pixel_idx = spectrum_idx", "peaks grid")
def tic_image(spark, d):
    return images.on_grid(_grid(spark, d), _tic(spark, d), F.col("tic")).select("z", "y", "x", "value")


@query("SELECT z, sum(coalesce(tic, 0.0)) AS tic, count(tic) AS filled FROM grid LEFT JOIN (SELECT spectrum_idx, sum(intensity) AS tic FROM peaks GROUP BY 1) ON pixel_idx = spectrum_idx GROUP BY z", "peaks grid")
def tic_slices(spark, d):
    t = _tic(spark, d).withColumnRenamed("pixel_idx", "p")
    return _grid(spark, d).join(t, F.col("pixel_idx") == F.col("p"), "left").groupBy("z").agg(F.sum(F.coalesce("tic", F.lit(0.0))).alias("tic"), F.count("tic").alias("filled"))


@query("SELECT pixel_idx, 0 AS c, z, y, x, coalesce(tic, 0.0) AS value, y * 25.0::DOUBLE AS y_coord, x * 25.0::DOUBLE AS x_coord FROM grid LEFT JOIN (SELECT spectrum_idx, sum(intensity) AS tic FROM peaks GROUP BY 1) ON pixel_idx = spectrum_idx", "peaks grid")
def tic_volume(spark, d):
    return images.on_grid(_grid(spark, d), _tic(spark, d), F.col("tic")).select("pixel_idx", F.lit(0).alias("c"), "z", "y", "x", "value", coords.physical(F.col("y"), PS).alias("y_coord"), coords.physical(F.col("x"), PS).alias("x_coord"))


@query("SELECT pixel_idx, y, x, coalesce(tic, 0.0) AS value FROM grid LEFT JOIN (SELECT pixel_idx AS p, sum(intensity) AS tic FROM x GROUP BY 1) ON pixel_idx = p WHERE z = 0", "x grid")
def z_plane_tic(spark, d):
    m, _ = _matrix(spark, d)
    return images.on_grid(_grid(spark, d), stats.tic_of_matrix(m), F.col("tic")).where("z = 0").select("pixel_idx", "y", "x", "value")


@query("SELECT pixel_idx, arg_max(tic, spectrum_idx) AS tic, max(spectrum_idx) AS spectrum_idx FROM (SELECT spectrum_idx, spectrum_idx // 2 AS pixel_idx, sum(intensity) AS tic FROM peaks GROUP BY 1, 2) GROUP BY 1", "peaks")
def last_write_wins_tic(spark, d):
    t = stats.tic_of_spectra(src.peaks(spark, d)).withColumn("pixel_idx", F.floor(F.col("spectrum_idx") / 2).cast("bigint"))
    return stats.last_tic(t)


@query("SELECT g.pixel_idx, z, y, x, coalesce(intensity, 0.0) AS value FROM grid g LEFT JOIN (SELECT * FROM x JOIN (SELECT mz_idx FROM axis WHERE abs(mz - 150.2) <= 0.5 ORDER BY abs(mz - 150.2), mz_idx LIMIT 1) USING (mz_idx)) i ON g.pixel_idx = i.pixel_idx", "x grid")
def ion_image(spark, d):
    m, a = _mapped(spark, d)
    return stats.ion_image_of_peaks(m.withColumn("pixel_idx", F.col("spectrum_idx")), a, _grid(spark, d), 150.2, 0.5).select("pixel_idx", "z", "y", "x", "value")


@query("SELECT z, y // 64 AS tile_y, x // 64 AS tile_x, count(*) AS pixels FROM grid GROUP BY ALL", "grid")
def tile_layout(spark, d):
    return images.tiles(_grid(spark, d))


@query("SELECT count(*) AS pixels, count(*) FILTER (tic > 0) AS non_empty, count(*) FILTER (tic > 0) * 100.0::DOUBLE / greatest(count(*), 1) AS percent FROM grid LEFT JOIN (SELECT spectrum_idx, sum(intensity) AS tic FROM peaks GROUP BY 1) ON pixel_idx = spectrum_idx", "peaks grid")
def pixel_coverage(spark, d):
    return stats.coverage(images.on_grid(_grid(spark, d), _tic(spark, d), F.col("tic")))


# --- coordinates and tables --------------------------------------------------------------


@query(f"SELECT o_orderkey, (o_orderkey // {NX * NY}) * {NX * NY} + ((o_orderkey // {NX}) % {NY}) * {NX} + o_orderkey % {NX} AS pixel_idx FROM orders")
def pixel_index(spark, d):
    k = F.col("o_orderkey")
    x, y, z = coords.pixel_xyz(k, NX, NY)
    return src.read(spark, d, "orders").select(k, coords.pixel_index(x, y, z, NX, NY).alias("pixel_idx"))


@query("SELECT pixel_idx, x, y, z FROM grid", "grid")
def pixel_index_inverse(spark, d):
    return _grid(spark, d)


@query("SELECT pixel_idx, x * 25.0::DOUBLE AS spatial_x, y * 25.0::DOUBLE AS spatial_y, z * 25.0::DOUBLE AS spatial_z FROM grid", "grid")
def physical_coords(spark, d):
    return _grid(spark, d).select("pixel_idx", *[coords.physical(F.col(c), PS).alias(f"spatial_{c}") for c in "xyz"])


@query("SELECT l_orderkey, l_linenumber, l_partkey - 1 AS x, l_suppkey - 1 AS y, CASE WHEN l_linenumber > 0 THEN l_linenumber - 1 ELSE 0 END AS z FROM lineitem")
def coords_zero_based(spark, d):
    x, y, z = coords.zero_based(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"))
    return src.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), z.alias("z"))


@query("SELECT frame_id, CASE WHEN x_pos IS NULL THEN frame_id - 1 ELSE x_pos - 669 END AS x, CASE WHEN x_pos IS NULL THEN 0 ELSE y_pos - 109 END AS y, 0 AS z FROM frames LEFT JOIN pos ON frame_id = frame", "frames pos")
def frame_coords_normalised(spark, d):
    f = src.frames(spark, d).join(src.frame_positions(spark, d), F.col("frame_id") == F.col("frame"), "left")
    x, y, z = coords.normalised(F.col("x_pos"), F.col("y_pos"), F.col("frame_id"), F.lit(669), F.lit(109))
    return f.select("frame_id", x.alias("x"), y.alias("y"), z.alias("z"))


@query("SELECT frame, x_pos - 669 AS x, y_pos - 109 AS y FROM pos WHERE frame IN (1, 8, 9, 100, 100000000)", "pos")
def batch_coord_lookup(spark, d):
    ids = spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("bigint") for i in (1, 8, 9, 100, 100000000)])).alias("frame"))
    return src.frame_positions(spark, d).join(F.broadcast(ids), "frame").select("frame", (F.col("x_pos") - 669).alias("x"), (F.col("y_pos") - 109).alias("y"))


@query("SELECT pixel_idx::VARCHAR AS instance_id, x, y, CASE WHEN nz = 1 THEN 0 ELSE z END::BIGINT AS z, 'msi_pixels' AS region, x * 25.0::DOUBLE AS spatial_x, y * 25.0::DOUBLE AS spatial_y, CASE WHEN nz = 1 THEN 0.0 ELSE z * 25.0 END::DOUBLE AS spatial_z, pixel_idx::VARCHAR AS instance_key FROM grid, nz", "grid")
def obs_table(spark, d):
    return images.obs_table(_grid(spark, d), "msi", PS, _nz(spark, d))


@query("SELECT 'msi_z' || z AS slice_id, (y * 128 + x)::VARCHAR AS instance_id, x::INTEGER AS x, y::INTEGER AS y, 'msi_z' || z || '_pixels' AS region, x * 25.0::DOUBLE AS spatial_x, y * 25.0::DOUBLE AS spatial_y FROM grid", "grid")
def obs_slices(spark, d):
    return images.obs_slices(_grid(spark, d), "msi", PS, NX)


@query("SELECT 'mz_' || mz_idx AS mz_id, mz FROM axis", "axis")
def var_table(spark, d):
    return images.var_table(axis.processed_axis(src.peaks(spark, d)))


@query(
    """SELECT instance_id, xmin, ymin, xmax, ymax, 'POLYGON ((' || concat_ws(', ', xmax || ' ' || ymin, xmax || ' ' || ymax, xmin || ' ' || ymax, xmin || ' ' || ymin, xmax || ' ' || ymin) || '))' AS wkt
    FROM (SELECT pixel_idx::VARCHAR AS instance_id, x * 25.0::DOUBLE - 12.5::DOUBLE AS xmin, y * 25.0::DOUBLE - 12.5::DOUBLE AS ymin, x * 25.0::DOUBLE + 12.5::DOUBLE AS xmax, y * 25.0::DOUBLE + 12.5::DOUBLE AS ymax FROM grid)""",
    "grid",
)
def pixel_shapes(spark, d):
    return images.pixel_shapes(images.obs_table(_grid(spark, d), "msi", PS, _nz(spark, d)), PS)


@query("SELECT pixel_idx::VARCHAR AS instance_id, 'msi_pixels' AS region, x * 25.0::DOUBLE - 12.5::DOUBLE AS xmin FROM grid", "grid")
def obs_with_shapes(spark, d):
    obs = images.obs_table(_grid(spark, d), "msi", PS, _nz(spark, d))
    return obs.join(images.pixel_shapes(obs, PS), "instance_id").select("instance_id", "region", "xmin")


# --- axis and mapping ----------------------------------------------------------------------


@query("SELECT mz_idx, mz FROM axis", "axis")
def mass_axis_processed(spark, d):
    return axis.processed_axis(src.peaks(spark, d))


@query("SELECT i - 1 AS mz_idx, mzs[i] AS mz FROM (SELECT mzs, unnest(range(1, len(mzs) + 1)) AS i FROM spectra WHERE spectrum_idx = 0)", "spectra")
def mass_axis_continuous(spark, d):
    return axis.continuous_axis(src.spectra(spark, d))


@query(
    """RECURSIVE_
    start AS (SELECT min(mz) AS a FROM axis UNION ALL SELECT min(mz) FROM start, axis WHERE (mz - a) / a * 1e6 > 1500.0::DOUBLE GROUP BY a)
    SELECT row_number() OVER (ORDER BY m) - 1 AS mz_idx, m AS mz FROM (SELECT avg(mz) AS m FROM start JOIN axis ON mz >= a AND (mz - a) / a * 1e6 <= 1500.0::DOUBLE GROUP BY a)""",
    "axis",
)
def mass_axis_ppm(spark, d):
    return axis.ppm_axis(axis.processed_axis(src.peaks(spark, d)), 1500.0)


@query("SELECT l_orderkey, l_quantity * 1000 AS n_spectra, CASE WHEN l_quantity * 1000 * 1500 * 8 / 1048576.0 < 256 THEN 'fast' WHEN l_quantity * 1000 * 1500 * 8 / 1048576.0 < 512 THEN 'memory_efficient' ELSE 'streaming' END AS strategy FROM lineitem")
def axis_strategy_label(spark, d):
    n = F.col("l_quantity") * 1000
    return src.read(spark, d, "lineitem").select("l_orderkey", n.alias("n_spectra"), axis.strategy(n, 512.0).alias("strategy"))


@query("SELECT spectrum_idx, peak_pos, mz_idx, intensity FROM mapped", "mapped")
def map_exact(spark, d):
    return _mapped(spark, d)[0].select("spectrum_idx", "peak_pos", "mz_idx", "intensity")


#: A foreign axis: every other value, a hair above; peaks just below find it, others do not.
_HALF = "half AS (SELECT row_number() OVER (ORDER BY mz) - 1 AS mz_idx, mz FROM (SELECT DISTINCT 100.0::DOUBLE + l_partkey * 0.5::DOUBLE + 0.0000005::DOUBLE AS mz FROM lineitem WHERE l_partkey % 2 = 0))"


def _half_axis(spark, d):
    p = src.read(spark, d, "lineitem").where("l_partkey % 2 = 0")
    mz = F.lit(100.0).cast("double") + F.col("l_partkey") * F.lit(0.5).cast("double") + F.lit(0.0000005).cast("double")
    return axis.processed_axis(p.select(mz.alias("mz")))


_NEAR = "SELECT p.spectrum_idx, p.peak_pos, min(h.mz_idx) AS mz_idx FROM peaks p JOIN half h ON h.mz >= p.mz AND h.mz <= p.mz + 0.00001 AND h.mz - p.mz <= 0.000001 GROUP BY ALL"


@query(f"WITH {CTE['peaks']}, {_HALF} {_NEAR}")
def map_tolerance(spark, d):
    return mapping.map_bucketed(src.peaks(spark, d), _half_axis(spark, d)).select("spectrum_idx", "peak_pos", "mz_idx")


@query(f"WITH {CTE['peaks']}, {_HALF} {_NEAR}")
def map_vectorised(spark, d):
    return mapping.map_vectorised(src.peaks(spark, d), _half_axis(spark, d)).select("spectrum_idx", "peak_pos", "mz_idx")


@query(
    f"""WITH {CTE['peaks']}, short AS (SELECT DISTINCT mz FROM peaks WHERE mz <= 150), near AS (SELECT spectrum_idx, peak_pos, mz + 0.0000004::DOUBLE AS mz FROM peaks)
    SELECT spectrum_idx, peak_pos, (SELECT count(*) - 1 FROM short) AS mz_idx FROM near, (SELECT max(mz) AS top FROM short) WHERE mz > top AND mz - top <= 0.000001"""
)
def map_tail_clip(spark, d):
    short = axis.processed_axis(src.peaks(spark, d).where("mz <= 150"))
    p = src.peaks(spark, d).withColumn("mz", F.col("mz") + F.lit(0.0000004).cast("double"))
    return mapping.map_bucketed(p, short).select("spectrum_idx", "peak_pos", "mz_idx")


@query(f"WITH {CTE['peaks']}, {_HALF}, m AS ({_NEAR}) SELECT spectrum_idx, peak_pos, mz FROM peaks ANTI JOIN m USING (spectrum_idx, peak_pos)")
def dropped_peaks(spark, d):
    p = src.peaks(spark, d)
    return mapping.dropped(p, mapping.map_bucketed(p, _half_axis(spark, d))).select("spectrum_idx", "peak_pos", "mz")


# --- matrix -----------------------------------------------------------------------------


@query("SELECT pixel_idx, mz_idx, intensity FROM x", "x")
def intensity_matrix_coo(spark, d):
    return _matrix(spark, d)[0]


@query("SELECT spectrum_idx // 2 AS pixel_idx, mz_idx, arg_max(intensity, row(spectrum_idx, peak_pos, intensity)) AS intensity FROM mapped GROUP BY 1, 2", "mapped")
def last_write_wins_matrix(spark, d):
    m, _ = _mapped(spark, d)
    return matrix.assemble(m.withColumn("pixel_idx", F.floor(F.col("spectrum_idx") / 2).cast("bigint")), parts=_tasks(spark, d))


@query("SELECT spectrum_idx AS pixel_idx, i - 1 AS mz_idx, intensities[i] AS intensity FROM (SELECT *, unnest(range(1, len(intensities) + 1)) AS i FROM spectra) WHERE intensities[i] > 0", "spectra")
def matrix_positive_only(spark, d):
    s = src.spectra(spark, d).select(F.col("spectrum_idx"), F.posexplode("intensities").alias("peak_pos", "intensity"))
    return matrix.assemble(s.select(F.col("spectrum_idx").alias("pixel_idx"), "spectrum_idx", "peak_pos", F.col("peak_pos").cast("bigint").alias("mz_idx"), "intensity"), positive_only=True)


@query("SELECT pixel_idx, string_agg(mz_idx, ',' ORDER BY mz_idx) AS indices, string_agg(intensity::BIGINT, ',' ORDER BY mz_idx) AS data, count(*) AS nnz FROM x GROUP BY 1", "x")
def csr_rows(spark, d):
    r = matrix.rows(_matrix(spark, d)[0])
    return r.select("pixel_idx", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"), F.array_join(F.col("data").cast("array<bigint>").cast("array<string>"), ",").alias("data"), F.size("indices").cast("bigint").alias("nnz"))


@query("SELECT a.mz_idx, mz, coalesce(intensity, 0.0) AS intensity FROM axis a LEFT JOIN (SELECT * FROM x WHERE pixel_idx = 7) i ON a.mz_idx = i.mz_idx", "x")
def dense_spectrum(spark, d):
    m, a = _matrix(spark, d)
    return matrix.dense_row(m, a, F.col("pixel_idx") == 7)


@query("SELECT spectrum_idx, len(mzs) AS n, array_to_string(list_transform(intensities, lambda v: round(v * 1000)::BIGINT), ',') AS row FROM spectra", "spectra")
def dense_rows(spark, d):
    row = F.array_join(F.transform("intensities", lambda v: F.round(v * 1000).cast("bigint").cast("string")), ",")
    return src.spectra(spark, d).select("spectrum_idx", F.size("mzs").cast("bigint").alias("n"), row.alias("row"))


# --- statistics -----------------------------------------------------------------------------


@query("SELECT a.mz_idx, mz, coalesce(t, 0.0) AS total FROM axis a LEFT JOIN (SELECT mz_idx, sum(intensity) AS t FROM deduped GROUP BY 1) s ON a.mz_idx = s.mz_idx", "deduped")
def total_spectrum(spark, d):
    m, a = _mapped(spark, d)
    return stats.total_spectrum(m, a)


@query("SELECT a.mz_idx, mz, coalesce(t, 0.0) / (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS average FROM axis a LEFT JOIN (SELECT mz_idx, sum(intensity) AS t FROM deduped GROUP BY 1) s ON a.mz_idx = s.mz_idx", "deduped")
def average_spectrum(spark, d):
    m, a = _mapped(spark, d)
    return stats.average_spectrum(stats.total_spectrum(m, a), src.read(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("n")))


@query("SELECT a.mz_idx, mz, coalesce(t, 0.0) / (SELECT count(DISTINCT pixel_idx) FROM x) AS average FROM axis a LEFT JOIN (SELECT mz_idx, sum(intensity) AS t FROM x GROUP BY 1) s ON a.mz_idx = s.mz_idx", "x")
def average_spectrum_nonempty(spark, d):
    m, a = _matrix(spark, d)
    total = a.join(m.groupBy("mz_idx").agg(F.sum("intensity").alias("t")), "mz_idx", "left").select("mz_idx", "mz", F.coalesce("t", F.lit(0.0)).alias("total"))
    return stats.average_spectrum(total, m.agg(F.count_distinct("pixel_idx").alias("n")))


@query("SELECT count(DISTINCT l_orderkey) AS n, count(*) AS peaks FROM lineitem")
def non_empty_pixels(spark, d):
    return src.read(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("n"), F.count("*").alias("peaks"))


@query("SELECT pixel_idx, sum(intensity) AS tic FROM x GROUP BY 1", "x")
def tic_from_matrix(spark, d):
    return stats.tic_of_matrix(_matrix(spark, d)[0])


# --- frames and metadata -----------------------------------------------------------------


@query("SELECT frame_id, num_peaks FROM frames WHERE num_peaks > 0 AND num_peaks <= 65535", "frames")
def num_peaks_valid(spark, d):
    return selection.valid_frames(src.frames(spark, d))


@query("SELECT o_orderkey FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey")
def nonempty_spectra(spark, d):
    return selection.with_peaks(src.read(spark, d, "orders").select("o_orderkey"), src.read(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


@query("SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def empty_spectra(spark, d):
    return selection.without_peaks(src.read(spark, d, "orders").select("o_orderkey"), src.read(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


@query(f"SELECT max(o_orderkey % {NX} + 1) AS nx, max((o_orderkey // {NX}) % {NY} + 1) AS ny, max(o_orderkey // {NX * NY} + 1) AS nz FROM orders")
def grid_dimensions(spark, d):
    x, y, z = coords.pixel_xyz(F.col("o_orderkey"), NX, NY)
    return metadata.grid_dimensions(src.read(spark, d, "orders").select((x + 1).alias("x"), (y + 1).alias("y"), (z + 1).alias("z")))


@query("SELECT min(x_pos)::DOUBLE AS min_x, max(x_pos)::DOUBLE AS max_x, min(y_pos)::DOUBLE AS min_y, max(y_pos)::DOUBLE AS max_y FROM pos", "pos")
def coord_bounds(spark, d):
    return metadata.coord_bounds(src.frame_positions(spark, d).select(F.col("x_pos").alias("x"), F.col("y_pos").alias("y")))


@query("SELECT min(list_min(mzs)) AS mz_min, max(list_max(mzs)) AS mz_max FROM spectra WHERE spectrum_idx IN (SELECT unnest([0, n // 4, n // 2, 3 * n // 4, n - 1]) FROM (SELECT count(*) AS n FROM embeddings))", "spectra")
def mass_range_sampled(spark, d):
    return metadata.mass_range(src.spectra(spark, d), metadata.sample_positions(src.read(spark, d, "embeddings").count()))


@query("SELECT min(mz) AS mz_min, max(mz) AS mz_max FROM peaks", "peaks")
def mass_range_exact(spark, d):
    return selection.peak_range(src.peaks(spark, d))


@query("SELECT greatest(max(x_pos) - min(x_pos) + 1, 1)::BIGINT AS nx, greatest(max(y_pos) - min(y_pos) + 1, 1)::BIGINT AS ny, 1::BIGINT AS nz FROM pos", "pos")
def frame_dimensions(spark, d):
    return metadata.frame_dimensions(metadata.frame_stats(src.frame_positions(spark, d), "x_pos", "y_pos"))


@query("SELECT min(x_pos) AS min_x, max(x_pos) AS max_x, min(y_pos) AS min_y, max(y_pos) AS max_y, count(*) AS n FROM pos", "pos")
def frame_stats(spark, d):
    return metadata.frame_stats(src.frame_positions(spark, d), "x_pos", "y_pos")


_KEYS = {"URGENT": "urgent", "1-URGENT": "urgent_1", "2-HIGH": "high", "MISSING": "missing"}


@query("SELECT max(o_totalprice) FILTER (o_orderpriority = 'URGENT') AS urgent, max(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS urgent_1, max(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS high, max(o_totalprice) FILTER (o_orderpriority = 'MISSING') AS missing FROM orders")
def eav_pivot(spark, d):
    return metadata.pivot_keys(src.read(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_totalprice").alias("value")), _KEYS, "double")


@query("SELECT coalesce(max(r_regionkey) FILTER (r_name = 'NOWHERE'), (SELECT min(x_pos) FROM pos))::BIGINT AS min_x, coalesce(max(r_regionkey) FILTER (r_name = 'NOWHERE'), 0)::BIGINT AS fallback FROM region", "pos")
def missing_key_defaults(spark, d):
    keys = metadata.pivot_keys(src.read(spark, d, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").alias("value")), {"NOWHERE": "v"}, "bigint")
    least = src.frame_positions(spark, d).agg(F.min("x_pos").alias("least"))
    return keys.crossJoin(F.broadcast(least)).select(F.coalesce("v", "least").cast("bigint").alias("min_x"), F.coalesce("v", F.lit(0)).cast("bigint").alias("fallback"))


@query("SELECT replace(lower(o_orderpriority), ' ', '_') AS key, count(*) AS n FROM orders GROUP BY 1")
def renamed_keys(spark, d):
    return metadata.renamed_keys(src.read(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.lit(1).alias("value"))).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey * 1000 * 2 * 8 / 1073741824.0::DOUBLE AS spectrum_gb, l_partkey * 2000 * 2 * 8 / 1073741824.0::DOUBLE AS frame_gb FROM lineitem WHERE l_partkey > 0")
def memory_estimate(spark, d):
    n = F.col("l_partkey")
    return src.read(spark, d, "lineitem").where(n > 0).select("l_orderkey", "l_linenumber", metadata.memory_gb(n, 1000).alias("spectrum_gb"), metadata.memory_gb(n, 2000).alias("frame_gb"))


@query(
    """SELECT k, round(raw, 9) AS raw_mb, round(ax, 9) AS axis_mb, round(sp, 9) AS sparse_mb, round(co, 9) AS coords_mb, round(greatest(100.0::DOUBLE, raw * 0.1::DOUBLE), 9) AS overhead_mb FROM (
    SELECT p_partkey AS k, p_partkey * p_size * 12 / 1048576.0::DOUBLE AS raw, p_size * 8 / 1048576.0::DOUBLE AS ax, p_partkey * p_size * 0.1::DOUBLE * 4 / 1048576.0::DOUBLE AS sp, p_partkey * 12 / 1048576.0::DOUBLE AS co FROM part)"""
)
def memory_model(spark, d):
    m = metadata.memory_model(F.col("p_partkey"), F.col("p_size"), F.col("p_size"))
    return src.read(spark, d, "part").select(F.col("p_partkey").alias("k"), *[F.round(c, 9).alias(k) for k, c in m.items() if k != "total_mb"])


@query("SELECT p_partkey AS k, least(greatest(least(floor(64000.0::DOUBLE / p_retailprice)::BIGINT, 1000), 10), 500) AS batch FROM part")
def batch_size_model(spark, d):
    size = metadata.batch_size(F.lit(64000.0).cast("double"), F.col("p_retailprice"), 10, 1000, F.lit(500))
    return src.read(spark, d, "part").select(F.col("p_partkey").alias("k"), size.alias("batch"))


@query("SELECT min(frame) AS first_id, max(frame) AS last_id, count(*) AS n FROM (SELECT frame, frame - row_number() OVER (ORDER BY frame) AS g FROM pos) GROUP BY g", "pos")
def consecutive_frame_ranges(spark, d):
    return metadata.consecutive_ranges(src.frame_positions(spark, d).select(F.col("frame").alias("id")))


@query("SELECT count(*) AS total, count(frame) AS cached, count(frame) * 100.0::DOUBLE / greatest(count(*), 1) AS percent FROM frames LEFT JOIN pos ON frame_id = frame", "frames pos")
def coverage_stats(spark, d):
    f = src.frames(spark, d).join(src.frame_positions(spark, d), F.col("frame_id") == F.col("frame"), "left")
    return stats.covered(f, "frame")


@query("SELECT frame FROM pos ORDER BY frame DESC LIMIT 100", "pos")
def recent_frames(spark, d):
    return src.frame_positions(spark, d).orderBy(F.desc("frame")).limit(100).select("frame")


@query("SELECT o_orderkey // 100 AS batch, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id, count(*) AS n FROM orders GROUP BY 1")
def batches(spark, d):
    k = F.floor(F.col("o_orderkey") / 100).cast("bigint")
    return src.read(spark, d, "orders").groupBy(k.alias("batch")).agg(F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"), F.count("*").alias("n"))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS recent FROM events")
def adaptive_window(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return src.read(spark, d, "events").select("user_id", "event_id", F.round(F.avg("value").over(w), 6).alias("recent"))


# --- vocabulary -----------------------------------------------------------------------------


@query("SELECT accession, count(*) AS n, min(seq) AS first_seen FROM params WHERE accession <> '' GROUP BY 1", "params")
def cv_term_counts(spark, d):
    return ontology.term_counts(src.params(spark, d))


@query("SELECT count(*) AS total, count(name) AS known, count(*) - count(name) AS unknown, count(DISTINCT accession) AS distinct_terms, count(name) * 100.0::DOUBLE / count(*) AS known_percent FROM params LEFT JOIN terms USING (accession)", "params terms")
def cv_known_unknown(spark, d):
    return ontology.summary(src.params(spark, d), src.terms(spark, d))


@query("SELECT accession, n, name FROM (SELECT accession, count(*) AS n, min(seq) AS f FROM params GROUP BY 1 ORDER BY n DESC, f LIMIT 15) LEFT JOIN terms USING (accession)", "params terms")
def cv_top15(spark, d):
    return ontology.most_common(src.params(spark, d), src.terms(spark, d))


@query(
    """SELECT prefix, accession, n, greatest(c - 10, 0) AS more FROM (SELECT *, split_part(accession, ':', 1) AS prefix, row_number() OVER (PARTITION BY split_part(accession, ':', 1) ORDER BY accession) AS r,
    count(*) OVER (PARTITION BY split_part(accession, ':', 1)) AS c FROM (SELECT accession, count(*) AS n FROM params ANTI JOIN terms USING (accession) GROUP BY 1)) WHERE r <= 10""",
    "params terms",
)
def cv_unknown_by_prefix(spark, d):
    return ontology.unknown_by_prefix(src.params(spark, d), src.terms(spark, d))


@query("SELECT file, count(*) AS total, count(name) AS known, coalesce(string_agg(DISTINCT CASE WHEN name IS NULL THEN accession END, ',' ORDER BY CASE WHEN name IS NULL THEN accession END), '') AS unknown FROM params LEFT JOIN terms USING (accession) GROUP BY 1", "params terms")
def cv_directory_rollup(spark, d):
    return ontology.rollup_by_file(src.params(spark, d), src.terms(spark, d))


@query("SELECT lower(name) AS name, arg_max(accession, load_order) AS accession FROM terms GROUP BY 1", "terms")
def cv_name_lookup(spark, d):
    return ontology.by_name(src.terms(spark, d))


# --- attributes -----------------------------------------------------------------------------


@query("SELECT 'msi' AS dataset_id, count(*) AS total_grid_pixels, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS non_empty_pixels, 'physical_micrometers' AS coordinate_system, 25.0::DOUBLE AS pixel_size_x_um, 25.0::DOUBLE AS pixel_size_y_um FROM grid", "grid")
def attrs_document(spark, d):
    seen = src.read(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("non_empty_pixels"))
    grid = _grid(spark, d).agg(F.count("*").alias("total_grid_pixels"))
    return grid.crossJoin(F.broadcast(seen)).select(F.lit("msi").alias("dataset_id"), "total_grid_pixels", "non_empty_pixels", F.lit("physical_micrometers").alias("coordinate_system"), F.lit(PS).alias("pixel_size_x_um"), F.lit(PS).alias("pixel_size_y_um"))


@query("SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_spectra, max(mz) AS mz_max, min(mz) AS mz_min, (SELECT nz > 1 FROM nz) AS is_3d FROM peaks", "peaks nz")
def metadata_summary(spark, d):
    n = src.read(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("n_spectra"), (F.floor(F.max("l_orderkey") / (NX * NY)) + 1 > 1).alias("is_3d"))
    return selection.peak_range(src.peaks(spark, d)).crossJoin(F.broadcast(n)).select("n_spectra", "mz_max", "mz_min", "is_3d")


from . import records, stores  # noqa: E402, F401  (they register their queries here)
