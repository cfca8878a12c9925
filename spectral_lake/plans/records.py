"""Queries of metadata extraction: key-value pairs, laser rows, places, vocabulary pages, output elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords
from ..operators import axis, extract, mapping, metadata, ontology, selection, stats
from ..sources import adapters as src
from ..sources import imzml
from .catalogue import CTE, NX, NY, _grid, query

_KEYS = (*extract.TIMING, *extract.INSTRUMENT, *extract.MASS, "ImagingAreaMinXIndexPos", "ImagingAreaMinYIndexPos", "ImagingAreaMaxXIndexPos")
CTE["pairs"] = (
    "pairs AS (SELECT CASE n_nationkey "
    + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KEYS))
    + " ELSE n_name END AS key, CASE WHEN n_nationkey BETWEEN 6 AND 10 THEN (n_nationkey * 100)::VARCHAR ELSE n_name END AS value FROM nation)"
)
CTE["laser"] = "laser AS (SELECT p_partkey AS id, p_size + 0.5::DOUBLE AS spot_x, p_size + 1.5::DOUBLE AS spot_y, p_size * 2.0::DOUBLE AS beam_x, p_size * 3.0::DOUBLE AS beam_y, p_retailprice AS spot, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 1.5::DOUBLE END AS power, p_size + 100.0::DOUBLE AS frequency FROM part)"


def _pairs(spark, d):
    k, key = F.col("n_nationkey"), F.col("n_name")
    for i, name in enumerate(_KEYS):
        key = F.when(F.col("n_nationkey") == i, name).otherwise(key)
    return src.read(spark, d, "nation").select(key.alias("key"), F.when(k.between(6, 10), (k * 100).cast("string")).otherwise(F.col("n_name")).alias("value"))


def _laser(spark, d):
    p, size = src.read(spark, d, "part"), F.col("p_size")
    power = F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") * 1.5)
    return p.select(F.col("p_partkey").alias("id"), (size + 0.5).alias("spot_x"), (size + 1.5).alias("spot_y"), (size * 2.0).alias("beam_x"), (size * 3.0).alias("beam_y"), F.col("p_retailprice").alias("spot"), power.alias("power"), (size + 100.0).alias("frequency"))


def _places(spark, d):
    return src.frame_positions(spark, d).select(F.col("x_pos").alias("x"), F.col("y_pos").alias("y"))


@query("SELECT power AS laser_power, frequency AS laser_frequency, beam_x AS beam_scan_size_x, beam_y AS beam_scan_size_y, spot AS laser_spot_size FROM laser ORDER BY id LIMIT 1", "laser")
def laser_parameters(spark, d):
    return extract.laser_row(_laser(spark, d))


@query("SELECT id, spot_x, spot_y, beam_x, beam_y FROM laser", "laser")
def laser_spots(spark, d):
    return selection.laser_spots(_laser(spark, d))


@query("SELECT count(*) AS n, count(*) > 0 AS is_maldi FROM laser", "laser")
def laser_count(spark, d):
    return selection.laser_count(_laser(spark, d))


@query("SELECT max(value) FILTER (key = 'AcquisitionDateTime') AS acquisition_datetime FROM pairs", "pairs")
def acquisition_datetime(spark, d):
    return metadata.pivot_keys(_pairs(spark, d), extract.TIMING)


@query("SELECT " + ", ".join(f"max(value) FILTER (key = '{k}') AS {n}" for k, n in extract.INSTRUMENT.items()) + " FROM pairs", "pairs")
def instrument_info(spark, d):
    return metadata.pivot_keys(_pairs(spark, d), extract.INSTRUMENT)


_AREA = ", ".join(f"coalesce(max(value::DOUBLE) FILTER (key = '{k}'), (SELECT {n.split('_')[0]}({n[-1]}_pos) FROM pos), 0)::DOUBLE AS {n}" for k, n in extract.AREA.items())
_STATED = f"area AS (SELECT {_AREA} FROM pairs WHERE key LIKE 'ImagingArea%')"
CTE["area"] = _STATED


@query("SELECT min_x, max_x, min_y, max_y FROM area", "pairs pos area")
def imaging_area(spark, d):
    return extract.area(_pairs(spark, d), _places(spark, d))


@query("SELECT min_x::INTEGER AS offset_x, min_y::INTEGER AS offset_y, 0 AS offset_z FROM area", "pairs pos area")
def imaging_area_offsets(spark, d):
    return extract.offsets(extract.area(_pairs(spark, d), _places(spark, d)))


@query("SELECT max(value::DOUBLE) FILTER (key = 'MzAcqRangeLower') AS mz_min, max(value::DOUBLE) FILTER (key = 'MzAcqRangeUpper') AS mz_max FROM pairs WHERE key LIKE 'MzAcq%'", "pairs")
def mass_range_keys(spark, d):
    return extract.mass_range(_pairs(spark, d))


@query(
    """SELECT greatest((max_x - min_x)::BIGINT + 1, 1) AS nx, greatest((max_y - min_y)::BIGINT + 1, 1) AS ny, 1::BIGINT AS nz, min_x, max_x, min_y, max_y, max_x - min_x AS extent_x, max_y - min_y AS extent_y,
    600.0::DOUBLE AS mz_min, 700.0::DOUBLE AS mz_max, (SELECT beam_x FROM laser ORDER BY id LIMIT 1) AS pixel_size_x, (SELECT beam_y FROM laser ORDER BY id LIMIT 1) AS pixel_size_y, (SELECT count(*) > 0 FROM laser) AS has_pixel_size,
    false AS is_3d, (SELECT count(*) FROM frames) AS n_spectra, (SELECT count(*) FROM frames) * 2000 * 2 * 8 / 1073741824.0::DOUBLE AS memory_gb, min_x::INTEGER AS offset_x, min_y::INTEGER AS offset_y, 0 AS offset_z FROM area""",
    "pairs pos area laser frames",
)
def essential_metadata(spark, d):
    return extract.essential(_pairs(spark, d), _places(spark, d), _laser(spark, d), src.frames(spark, d))


_FIRST = "(SELECT * FROM laser ORDER BY id LIMIT 1)"
_NAMES = (("laser_power", "power"), ("laser_frequency", "frequency"), ("beam_scan_size_x", "beam_x"), ("BeamScanSizeX", "beam_x"), ("beam_scan_size_y", "beam_y"), ("BeamScanSizeY", "beam_y"), ("laser_spot_size", "spot"))


@query(
    "SELECT section, key, value FROM ("
    + " UNION ALL ".join(f"SELECT 'acquisition_params' AS section, '{n}' AS key, {c}::VARCHAR AS value FROM {_FIRST}" for n, c in _NAMES)
    + " UNION ALL SELECT 'acquisition_params', 'acquisition_datetime', value FROM pairs WHERE key = 'AcquisitionDateTime'"
    + " UNION ALL SELECT 'instrument_info', CASE key " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in extract.INSTRUMENT.items()) + " END, value FROM pairs WHERE key IN (" + ", ".join(f"'{k}'" for k in extract.INSTRUMENT) + ")"
    + " UNION ALL SELECT 'raw_metadata', key, value FROM pairs) WHERE value IS NOT NULL",
    "pairs laser",
)
def metadata_sections(spark, d):
    return extract.sections(_pairs(spark, d), _laser(spark, d))


@query("SELECT section, count(*) AS n FROM (SELECT CASE WHEN key IN ('1-URGENT', '2-HIGH') THEN 'known' END AS section FROM (SELECT o_orderpriority AS key FROM orders)) WHERE section IS NOT NULL GROUP BY 1 HAVING count(*) > 0")
def nonempty_sections(spark, d):
    """Orders as pairs of two sections, one of which has no value."""
    known = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    pairs = src.read(spark, d, "orders").select(F.when(known, "known").otherwise("void").alias("section"), F.col("o_orderkey").cast("string").alias("key"), F.when(known, F.col("o_orderpriority")).alias("value"))
    return extract.nonempty(pairs).groupBy("section").agg(F.count("*").alias("n"))


@query("SELECT min(frame_id) AS first_id, max(frame_id) AS last_id, count(*) AS n FROM frames", "frames")
def frame_id_range(spark, d):
    return selection.id_range(src.frames(spark, d))


@query("SELECT frame, x_pos, y_pos FROM pos WHERE frame BETWEEN 100 AND 5000", "pos")
def frames_between(spark, d):
    return selection.frames_between(src.frame_positions(spark, d), 100, 5000)


@query("SELECT coalesce(nullif((SELECT count(*) FROM frames WHERE num_peaks < 0), 0), nullif((SELECT count(*) FROM pos), 0), 77)::BIGINT AS n_spectra", "frames pos")
def spectrum_count(spark, d):
    return extract.spectrum_count(src.frames(spark, d).where("num_peaks < 0"), src.frame_positions(spark, d), F.lit(77))


@query(f"SELECT coalesce(max(o_orderkey % {NX}), 0) + 1 AS nx, coalesce(max((o_orderkey // {NX}) % {NY}), 0) + 1 AS ny, coalesce(max(o_orderkey // {NX * NY}), 0) + 1 AS nz FROM orders")
def dimensions_of_places(spark, d):
    x, y, z = coords.pixel_xyz(F.col("o_orderkey"), NX, NY)
    return extract.dimensions_of_places(src.read(spark, d, "orders").select(x.alias("x"), y.alias("y"), z.alias("z")))


@query("SELECT z, 'msi_z' || z AS \"table\", 'msi_z' || z || '_pixels' AS shapes, 'msi_z' || z || '_tic' AS image, count(*) AS pixels FROM grid GROUP BY z", "grid")
def slice_elements(spark, d):
    return extract.slice_elements(_grid(spark, d), "msi")


@query("SELECT count(DISTINCT z) AS tables_count, count(DISTINCT z) AS shapes_count, count(DISTINCT z) AS images_count FROM grid", "grid")
def element_counts(spark, d):
    return extract.element_counts(extract.slice_elements(_grid(spark, d), "msi"))


@query(f"SELECT count(*) AS spectra, count(*) FILTER (l_orderkey // {NX * NY} = 0) AS in_slices, sum(tic) AS total, coalesce(sum(tic) FILTER (l_orderkey // {NX * NY} = 0), 0.0) AS in_slices_total FROM (SELECT l_orderkey, sum(l_quantity) AS tic FROM lineitem GROUP BY 1)")
def slice_membership(spark, d):
    """With slice 0 the only one known: other spectra are in no slice's matrix and still count in the totals."""
    t = src.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("tic"))
    return stats.slice_membership(t, F.floor(F.col("l_orderkey") / (NX * NY)) == 0)


@query("SELECT p_partkey AS k, coalesce(given, x) AS pixel_size, CASE WHEN given IS NOT NULL THEN 'manual' WHEN x IS NOT NULL THEN 'automatic' ELSE 'none' END AS method, given IS NULL AND x IS NOT NULL AS detection_successful, x AS detected_x, coalesce(y, x) AS detected_y FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size * 1.0::DOUBLE END AS given, CASE WHEN p_partkey % 5 <> 0 THEN p_size * 2.0::DOUBLE END AS x, CASE WHEN p_partkey % 7 = 0 THEN p_size * 3.0::DOUBLE END AS y FROM part)")
def pixel_size_choice(spark, d):
    when = lambda c, n: F.when(c, F.col("p_size") * F.lit(n))
    k = F.col("p_partkey")
    chosen = extract.chosen_pixel_size(when(k % 3 == 0, 1.0), when(k % 5 != 0, 2.0), when(k % 7 == 0, 3.0))
    return src.read(spark, d, "part").select(k.alias("k"), *[c.alias(n) for n, c in chosen.items()])


@query("SELECT accession, split_part(accession, ':', 1) AS prefix, 'https://www.ebi.ac.uk/ols/ontologies/' || lower(split_part(accession, ':', 1)) || '/terms?iri=http://purl.obolibrary.org/obo/' || replace(accession, ':', '_') AS url FROM terms", "terms")
def term_pages(spark, d):
    return src.terms(spark, d).select("accession", *[c.alias(n) for n, c in extract.term_page(F.col("accession")).items()])


@query("SELECT p_partkey AS k, least(10000, p_partkey) AS chunk_c, 1::BIGINT AS chunk_z, least(64, p_size + 40) AS chunk_y, least(64, p_size + 50) AS chunk_x, ceil(p_partkey / least(10000, p_partkey))::BIGINT * 2 * ceil((p_size + 40) / least(64, p_size + 40))::BIGINT * ceil((p_size + 50) / least(64, p_size + 50))::BIGINT AS chunks FROM part WHERE p_partkey > 0")
def chunk_layout(spark, d):
    sizes = extract.chunks((F.col("p_partkey"), F.lit(2), F.col("p_size") + 40, F.col("p_size") + 50))
    return src.read(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("k"), *[c.alias(n) for n, c in sizes.items()])


@query("SELECT spectrum_idx, string_agg(mz, ',' ORDER BY mz, intensity) AS mzs, string_agg(intensity::BIGINT, ',' ORDER BY mz, intensity) AS intensities FROM (SELECT spectrum_idx, (mz * 10)::BIGINT AS mz, intensity FROM peaks) GROUP BY 1", "peaks")
def sorted_peaks(spark, d):
    s = src.peaks(spark, d).groupBy("spectrum_idx").agg(F.collect_list(F.struct("mz", "intensity")).alias("p"))
    s = extract.sorted_peaks(s.select("spectrum_idx", F.col("p.mz").alias("mzs"), F.col("p.intensity").alias("intensities")))
    text = lambda c, n: F.array_join(F.transform(c, lambda v: (v * n).cast("bigint").cast("string")), ",")
    return s.select("spectrum_idx", text("mzs", 10).alias("mzs"), text("intensities", 1).alias("intensities"))


@query("SELECT spectrum_idx, array_to_string(list_transform(range(len(mzs) // 2), lambda k: round(intensities[2 * k + 1] * 1000)::BIGINT), ',') AS row FROM spectra", "spectra")
def dense_read(spark, d):
    """Spectra read onto every other value of their axis: each peak goes to the next value, the last of two stays, what is beyond is left out."""
    s = src.spectra(spark, d)
    places = axis.continuous_axis(s).where("mz_idx % 2 = 0").select((F.col("mz_idx") / 2).cast("bigint").alias("mz_idx"), "mz")
    read = mapping.dense(mapping.map_next(imzml.peaks(s), places), places.count())
    return read.select("spectrum_idx", F.array_join(F.transform("intensities", lambda v: F.round(v * 1000).cast("bigint").cast("string")), ",").alias("row"))


@query("SELECT l_orderkey, l_linenumber, least(greatest(10, least(floor(64 * 1048576.0 / (l_partkey * 12))::BIGINT, 100000, 1000)), 100000) AS batch FROM lineitem WHERE l_partkey > 0")
def batch_size_by_peaks(spark, d):
    size = metadata.batch_size_by_peaks(F.lit(64.0), F.col("l_partkey"), F.lit(100_000))
    return src.read(spark, d, "lineitem").where("l_partkey > 0").select("l_orderkey", "l_linenumber", F.least(size, F.lit(100_000)).cast("bigint").alias("batch"))


@query(
    """SELECT accession, arg_max(name, row(v, k)) AS name, min({'v': v, 'k': k}).v AS first_vocabulary, min({'v': v, 'k': k}).k AS first_seq FROM (
    SELECT 'T:' || n_nationkey AS accession, n_name AS name, 0 AS v, n_nationkey::BIGINT AS k FROM nation UNION ALL SELECT 'T:' || s_suppkey, s_name, 1, s_suppkey FROM supplier UNION ALL SELECT 'T:' || p_partkey // 3, p_name, 2, p_partkey FROM part) GROUP BY accession"""
)
def vocabulary_update(spark, d):
    """Nations, suppliers and parts as three vocabularies that share accessions, the last with several terms each."""
    of = lambda name, key, label, v, by=1: src.read(spark, d, name).select(F.concat(F.lit("T:"), F.floor(F.col(key) / by).cast("string")).alias("accession"), F.col(label).alias("name"), F.lit(None).cast("string").alias("value_type"), F.lit(v).alias("vocabulary"), F.col(key).cast("bigint").alias("seq"))
    terms = of("nation", "n_nationkey", "n_name", 0).union(of("supplier", "s_suppkey", "s_name", 1)).union(of("part", "p_partkey", "p_name", 2, 3))
    return ontology.updated(terms).select("accession", "name", F.col("load_order.vocabulary").alias("first_vocabulary"), F.col("load_order.seq").alias("first_seq"))
