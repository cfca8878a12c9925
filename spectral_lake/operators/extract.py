"""Metadata of a data set from its key-value pairs, laser rows and places.

Inputs are tables ``pairs(key, value)``, ``laser(id, spot_x, spot_y, beam_x, beam_y, spot, power,
frequency)``, ``places(x, y)`` and ``frames(frame_id)``; results are one-row tables, or rows of
(section, key, value), so that they join, compare and serialise like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metadata

#: Keys of the vendor's table and of the XML header, and what they are called here.
INSTRUMENT = {
    "InstrumentName": "instrument_name",
    "InstrumentSerialNumber": "instrument_serial_number",
    "InstrumentModel": "instrument_model",
    "SoftwareVersion": "software_version",
    "MzCalibrationMode": "mz_calibration_mode",
}
TIMING = {"AcquisitionDateTime": "acquisition_datetime"}
AREA = {"ImagingAreaMinXIndexPos": "min_x", "ImagingAreaMaxXIndexPos": "max_x", "ImagingAreaMinYIndexPos": "min_y", "ImagingAreaMaxYIndexPos": "max_y"}
MASS = {"MzAcqRangeLower": "mz_min", "MzAcqRangeUpper": "mz_max"}
HEADER_ACQUISITION = ("scan direction", "scan pattern", "scan type", "laser power", "laser frequency", "laser spot size")
HEADER_INSTRUMENT = ("instrument model", "instrument serial number", "software", "software version")
#: Vocabularies with a page for each term, and its address.
BROWSED = ("MS", "IMS", "UO")
TERM_URL = "https://www.ebi.ac.uk/ols/ontologies/%s/terms?iri=http://purl.obolibrary.org/obo/%s"


def laser_row(laser: DataFrame) -> DataFrame:
    """Laser parameters of the first row by id; no row without any."""
    return laser.orderBy("id").limit(1).select(F.col("power").alias("laser_power"), F.col("frequency").alias("laser_frequency"), F.col("beam_x").alias("beam_scan_size_x"), F.col("beam_y").alias("beam_scan_size_y"), F.col("spot").alias("laser_spot_size"))


def area(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Bounds of the imaging area: stated ones, else those of the places, else 0."""
    stated = metadata.pivot_keys(pairs, AREA, "double")
    seen = places.agg(*[f(c).cast("double").alias(f"seen_{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    return stated.crossJoin(F.broadcast(seen)).select(*[F.coalesce(v, f"seen_{v}", F.lit(0.0)).alias(v) for v in AREA.values()])


def offsets(area: DataFrame) -> DataFrame:
    return area.select(F.col("min_x").cast("int").alias("offset_x"), F.col("min_y").cast("int").alias("offset_y"), F.lit(0).alias("offset_z"))


def dimensions(area: DataFrame) -> DataFrame:
    """Inclusive bounds as a grid, at least 1 by 1, one slice."""
    side = lambda c: F.greatest((F.col(f"max_{c}") - F.col(f"min_{c}")).cast("bigint") + 1, F.lit(1)).cast("bigint")
    return area.select(side("x").alias("nx"), side("y").alias("ny"), F.lit(1).cast("bigint").alias("nz"))


def dimensions_of_places(places: DataFrame) -> DataFrame:
    """The greatest place from 0 of each axis, and one; 1 where there is none."""
    return places.agg(*[(F.coalesce(F.max(c), F.lit(0)) + 1).cast("bigint").alias(f"n{c}") for c in "xyz"])


def mass_range(pairs: DataFrame) -> DataFrame:
    """The stated range; an error where a key is missing."""
    got = metadata.pivot_keys(pairs, MASS, "double")
    need = lambda key, name: F.coalesce(name, F.raise_error(F.lit(f"{key} is not stated")).cast("double")).alias(name)
    return got.select(*[need(k, n) for k, n in MASS.items()])


def spectrum_count(frames: DataFrame, places: DataFrame, pixels: Column) -> DataFrame:
    """Frames, else places, else ``pixels`` of the grid: the first that is not 0."""
    n = frames.agg(F.nullif(F.count("*"), F.lit(0)).alias("frames"))
    return n.crossJoin(F.broadcast(places.agg(F.nullif(F.count("*"), F.lit(0)).alias("places")))).select(F.coalesce("frames", "places", pixels.cast("bigint")).alias("n_spectra"))


def essential(pairs: DataFrame, places: DataFrame, laser: DataFrame, frames: DataFrame, peaks: int = 2000) -> DataFrame:
    """What processing needs to know, one row: dimensions, bounds, extent, mass range, pixel size, count, memory, offsets."""
    bounds = area(pairs, places)
    size = laser.orderBy("id").limit(1).agg(F.first("beam_x").alias("pixel_size_x"), F.first("beam_y").alias("pixel_size_y"))
    one = bounds
    for part in (dimensions(bounds), offsets(bounds), mass_range(pairs), size):
        one = one.crossJoin(F.broadcast(part))
    one = one.crossJoin(F.broadcast(spectrum_count(frames, places, F.lit(0))))
    return one.select(
        "nx", "ny", "nz", "min_x", "max_x", "min_y", "max_y", (F.col("max_x") - F.col("min_x")).alias("extent_x"), (F.col("max_y") - F.col("min_y")).alias("extent_y"), "mz_min", "mz_max",
        "pixel_size_x", "pixel_size_y", F.col("pixel_size_x").isNotNull().alias("has_pixel_size"), (F.col("nz") > 1).alias("is_3d"), "n_spectra", metadata.memory_gb(F.col("n_spectra"), peaks).alias("memory_gb"), "offset_x", "offset_y", "offset_z",
    )


def rows_of(one: DataFrame, section: str) -> DataFrame:
    """The columns of a one-row table that have a value, as (section, key, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in one.columns])
    return one.select(F.explode(pairs).alias("p")).select(F.lit(section).alias("section"), "p.key", "p.value").where("value is not null")


def sections(pairs: DataFrame, laser: DataFrame) -> DataFrame:
    """(section, key, value) of acquisition, instrument and raw metadata; a section without values has no rows.

    Beam sizes stand under their plain and their vendor names.
    """
    laser_values = laser_row(laser).withColumn("BeamScanSizeX", F.col("beam_scan_size_x")).withColumn("BeamScanSizeY", F.col("beam_scan_size_y"))
    timing, instrument = metadata.pivot_keys(pairs, TIMING), metadata.pivot_keys(pairs, INSTRUMENT)
    raw = pairs.select(F.lit("raw_metadata").alias("section"), "key", F.col("value").cast("string").alias("value"))
    return rows_of(laser_values, "acquisition_params").union(rows_of(timing, "acquisition_params")).union(rows_of(instrument, "instrument_info")).union(raw)


def header_sections(pairs: DataFrame) -> DataFrame:
    """The same for ``pairs(key, value)`` of an XML header; spaces in keys become underscores."""
    kind = F.when(F.col("key").isin(*HEADER_ACQUISITION), "acquisition_params").when(F.col("key").isin(*HEADER_INSTRUMENT), "instrument_info")
    known = pairs.withColumn("section", kind).where("section is not null").select("section", F.replace("key", F.lit(" "), F.lit("_")).alias("key"), "value")
    return known.union(pairs.select(F.lit("raw_metadata").alias("section"), "key", "value"))


def nonempty(sections: DataFrame) -> DataFrame:
    """``sections(section, key, value)`` without those that have no value at all, and without rows of no section."""
    full = sections.where("section is not null").groupBy("section").agg(F.count("value").alias("_n")).where("_n > 0")
    return sections.join(full.select("section"), "section", "left_semi")


def as_json(sections: DataFrame) -> DataFrame:
    """One row: a JSON document with an object for each section that has rows."""
    per = sections.groupBy("section").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", "value")))).alias("values"))
    return per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("section", "values")))).alias("document"))


def chosen_pixel_size(given: Column, found_x: Column, found_y: Column) -> dict[str, Column]:
    """The pixel size in use and where it is from: a given one wins, else the file's."""
    return {
        "pixel_size": F.coalesce(given, found_x),
        "method": F.when(given.isNotNull(), "manual").when(found_x.isNotNull(), "automatic").otherwise("none"),
        "detection_successful": given.isNull() & found_x.isNotNull(),
        "detected_x": found_x,
        "detected_y": F.coalesce(found_y, found_x),
    }


def term_page(accession: Column) -> dict[str, Column]:
    """The vocabulary of an accession, and the address of its page if there is one."""
    name = F.when(F.contains(accession, F.lit(":")), F.split_part(accession, F.lit(":"), F.lit(1)))
    url = F.format_string(TERM_URL, F.lower(name), F.replace(accession, F.lit(":"), F.lit("_")))
    return {"prefix": F.coalesce(name, F.lit("OTHER")), "url": F.when(name.isin(*BROWSED), url)}


def chunks(shape: tuple[Column, Column, Column, Column]) -> dict[str, Column]:
    """Chunk sizes of a stored array (c, z, y, x): long along c, one slice, tiles of 64; and how many chunks that makes."""
    c, z, y, x = shape
    sizes = {"chunk_c": F.least(F.lit(10_000), c), "chunk_z": F.lit(1), "chunk_y": F.least(F.lit(64), y), "chunk_x": F.least(F.lit(64), x)}
    number = F.lit(1)
    for n, size in zip(shape, sizes.values(), strict=True):
        number = number * F.ceil(n / size)
    return {k: v.cast("bigint") for k, v in sizes.items()} | {"chunks": number.cast("bigint")}


def sorted_peaks(spectra: DataFrame) -> DataFrame:
    """Both arrays of each spectrum in order of m/z; of equal values the lesser intensity first."""
    zipped = F.array_sort(F.arrays_zip("mzs", "intensities"))
    rest = [c for c in spectra.columns if c not in ("mzs", "intensities")]
    return spectra.select(*rest, zipped.alias("z")).select(*rest, F.col("z.mzs").alias("mzs"), F.col("z.intensities").alias("intensities"))


def slice_elements(pixels: DataFrame, dataset_id: str) -> DataFrame:
    """Names of the table, shapes and image of each slice, and how many pixels it has."""
    name = F.concat(F.lit(f"{dataset_id}_z"), F.col("z").cast("string"))
    per = pixels.groupBy("z").agg(F.count("*").alias("pixels"))
    return per.select("z", name.alias("table"), F.concat(name, F.lit("_pixels")).alias("shapes"), F.concat(name, F.lit("_tic")).alias("image"), "pixels")


def element_counts(elements: DataFrame) -> DataFrame:
    return elements.agg(F.count_distinct("table").alias("tables_count"), F.count_distinct("shapes").alias("shapes_count"), F.count_distinct("image").alias("images_count"))
