"""imzML, frame databases, conversion, export and streams, on tiny files."""

import json
import sqlite3
import struct
import zlib

import pytest

from spectral_lake.__main__ import describe, main
from spectral_lake.convert import convert
from spectral_lake.errors import ConfigurationError, DecoderError, FormatError
from spectral_lake.sinks import lake, zarr_v2
from spectral_lake.sources import frames, imzml, registry
from spectral_lake.sources.extraction import Extraction
from spectral_lake.streaming import ingest


def write_imzml(path, spectra, kind=imzml.PROCESSED, pack=False):
    cv = lambda a, v="": f'<cvParam cvRef="X" accession="{a}" name="n" value="{v}"/>'
    blob, out = b"0" * 16, []
    for i, (x, y, mz, it, *z) in enumerate(spectra):
        arrays = ""
        for ref, vals in (("m", mz), ("i", it)):
            raw = struct.pack(f"<{len(vals)}d", *vals)
            raw = zlib.compress(raw) if pack else raw
            arrays += f'<binaryDataArray encodedLength="0"><referenceableParamGroupRef ref="{ref}"/>{cv(imzml.LENGTH, len(vals))}{cv(imzml.BYTES, len(raw))}{cv(imzml.OFFSET, len(blob))}<binary/></binaryDataArray>'
            blob += raw
        out.append(f'<spectrum id="s{i}" index="{i}" defaultArrayLength="0"><scanList count="1"><scan>{cv(imzml.X, x)}{cv(imzml.Y, y)}{cv(imzml.Z, z[0] if z else 1)}</scan></scanList><binaryDataArrayList count="2">{arrays}</binaryDataArrayList></spectrum>')
    zip_ = cv(imzml.ZLIB) if pack else ""
    groups = "".join(f'<referenceableParamGroup id="{g}">{cv(a)}{cv("MS:1000523")}{zip_}</referenceableParamGroup>' for g, a in (("m", imzml.MZ), ("i", imzml.INTENSITY)))
    path.write_text(f'<?xml version="1.0"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml"><fileDescription><fileContent>{cv(kind)}</fileContent></fileDescription><referenceableParamGroupList count="2">{groups}</referenceableParamGroupList><scanSettingsList><scanSettings>{cv(imzml.PIXEL_X, 25.0)}{cv(imzml.PIXEL_Y, 20.0)}</scanSettings></scanSettingsList><run><spectrumList count="{len(spectra)}">\n' + "\n".join(out) + "\n</spectrumList></run></mzML>")
    path.with_suffix(".ibd").write_bytes(blob)
    return str(path)


SPECTRA = [(1, 1, [100.0, 200.0], [1.0, 2.0]), (1, 2, [100.0, 300.0], [3.0, 4.0]), (2, 1, [], []), (2, 2, [200.0], [5.0])]


@pytest.mark.parametrize("pack", [False, True])
def test_imzml(spark, tmp_path, pack):
    path = write_imzml(tmp_path / "a.imzML", SPECTRA, pack=pack)
    assert imzml.mode(spark, path) == "processed"
    assert imzml.pixel_size(spark, path) == (25.0, 20.0)
    got = sorted((r["x"], r["y"], r["z"], r["mzs"], r["intensities"]) for r in imzml.read(spark, path).collect())
    assert got == sorted((x - 1, y - 1, 0, m, i) for x, y, m, i in SPECTRA if m)


def test_imzml_needs_one_mode(spark, tmp_path):
    path = write_imzml(tmp_path / "a.imzML", SPECTRA, kind="MS:0")
    with pytest.raises(FormatError):
        imzml.read(spark, path)


def test_convert(spark, tmp_path):
    path, out = write_imzml(tmp_path / "a.imzML", SPECTRA), str(tmp_path / "out")
    assert convert(spark, path, out, "d")
    assert sorted(map(tuple, spark.read.parquet(f"{out}/X").collect())) == [(0, 0, 1.0), (0, 1, 2.0), (2, 0, 3.0), (2, 2, 4.0), (3, 1, 5.0)]
    assert [r["value"] for r in spark.read.parquet(f"{out}/tic").orderBy("pixel_idx").collect()] == [3.0, 0.0, 7.0, 5.0]
    assert spark.read.parquet(f"{out}/obs").count() == spark.read.parquet(f"{out}/shapes").count() == 4
    assert not convert(spark, path, out, "d")  # never overwrites
    assert not convert(spark, str(tmp_path / "none.imzML"), str(tmp_path / "o2"))


def test_slices_are_tables_of_their_own(spark, tmp_path):
    """Two slices of 3 x 3; the middle pixel of each has a spectrum."""
    rows = [(1, 1, [], [], 1), (3, 3, [], [], 2), (2, 2, [200.0, 500.0], [100.0, 200.0], 1), (2, 2, [300.0, 600.0], [150.0, 250.0], 2)]
    out = str(tmp_path / "out")
    assert convert(spark, write_imzml(tmp_path / "a.imzML", rows), out, "t")
    x = spark.read.parquet(f"{out}/X")
    assert {tuple(r) for r in x.select("slice_id", "pixel_idx", "mz_idx", "intensity").collect()} == {("t_z0", 4, 0, 100.0), ("t_z0", 4, 2, 200.0), ("t_z1", 13, 1, 150.0), ("t_z1", 13, 3, 250.0)}
    for name in ("obs", "tic", "shapes"):
        assert {tuple(r) for r in spark.read.parquet(f"{out}/{name}").groupBy("slice_id").count().collect()} == {("t_z0", 9), ("t_z1", 9)}
    assert [r["average"] for r in spark.read.parquet(f"{out}/average_spectrum").orderBy("mz_idx").collect()] == [50.0, 75.0, 100.0, 125.0]
    assert lake.optimise(out) and spark.read.parquet(f"{out}/X").count() == 4 and not (tmp_path / "out" / "X_backup").exists()


def test_each_spectrum_is_decoded_once(spark, tmp_path):
    """169 x 200 places from x 669, y 109 make a grid of their own size, and the decoder is called once a frame."""
    d, calls = tmp_path / "a.d", tmp_path / "calls"
    d.mkdir(), calls.mkdir()
    with sqlite3.connect(d / "analysis.tdf") as con:
        con.executescript("CREATE TABLE Frames(Id INTEGER PRIMARY KEY, NumPeaks INT); CREATE TABLE MaldiFrameInfo(Frame INT, XIndexPos INT, YIndexPos INT); CREATE TABLE GlobalMetadata(Key TEXT, Value TEXT);"
                          "CREATE TABLE MaldiFrameLaserInfo(Id INT, SpotXPos REAL, SpotYPos REAL, BeamScanSizeX REAL, BeamScanSizeY REAL, SpotSize REAL, LaserPower REAL, LaserFrequency REAL); INSERT INTO MaldiFrameLaserInfo VALUES (1, 0, 0, 46, 46, 1, NULL, 1000);"
                          "INSERT INTO Frames VALUES (1, 1), (2, 1); INSERT INTO MaldiFrameInfo VALUES (1, 669, 109), (2, 837, 308);"
                          "INSERT INTO GlobalMetadata VALUES ('ImagingAreaMinXIndexPos', '669'), ('ImagingAreaMaxXIndexPos', '837'), ('ImagingAreaMinYIndexPos', '109'), ('ImagingAreaMaxYIndexPos', '308'), ('MzAcqRangeLower', '40'), ('MzAcqRangeUpper', '600'), ('InstrumentName', 'I'), ('AcquisitionDateTime', '2024-01-01')")

    def decode(path, frame_id, num_peaks):
        with open(calls / str(frame_id), "a") as f:
            f.write("x")
        return [100.0 + frame_id], [float(frame_id)]

    out = str(tmp_path / "out")
    assert convert(spark, str(d), out, decode=decode)
    assert {c.name: c.read_text() for c in calls.iterdir()} == {"1": "x", "2": "x"}
    a = lake.attributes(spark, out)
    assert a["dimensions_xyz"] == [169, 200, 1] and a["total_grid_pixels"] == 33800 and a["pixel_size_detection"]["method"] == "automatic" and a["pixel_size_x_um"] == 46.0
    assert [r["pixel_idx"] for r in spark.read.parquet(f"{out}/X").orderBy("pixel_idx").collect()] == [0, 33799]
    found = {(r["section"], r["key"]): r["value"] for r in spark.read.parquet(f"{out}/metadata").collect()}
    assert found["instrument_info", "instrument_name"] == "I" and found["acquisition_params", "BeamScanSizeX"] == found["acquisition_params", "beam_scan_size_x"] == "46.0"
    assert found["format_specific", "database_path"].endswith("analysis.tdf") and found["raw_metadata", "MzAcqRangeLower"] == "40" and ("acquisition_params", "laser_power") not in found
    one = describe(spark, str(d))
    assert one["essential"]["nx"] == 169 and one["essential"]["mz_max"] == 600.0 and one["essential"]["pixel_size_x"] == 46.0 and one["essential"]["n_spectra"] == 2 and one["acquisition_params"]["acquisition_datetime"] == "2024-01-01"


def test_command_line(spark, tmp_path, capsys):
    path, out = write_imzml(tmp_path / "a.imzML", SPECTRA), tmp_path / "out"
    assert main(["convert", path, str(out), "--pixel-size", "1.0", "--optimize-chunks", "--log-file", str(tmp_path / "log")]) == 0
    a = lake.attributes(spark, str(out))
    assert a["pixel_size_x_um"] == 1.0 and a["pixel_size_detection"] == {"pixel_size": 1.0, "method": "manual", "detection_successful": False, "detected_x": 25.0, "detected_y": 20.0}
    assert spark.read.parquet(f"{out}/X").count() == 5
    assert main(["convert", path, str(out), "--log-file", str(tmp_path / "log")]) == 1 and "exists already" in (tmp_path / "log").read_text()
    assert main(["convert", path, str(tmp_path / "o3"), "--format", "none"]) == 1
    (tmp_path / "t.obo").write_text(f"format-version: 1.2\n\n[Term]\nid: {imzml.PROCESSED}\nname: processed\n\n[Term]\nid: {imzml.X}\nname: position x\n")
    (tmp_path / "deep").mkdir()
    write_imzml(tmp_path / "deep" / "b.imzML", SPECTRA)
    assert main(["check-terms", str(tmp_path), str(tmp_path / "t.obo"), "--output", str(tmp_path / "r.json"), "--verbose"]) == 1
    r = json.loads((tmp_path / "r.json").read_text())
    assert r["files"] == 2 and imzml.MZ in r["unknown_terms"] and imzml.X not in r["unknown_terms"] and len(r["per_file"]) == 2
    one = Extraction(spark, path)
    assert one.summary() == {"kind": "imzml", "dimensions": (2, 2, 1), "n_spectra": 4, "pixel_size": 25.0, "is_3d": False, "memory_gb": 4 * 1000 * 2 * 8 / 1024**3}
    assert one.comprehensive()["format_specific"]["file_mode"] == "processed" and one.comprehensive() is one.comprehensive() and describe(spark, path)["essential"]["n_spectra"] == 4


def test_readers_can_be_registered(spark, tmp_path):
    @registry.register_reader("rows", ".rows")
    def read(spark, path):
        return spark.createDataFrame([(0, 0, 0, 0, [1.0], [2.0]), (1, 2, 1, 0, [1.0, 3.0], [4.0, 5.0])], frames.SPECTRA)

    (tmp_path / "a.ROWS").touch()
    assert registry.detect(str(tmp_path / "a.ROWS")) == "rows"
    assert convert(spark, str(tmp_path / "a.ROWS"), str(tmp_path / "out"), pixel_size_um=5.0) and lake.attributes(spark, str(tmp_path / "out"))["dimensions_xyz"] == [3, 2, 1]
    with pytest.raises(ConfigurationError):
        registry.register_reader("rows")(read)
    with pytest.raises(ConfigurationError):
        registry.converter("none")


def test_frames(spark, tmp_path):
    d = tmp_path / "a.d"
    d.mkdir()
    with sqlite3.connect(d / "analysis.tsf") as con:
        con.executescript("CREATE TABLE Frames(Id INTEGER PRIMARY KEY, NumPeaks INT); CREATE TABLE MaldiFrameInfo(Frame INT, XIndexPos INT, YIndexPos INT); CREATE TABLE GlobalMetadata(Key TEXT, Value TEXT);"
                          "INSERT INTO Frames VALUES (1, 2), (2, 0), (3, 1); INSERT INTO MaldiFrameInfo VALUES (1, 15, 25), (2, 16, 25); INSERT INTO GlobalMetadata VALUES ('MzAcqRangeLower', '100')")
    db = frames.database(str(d))
    assert {tuple(r) for r in frames.frames(spark, db, (5, 15)).collect()} == {(1, 2, 10, 10, 0), (2, 0, 11, 10, 0), (3, 1, 2, 0, 0)}
    with pytest.raises(FormatError, match="MzAcqRangeUpper"):
        frames.mass_range(spark, db)
    with pytest.raises(DecoderError):
        frames.read(spark, str(d))
    got = frames.read(spark, str(d), lambda path, i, n: ([100.0 + i] * n, [1.0] * n)).collect()
    assert sorted((r["spectrum_idx"], r["mzs"]) for r in got) == [(0, [101.0, 101.0]), (2, [103.0])]


def test_laser_and_imaging_area(spark, tmp_path):
    d = tmp_path / "a.d"
    d.mkdir()
    with sqlite3.connect(d / "analysis.tsf") as con:
        con.executescript("CREATE TABLE Frames(Id INTEGER PRIMARY KEY, NumPeaks INT); CREATE TABLE MaldiFrameInfo(Frame INT, XIndexPos INT, YIndexPos INT); CREATE TABLE GlobalMetadata(Key TEXT, Value TEXT);"
                          "CREATE TABLE MaldiFrameLaserInfo(Id INT, BeamScanSizeX REAL, BeamScanSizeY REAL, SpotSize REAL, LaserPower REAL, LaserFrequency REAL); INSERT INTO MaldiFrameLaserInfo VALUES (2, NULL, NULL, 1, 1, 1), (1, 20, 30, 1, 5, 6);"
                          "INSERT INTO Frames VALUES (1, 1), (2, 1); INSERT INTO MaldiFrameInfo VALUES (1, 670, 109), (2, 671, 110); INSERT INTO GlobalMetadata VALUES ('ImagingAreaMinXIndexPos', '669')")
    db = frames.database(str(d))
    assert frames.pixel_size(spark, db) == (20.0, 30.0) and frames.laser(spark, db)["LaserPower"] == 5.0 and frames.offset(spark, db) == (669, 109)
    assert convert(spark, str(d), str(tmp_path / "out"), decode=lambda path, i, n: ([100.0], [1.0]))
    assert spark.read.parquet(str(tmp_path / "out/obs")).count() == 6


def test_detect(tmp_path):
    (tmp_path / "a.imzML").touch()
    with pytest.raises(FormatError, match="ibd"):
        frames.detect(str(tmp_path / "a.imzML"))
    (tmp_path / "a.ibd").touch()
    assert frames.detect(str(tmp_path / "a.imzML")) == "imzml"
    (tmp_path / "b.d").touch()
    for bad in ("b.d", "c.txt", "none.imzML"):
        with pytest.raises(FormatError):
            frames.detect(str(tmp_path / bad))


def test_zarr_round_trip(spark, tmp_path):
    image = spark.range(70 * 3).selectExpr("0 AS z", "id div 70 AS y", "id % 70 AS x", "cast(id AS double) AS value")
    assert zarr_v2.write_image(image, str(tmp_path / "i"), (1, 3, 70)) == 2
    assert zarr_v2.read_image(str(tmp_path / "i"))[0].ravel().tolist() == list(map(float, range(210)))


def test_stream(spark, tmp_path):
    rows = [(i, i, 0, 0, [100.0, 200.0], [1.0, float(i)]) for i in range(4)]
    spark.createDataFrame(rows + rows[:1], ingest.SCHEMA).write.parquet(str(tmp_path / "in"))
    ingest.append_peaks(ingest.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
