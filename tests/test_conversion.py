"""Conversion that is whole or not there, the imzML data source, weighted stretches of frames, accounting and progress."""

import sqlite3
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import SPECTRA, write_imzml

from spectral_lake import convert as conversion
from spectral_lake import storage
from spectral_lake.convert import convert
from spectral_lake.errors import ConfigurationError, ImagingError
from spectral_lake.operators import accounting, axis, balance
from spectral_lake.progress import reported
from spectral_lake.sinks import lake
from spectral_lake.sources import decoding, frames, imzml, imzml_source


def frame_folder(path, peaks, places=True):
    path.mkdir()
    with sqlite3.connect(path / "analysis.tdf") as con:
        con.execute("CREATE TABLE Frames(Id INTEGER PRIMARY KEY, NumPeaks INT)")
        con.executemany("INSERT INTO Frames VALUES (?, ?)", [(i + 1, n) for i, n in enumerate(peaks)])
        if places:
            con.execute("CREATE TABLE MaldiFrameInfo(Frame INT, XIndexPos INT, YIndexPos INT)")
            con.executemany("INSERT INTO MaldiFrameInfo VALUES (?, ?, ?)", [(i + 1, 10 + i % 7, 20 + i // 7) for i in range(len(peaks))])
    return str(path)


# --- whole or not there -----------------------------------------------------------------


def test_a_failing_conversion_leaves_nothing_and_can_be_tried_again(spark, tmp_path):
    source, out = frame_folder(tmp_path / "a.d", [2, 3, 1]), str(tmp_path / "out")

    def broken(path, i, n):
        raise SystemExit("the whole worker")

    assert not convert(spark, source, out, pixel_size_um=1.0, decode=broken)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.d"]
    assert convert(spark, source, out, pixel_size_um=1.0, decode=lambda path, i, n: ([float(k) for k in range(n)], [1.0] * n))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.d", "out"] and not (tmp_path / "out" / "_axis").exists()
    assert spark.read.parquet(f"{out}/X").count() == 6


@pytest.mark.parametrize("late", ["assemble", "write"])
def test_a_failure_after_the_spectra_leaves_nothing(spark, tmp_path, monkeypatch, late):
    path, out = write_imzml(tmp_path / "a.imzML", SPECTRA), str(tmp_path / "out")
    with monkeypatch.context() as m:
        m.setattr(conversion if late == "assemble" else lake, "assemble" if late == "assemble" else "attributes", lambda *a, **b: 1 / 0)
        if late == "write":
            m.setattr(conversion.images, "var_table", lambda common: common.select(F.raise_error(F.lit("no room")).alias("mz")))
        assert not convert(spark, path, out, "d")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.ibd", "a.imzML"]
    assert convert(spark, path, out, "d")


def test_whole_folders(spark, tmp_path):
    to = str(tmp_path / "t")
    with storage.whole(spark, to) as stage:
        spark.range(3).write.parquet(stage)
        assert not storage.exists(spark, to)
    assert spark.read.parquet(to).count() == 3
    with pytest.raises(ImagingError, match="exists"), storage.whole(spark, to):
        raise AssertionError("not reached")
    with pytest.raises(ZeroDivisionError), storage.whole(spark, to, replace=True) as stage:
        spark.range(5).write.parquet(stage)
        1 / 0
    assert spark.read.parquet(to).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]
    with storage.whole(spark, to, replace=True) as stage:
        spark.range(5).write.parquet(stage)
    assert spark.read.parquet(to).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(ImagingError), storage.whole(spark, str(tmp_path / "u")) as stage:  # another writer was first
        spark.range(5).write.parquet(stage)
        spark.range(1).write.parquet(str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 1


def test_the_axis_is_computed_once(spark, tmp_path, monkeypatch):
    calls, real = [], axis.processed_axis
    monkeypatch.setattr(axis, "processed_axis", lambda peaks: calls.append(1) or real(peaks))
    given = []
    monkeypatch.setattr(conversion, "assemble", lambda *a, f=conversion.assemble: given.append(a[-1]) or f(*a))
    assert convert(spark, write_imzml(tmp_path / "a.imzML", SPECTRA), str(tmp_path / "out"), "d")
    assert len(calls) == 1 and all("_axis" in f for f in given[0].inputFiles()) and given[0].inputFiles()


# --- accounting and progress ------------------------------------------------------------


def damaged(path):
    """Six spectra: two good, one empty, one beyond the file, one of unequal arrays, one without intensities."""
    import re

    write_imzml(path, [(1, 1, [1.0, 2.0], [3.0, 4.0]), (2, 1, [], []), (1, 2, [1.0], [2.0]), (2, 2, [1.0, 2.0], [2.0, 3.0]), (3, 1, [5.0], [6.0]), (3, 2, [7.0], [8.0])])
    text = path.read_text()
    parts = text.split("<spectrum ")
    parts[3] = re.sub(rf'({imzml.OFFSET}" name="n" value=")\d+', r"\g<1>999999", parts[3])
    parts[4] = re.sub(rf'({imzml.LENGTH}" name="n" value=")2(.*?{imzml.BYTES}" name="n" value=")16', r"\g<1>1\g<2>8", parts[4], count=1, flags=re.S)
    parts[6] = re.sub(r"<binaryDataArray [^>]*><referenceableParamGroupRef ref=\"i\".*?</binaryDataArray>", "", parts[6], flags=re.S)
    path.write_text("<spectrum ".join(parts))
    return str(path)


def test_what_became_of_each_spectrum(spark, tmp_path, caplog):
    path, out = damaged(tmp_path / "a.imzML"), str(tmp_path / "out")
    bad = {r["spectrum_idx"]: r["error"] for r in imzml.read(spark, path, keep_bad=True).collect()}
    assert bad[0] is bad[1] is bad[4] is None and [bad[i].split(":")[0] for i in (2, 3, 5)] == ["range", "lengths", "missing"]
    with caplog.at_level("WARNING", logger="spectral_lake"):
        assert convert(spark, path, out, "d")
    assert "3 of 6 spectra were skipped" in caplog.text
    stats = lake.attributes(spark, out)["processing_stats"]
    assert {k: stats[k] for k in ("spectra", "read", "empty", "range", "lengths", "missing", "corrupt", "decoder", "other", "peaks", "most_peaks")} == {"spectra": 6, "read": 2, "empty": 1, "range": 1, "lengths": 1, "missing": 1, "corrupt": 0, "decoder": 0, "other": 0, "peaks": 3, "most_peaks": 2}
    assert stats["seconds"] > 0 and lake.attributes(spark, out)["conversion_info"]["kind"] == "imzml"
    assert spark.read.parquet(f"{out}/spectra").count() == 2


def test_a_decoder_that_fails_on_some_frames(spark, tmp_path):
    def decode(path, i, n):
        if i == 2:
            raise ValueError("bad frame")
        return [1.0] * n, [2.0] * (n + (i == 3))

    out = str(tmp_path / "out")
    assert convert(spark, frame_folder(tmp_path / "a.d", [1, 2, 3, 4, 0]), out, pixel_size_um=2.0, decode=decode)
    stats = lake.attributes(spark, out)["processing_stats"]
    assert (stats["spectra"], stats["read"], stats["decoder"], stats["lengths"], stats["peaks"]) == (4, 2, 1, 1, 5)


def test_accounts(spark):
    rows = [([1.0], [1.0], None), ([], [], None), (None, None, None), (None, None, "corrupt: x"), (None, None, "strange"), ([1.0, 2.0], [1.0, 2.0], None)]
    df = spark.createDataFrame(rows, "mzs array<double>, intensities array<double>, error string")
    got = accounting.account(df).first().asDict()
    assert {k: v for k, v in got.items() if v} == {"spectra": 6, "read": 2, "empty": 2, "corrupt": 1, "other": 1, "peaks": 3, "most_peaks": 2}
    assert not any(accounting.account(df.limit(0)).first().asDict().values())


def test_progress(spark, tmp_path):
    told = []
    assert convert(spark, write_imzml(tmp_path / "a.imzML", SPECTRA), str(tmp_path / "out"), "d", progress=lambda done, known: told.append((done, known)))
    assert len(told) >= 2 and all(a < b for (a, _), (b, _) in zip(told, told[1:])) and all(d <= k for d, k in told)
    before = spark.sparkContext.getLocalProperty("spark.jobGroup.id")
    with reported(spark, lambda done, known: 1 / 0):
        assert spark.range(10).count() == 10
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == before


# --- the data source --------------------------------------------------------------------


def grid(n):
    rng = np.random.default_rng(1)
    return [(1 + k % n, 1 + k // n, sorted(rng.random(m := int(rng.integers(1, 40))).tolist()), rng.random(m).tolist()) for k in range(n * n)]


def test_a_filter_keeps_ranges_unread(spark, tmp_path):
    spectra = grid(12)
    path = write_imzml(tmp_path / "a.imzML", spectra)
    log = tmp_path / "a.ibd.log"
    options = {"filesystem": "counted_files:counted"}
    spark.sparkContext.addPyFile(str(Path(__file__).with_name("counted_files.py")))

    def read(df):
        log.unlink(missing_ok=True)
        rows = df.collect()
        return rows, sum(int(x.split()[1]) for x in log.read_text().splitlines()) if log.exists() else 0

    imzml_source.register(spark)
    uri = "counted://" + path
    full, all_bytes = read(imzml.scan(spark, uri, **options))
    assert len(full) == 144 and all_bytes >= sum(16 * len(s[2]) for s in spectra)
    one, some_bytes = read(imzml.scan(spark, uri, **options).where("x = 3 and y >= 5 and y < 7"))
    assert sorted((r["x"], r["y"], r["mzs"]) for r in one) == sorted((x - 1, y - 1, m) for x, y, m, _ in spectra if x == 4 and y in (6, 7))
    assert 0 < some_bytes < all_bytes / 5
    places, no_bytes = read(imzml.scan(spark, uri, "spectrum_idx bigint, x int, y int", **options).where("x in (1, 2)"))
    assert len(places) == 24 and no_bytes == 0
    kept, _ = read(imzml.scan(spark, uri, **options).where("x = 3 or y = 2").where("size(mzs) > 5"))  # what cannot be pushed stays with Spark
    assert len(kept) == sum((x == 4 or y == 3) and len(m) > 5 for x, y, m, _ in spectra)


@pytest.mark.parametrize("split", [200, 5000, 1 << 25])
def test_splits_lose_and_repeat_nothing(spark, tmp_path, split):
    spectra = grid(5)
    path = write_imzml(tmp_path / "a.imzML", spectra, pack=split == 5000)
    got = imzml.scan(spark, "file://" + path, split=str(split))
    assert got.rdd.getNumPartitions() == max(1, -(-(tmp_path / "a.imzML").stat().st_size // split))
    assert sorted((r["x"], r["y"], r["mzs"], r["intensities"]) for r in got.collect()) == sorted((x - 1, y - 1, m, i) for x, y, m, i in spectra)


def test_blocks_that_cut_a_tag(spark, tmp_path, monkeypatch):
    spectra = grid(3)
    path = write_imzml(tmp_path / "a.imzML", spectra)
    size = (tmp_path / "a.imzML").stat().st_size
    for block in (1, 7, 64, 1000):
        monkeypatch.setattr(imzml_source, "BLOCK", block)
        for step in (333, size):
            found = [e for lo in range(0, size, step) for e in imzml_source.elements(path, lo, min(size, lo + step))]
            assert [e.count(b"<spectrum ") for e in found] == [1] * 9
    (tmp_path / "cut.imzML").write_bytes((tmp_path / "a.imzML").read_bytes()[:-600])
    assert len(list(imzml_source.elements(str(tmp_path / "cut.imzML"), 0, size))) == 8


def test_batches_are_bounded_by_peaks():
    out = decoding.Batches(["spectrum_idx", "mzs", "intensities", "error"], peaks=10, rows=4)
    sizes = [3, 4, 5, 30, 0, 1, 1, 1, 1, None]
    batches = [b for i, n in enumerate(sizes) for b in out.add((i, 0, 0, 0), *([None] * 2 if n is None else [np.ones(n)] * 2), None)] + list(out.rest())
    assert [b.num_rows for b in batches] == [2, 1, 1, 4, 2]
    assert [len(v) if v is not None else None for b in batches for v in b.column("mzs").to_pylist()] == sizes
    assert storage.merged([(50, 60), (0, 10), (12, 20), (11, 15)], gap=5) == [(0, 20), (50, 60)]


def test_file_systems_by_name(tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    for uri in (str(tmp_path / "f"), f"file://{tmp_path}/f", f"file:{tmp_path}/f"):
        assert storage.size(uri) == 3 and storage.read(uri) == b"abc"
    assert storage.size(str(tmp_path / "none")) is None
    with pytest.raises(ConfigurationError):
        storage.locate("x://y", "no_such_module:f")
    storage.write(str(tmp_path / "deep" / "g"), b"1")
    storage.write(str(tmp_path / "deep" / "g"), b"22")
    assert storage.read(f"file://{tmp_path}/deep/g") == b"22" and len(list((tmp_path / "deep").iterdir())) == 1


# --- stretches of equal weight ----------------------------------------------------------


def test_no_task_has_much_more_than_the_mean(spark, tmp_path):
    rng = np.random.default_rng(6)
    peaks = [int(n) for n in np.minimum(rng.pareto(1.1, 3000) * 50, 4000)]  # a few frames hold most peaks
    peaks = sorted(peaks, reverse=True)  # and stand together
    source = frame_folder(tmp_path / "a.d", peaks)
    got = frames.read(spark, source, lambda path, i, n: ([float(i)] * n, [1.0] * n), parts=16)
    per = [r[0] for r in got.groupBy(F.spark_partition_id()).agg(F.sum(F.size("mzs"))).select(F.col("sum(size(mzs))")).collect()]
    assert len(per) == 16 and max(per) <= 1.2 * sum(per) / 16 and sum(per) == sum(peaks)
    assert sorted(r["spectrum_idx"] for r in got.collect()) == [i for i, n in enumerate(peaks) if n]
    stretches = frames.partitions(spark, frames.database(source), 16)
    assert all(a <= b < c for (a, b), (c, _) in zip(stretches, stretches[1:]))


def test_frames_without_places_or_peaks(spark, tmp_path):
    got = frames.read(spark, frame_folder(tmp_path / "a.d", [1, 0, 2, 70_000], places=False), lambda path, i, n: ([1.0] * n, [1.0] * n))
    assert sorted((r["spectrum_idx"], r["x"], r["y"]) for r in got.collect()) == [(0, 0, 0), (2, 2, 0)]
    assert frames.read(spark, frame_folder(tmp_path / "b.d", [0, 0]), lambda path, i, n: ([], [])).collect() == []


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_prefix_sums_and_cuts(spark, width):
    rows = [(k * 3 - 20, w) for k, w in enumerate([5, None, 0, 7, 1, 1, 0, 40, 2, 2, 2])]
    df = spark.createDataFrame(rows, "k bigint, w int").repartition(4)
    got = {r["k"]: r["before"] for r in balance.prefix_sums(df, "k", F.col("w"), width).collect()}
    seen = 0
    for k, w in rows:
        assert got[k] == seen
        seen += w or 0
    parts = balance.cuts(df, "k", F.col("w"), 4, width).orderBy("part").collect()
    assert sum(r["n"] for r in parts) == 11 and sum(r["weight"] for r in parts) == 60 and max(r["weight"] for r in parts) <= 60 / 4 + 40
    assert [r["part"] for r in balance.cuts(df.withColumn("w", F.lit(0)), "k", F.col("w"), 4, width).collect()] == [0]
    assert balance.cuts(df.limit(0), "k", F.col("w"), 4, width).collect() == []


def test_laser_rows_and_counts(spark, tmp_path):
    source = frame_folder(tmp_path / "a.d", [1, 0, 2])
    db = frames.database(source)
    assert not frames.is_maldi(spark, db) and frames.laser_spots(spark, db).collect() == []
    assert frames.spectrum_count(spark, db) == 3
    with sqlite3.connect(db) as con:
        con.execute("CREATE TABLE MaldiFrameLaserInfo(Id INT, SpotXPos REAL, SpotYPos REAL, BeamScanSizeX REAL, BeamScanSizeY REAL)")
        con.execute("INSERT INTO MaldiFrameLaserInfo VALUES (1, 2, 3, 4, 5)")
        con.execute("DELETE FROM Frames")
    assert frames.is_maldi(spark, db) and [tuple(r) for r in frames.laser_spots(spark, db).collect()] == [(1, 2.0, 3.0, 4.0, 5.0)]
    assert frames.spectrum_count(spark, db) == 3  # places, as there are no frames
    with sqlite3.connect(db) as con:
        con.execute("DROP TABLE MaldiFrameInfo")
    assert frames.spectrum_count(spark, db, (4, 5, 1)) == 20


def test_conversion_from_and_to_uris(spark, tmp_path):
    write_imzml(tmp_path / "a.imzML", SPECTRA)
    assert convert(spark, f"file://{tmp_path}/a.imzML", f"file://{tmp_path}/out", "d", output_format="zarr")
    assert spark.read.parquet(str(tmp_path / "out" / "X")).count() == 5 and (tmp_path / "out" / "tables" / "d" / "X" / "indptr" / "0").exists()
    (tmp_path / "a.ibd").unlink()
    assert not convert(spark, f"file://{tmp_path}/a.imzML", f"file://{tmp_path}/again", "d")


def test_a_source_without_a_usable_spectrum(spark, tmp_path):
    assert not convert(spark, write_imzml(tmp_path / "a.imzML", [(1, 1, [], []), (1, 2, [], [])]), str(tmp_path / "out"), "d")
    assert not convert(spark, frame_folder(tmp_path / "b.d", [3, 2]), str(tmp_path / "out"), pixel_size_um=1.0, decode=lambda path, i, n: 1 / 0)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.ibd", "a.imzML", "b.d"]
