"""Chunked arrays: sparse rows, rechunking, cells; against numpy and the table they came from."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectral_lake import storage
from spectral_lake.errors import ConfigurationError, FormatError, ResourceError
from spectral_lake.sinks import zarr_v2 as z


def csr_by_hand(path):
    """indptr, indices, data as a reader without Spark sees them."""
    return [z.read_image(f"{path}/{name}") for name in ("indptr", "indices", "data")]


@pytest.mark.parametrize(("rows_a_chunk", "entries_a_chunk"), [(4, 3), (5, 1000), (1000, 7), (10, 1)])
def test_sparse_rows(spark, tmp_path, rows_a_chunk, entries_a_chunk):
    rng = np.random.default_rng(1)
    dense = np.where(rng.random((25, 13)) < 0.2, rng.normal(size=(25, 13)), 0.0)
    dense[[0, 7, 8, 9, 10, 11, 24]] = 0.0  # empty rows, at both ends and over whole chunks
    dense[3] = np.arange(1, 14)
    cells = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    df = spark.createDataFrame(cells, "pixel_idx bigint, mz_idx bigint, intensity double").repartition(6)
    path = f"file://{tmp_path}/tables/t/X"
    assert z.write_csr(df, path, dense.shape, rows_a_chunk, entries_a_chunk) == len(cells)
    indptr, indices, data = csr_by_hand(path)
    assert indptr.tolist() == [0, *np.cumsum((dense != 0).sum(axis=1)).tolist()]
    got = np.zeros_like(dense)
    for i in range(25):
        got[i, indices[indptr[i] : indptr[i + 1]]] = data[indptr[i] : indptr[i + 1]]
        assert (np.diff(indices[indptr[i] : indptr[i + 1]]) > 0).all()
    assert (got == dense).all()
    assert sorted(map(tuple, z.read_csr(spark, path).collect())) == sorted(cells)
    assert json.loads(storage.read(f"{path}/.zattrs")) == {"encoding-type": "csr_matrix", "encoding-version": "0.1.0", "shape": [25, 13]}


def test_sparse_rows_without_entries_or_outside(spark, tmp_path):
    none = spark.createDataFrame([], "pixel_idx bigint, mz_idx bigint, intensity double")
    assert z.write_csr(none, str(tmp_path / "X"), (6, 4), 3) == 0
    assert csr_by_hand(tmp_path / "X")[0].tolist() == [0] * 7 and z.read_csr(spark, str(tmp_path / "X")).collect() == []
    for cell in ((6, 0, 1.0), (0, 4, 1.0)):
        with pytest.raises(Exception, match="outside the matrix"):
            z.write_csr(spark.createDataFrame([cell], none.schema), str(tmp_path / f"Y{cell[0]}"), (6, 4))


def test_many_entries_are_dealt_over_tasks(spark, tmp_path):
    """200,000 cells of 2,000 rows, one of which has a quarter of all."""
    df = spark.range(200_000).select(F.when(F.col("id") % 4 == 0, 7).otherwise(F.col("id") % 2000).cast("bigint").alias("pixel_idx"), F.col("id").alias("mz_idx"), (F.col("id") + 0.5).alias("intensity"))
    assert z.write_csr(df, str(tmp_path / "X"), (2000, 200_000), 256, 1 << 12) == 200_000
    back = z.read_csr(spark, str(tmp_path / "X"))
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    assert len(list((tmp_path / "X" / "data").iterdir())) == 49 + 1


def test_the_matrix_is_computed_once_and_entries_are_dealt_by_chunk(spark, tmp_path, monkeypatch):
    """Steps read the matrix as held; a task sorts one chunk of entries, and nothing stays in the shared folder."""
    seen, parts, real = spark.sparkContext.accumulator(0), [], z._by_chunk

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    def by_chunk(df, n):
        dealt = real(df, n)
        parts.append(dealt.groupBy(F.spark_partition_id()).agg(F.count_distinct("chunk")).toPandas().iloc[:, 1].tolist())
        return dealt

    df = spark.range(5000).select((F.col("id") % 300 * 3).alias("pixel_idx"), F.col("id").alias("mz_idx"), (F.col("id") + 0.5).alias("intensity"))
    shared = Path(storage.shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    monkeypatch.setattr(z, "_by_chunk", by_chunk)
    assert z.write_csr(df.mapInArrow(counted, df.schema), str(tmp_path / "X"), (900, 5000), 64, 512) == 5000
    assert seen.value == 5000
    assert sorted(parts[0]) == [1] * 10 and sorted(parts[1]) == [1] * 15
    assert set(shared.iterdir()) == before
    back = z.read_csr(spark, str(tmp_path / "X"))
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()


@pytest.mark.parametrize("new", [(5, 7), (64, 1), (1, 64), (30, 30), (100, 90)])
def test_rechunking(spark, tmp_path, new):
    values = np.random.default_rng(2).normal(size=(61, 83))
    values[:30, :30] = 0
    layout = z.Layout(values.shape, (30, 20))
    path, out = str(tmp_path / "a"), str(tmp_path / "b")
    z.create(path, layout, {"unit": "counts"})
    for number in range(np.prod(layout.grid)):
        i, j = np.unravel_index(number, layout.grid)
        block = np.zeros(layout.chunks)
        part = values[i * 30 : i * 30 + 30, j * 20 : j * 20 + 20]
        block[: part.shape[0], : part.shape[1]] = part
        if block.any():  # a chunk of fill values is absent
            storage.write(f"{path}/{i}.{j}", layout.pack(block))
    n = z.rechunk(spark, path, out, new)
    assert (z.read_image(out) == values).all() and z.layout_of(out).chunks == new and 0 < n <= np.prod(z.layout_of(out).grid)
    assert json.loads(storage.read(f"{out}/.zattrs")) == {"unit": "counts"}
    with pytest.raises(Exception, match="exists"):
        z.rechunk(spark, path, out, new)
    z.rechunk(spark, out, str(tmp_path / "c"), (30, 20))
    assert (z.read_image(str(tmp_path / "c")) == values).all()


def test_rechunking_four_axes_by_default(spark, tmp_path):
    values = np.arange(3 * 2 * 70 * 65, dtype="<i4").reshape(3, 2, 70, 65)
    layout = z.Layout(values.shape, (3, 2, 70, 65), "<i4", None)
    z.create(str(tmp_path / "a"), layout)
    storage.write(str(tmp_path / "a" / "0.0.0.0"), layout.pack(values))
    assert z.rechunk(spark, str(tmp_path / "a"), str(tmp_path / "b")) == 8
    assert z.layout_of(str(tmp_path / "b")).chunks == (3, 1, 64, 64) == z.default_chunks(values.shape)
    assert (z.read_image(str(tmp_path / "b")) == values).all()


def test_what_cannot_be(spark, tmp_path):
    z.create(str(tmp_path / "a"), z.Layout((4, 4), (2, 2)))
    with pytest.raises(ConfigurationError):
        z.rechunk(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    for bad in ((2,), (0, 2)):
        with pytest.raises(ConfigurationError):
            z.rechunk(spark, str(tmp_path / "a"), str(tmp_path / "b"), bad)
    with pytest.raises(ResourceError):
        z.Layout((1 << 20, 1 << 20), (1 << 15, 1 << 15))
    with pytest.raises(FormatError):
        z.layout_of(str(tmp_path / "none"))
    assert z.rechunk(spark, str(tmp_path / "a"), str(tmp_path / "b"), (4, 1)) == 0 and (z.read_image(str(tmp_path / "b")) == 0).all()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_cells_of_an_array(spark, tmp_path):
    image = spark.range(5 * 70 * 65).selectExpr("id div 4550 AS z", "id div 65 % 70 AS y", "id % 65 AS x", "cast(id % 97 AS double) AS value")
    assert z.write_image(image.where("z <> 2"), str(tmp_path / "i"), (5, 70, 65)) == 16
    back = z.read_cells(spark, str(tmp_path / "i"))
    want = image.withColumn("value", F.expr("IF(z = 2, 0.0, value)"))
    assert back.count() == 5 * 70 * 65 and back.exceptAll(want).isEmpty()
    with pytest.raises(ConfigurationError):
        z.write_image(image, str(tmp_path / "i"), (5, 70, 65))


def test_conversion_to_a_bundle(spark, tmp_path):
    from test_sources import SPECTRA, write_imzml

    from spectral_lake.convert import convert

    path, out = write_imzml(tmp_path / "a.imzML", SPECTRA), tmp_path / "out"
    assert convert(spark, path, str(out), "d", output_format="zarr")
    back = z.read_csr(spark, f"{out}/tables/d/X")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, spark.read.parquet(f"{out}/X").collect())) and back.count() == 5
    assert z.read_image(f"{out}/images/d_tic")[0].tolist() == [[3.0, 0.0], [7.0, 5.0]]


def test_each_slice_has_its_arrays(spark, tmp_path):
    from test_sources import write_imzml

    from spectral_lake.convert import convert

    rows = [(1, 1, [], [], 1), (3, 2, [], [], 2), (2, 2, [200.0, 500.0], [100.0, 200.0], 1), (3, 1, [300.0, 500.0], [150.0, 250.0], 2)]
    assert convert(spark, write_imzml(tmp_path / "a.imzML", rows), str(tmp_path / "out"), "t", output_format="zarr")
    got = {k: sorted(map(tuple, z.read_csr(spark, f"{tmp_path}/out/tables/t_z{k}/X").collect())) for k in (0, 1)}
    assert got == {0: [(4, 0, 100.0), (4, 2, 200.0)], 1: [(2, 1, 150.0), (2, 2, 250.0)]}
    assert z.read_image(f"{tmp_path}/out/images/t_z1_tic")[0].tolist() == [[0.0, 0.0, 400.0], [0.0, 0.0, 0.0]]
