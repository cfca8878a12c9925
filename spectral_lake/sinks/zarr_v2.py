"""Chunked arrays in the Zarr v2 layout: images, sparse matrices as CSR, and rechunking.

Every chunk is written by one task, whole, from rows that a shuffle has brought together; nothing
passes through the driver but shapes.  Paths may be on any file system that ``storage`` opens.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from ..errors import ConfigurationError, FormatError, ResourceError
from ..operators import balance

#: Bytes of a chunk at most: a task holds one read and one written.
LARGEST = 256 << 20


@dataclass(frozen=True)
class Layout:
    """Shape, chunks and kind of an array; chunks are compressed with zlib or not at all."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str = "<f8"
    level: int | None = 1
    fill: float = 0.0

    def __post_init__(self) -> None:
        if len(self.shape) != len(self.chunks) or min(self.chunks, default=1) < 1 or min(self.shape, default=0) < 0:
            raise ConfigurationError(f"chunks {self.chunks} do not fit the shape {self.shape}")
        if self.chunk_size * np.dtype(self.dtype).itemsize > LARGEST:
            raise ResourceError(f"a chunk of {self.chunks} is larger than {LARGEST} bytes")

    @property
    def grid(self) -> tuple[int, ...]:
        """Chunks along each axis."""
        return tuple(ceil(n / c) for n, c in zip(self.shape, self.chunks, strict=True))

    @property
    def chunk_size(self) -> int:
        return prod(self.chunks)

    def name(self, number: int) -> str:
        return ".".join(map(str, np.unravel_index(number, self.grid))) if self.grid else "0"

    def empty(self) -> np.ndarray:
        return np.full(self.chunk_size, self.fill, self.dtype)

    def pack(self, values: np.ndarray) -> bytes:
        raw = np.ascontiguousarray(values, self.dtype).tobytes()
        return raw if self.level is None else zlib.compress(raw, self.level)

    def unpack(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw if self.level is None else zlib.decompress(raw), self.dtype).reshape(self.chunks)

    def document(self) -> dict:
        integer = np.dtype(self.dtype).kind in "iu"
        codec = None if self.level is None else {"id": "zlib", "level": self.level}
        return {"zarr_format": 2, "shape": list(self.shape), "chunks": list(self.chunks), "dtype": self.dtype, "order": "C", "fill_value": int(self.fill) if integer else self.fill, "filters": None, "compressor": codec}


def _put(path: str, document: dict) -> None:
    storage.write(path, json.dumps(document, indent=1).encode())


def create(path: str, layout: Layout, attributes: dict | None = None) -> None:
    _put(f"{path}/.zarray", layout.document())
    if attributes:
        _put(f"{path}/.zattrs", attributes)


def layout_of(path: str) -> Layout:
    if storage.size(f"{path}/.zarray") is None:
        raise FormatError(f"{path}: is not an array")
    d = json.loads(storage.read(f"{path}/.zarray"))
    codec = d["compressor"]
    if d["order"] != "C" or d["filters"] or codec and codec["id"] != "zlib":
        raise FormatError(f"{path}: only C order, no filters, and zlib or no compression can be read")
    return Layout(tuple(d["shape"]), tuple(d["chunks"]), d["dtype"], codec["level"] if codec else None, d["fill_value"] or 0)


def _chunk(path: str, layout: Layout, number: int) -> np.ndarray | None:
    """A chunk's values, None if it was never written."""
    at = f"{path}/{layout.name(number)}"
    return None if storage.size(at) is None else layout.unpack(storage.read(at))


# --- cells to chunks and back -----------------------------------------------------------


def _parts(layout: Layout) -> int:
    """A partition for each chunk, up to 10,000."""
    return max(1, min(prod(layout.grid), 10_000))


def _by_chunk(df: DataFrame, parts: int) -> DataFrame:
    """Chunks dealt in turn, as by a digest some tasks would have several."""
    return df.repartitionById(parts, (F.col("chunk") % parts).cast("int"))


def write_cells(cells: DataFrame, path: str, layouts: dict[str, Layout], parts: int | None = None) -> int:
    """Chunks of the arrays ``path/name`` from ``cells(chunk, place, <name>...)``; returns how many chunks have cells.

    ``chunk`` is a chunk's number and ``place`` a cell's within it, both in C order.  Of equal places the one of
    greatest value stays.  Rows are sorted by chunk, so that a task holds one chunk at a time; with ``parts`` for as many
    chunks, it sorts one only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, done = None, {}, []

        def close() -> None:
            if at is not None:
                for name, values in held.items():
                    storage.write("/".join(x for x in (path, name, layouts[name].name(at)) if x), layouts[name].pack(values))
                done.append(at)

        for b in batches:
            chunk, place = b.column("chunk").to_numpy(), b.column("place").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if chunk[lo] != at:
                    close()
                    at, held = int(chunk[lo]), {name: layout.empty() for name, layout in layouts.items()}
                for name, values in held.items():
                    values[place[lo:hi]] = b.column(name or "value").to_numpy(zero_copy_only=False)[lo:hi]
        close()
        yield pa.record_batch([pa.array(done, pa.int64())], names=["chunk"])

    names = [name or "value" for name in layouts]
    dealt = cells.select("chunk", "place", *names)
    ordered = (_by_chunk(dealt, parts) if parts else dealt.repartition("chunk")).sortWithinPartitions("chunk", "place", *names)
    return ordered.mapInArrow(run, "chunk bigint").count()


def places(layout: Layout, *axes: str) -> tuple:
    """Columns ``chunk`` and ``place`` of a cell at the columns ``axes``."""
    chunk = place = F.lit(0).cast("bigint")
    for axis, c, n in zip(axes, layout.chunks, layout.grid, strict=True):
        at = F.col(axis).cast("bigint")
        chunk, place = chunk * n + F.floor(at / c), place * c + at % c
    return chunk.alias("chunk"), place.alias("place")


def write_image(image: DataFrame, path: str, shape: tuple[int, int, int], tile: int = 64) -> int:
    """``image(z, y, x, value)`` as float64 [z, y, x]; returns the number of chunks with cells.  Others are left out: they read as 0."""
    if storage.size(f"{path}/.zarray") is not None:
        raise ConfigurationError(f"{path}: exists already")
    layout = Layout(tuple(shape), (1, tile, tile))
    create(path, layout)
    return write_cells(image.select(*places(layout, "z", "y", "x"), "value"), path, {"": layout})


def read_image(path: str) -> np.ndarray:
    """A small array whole, in this process; ``read_cells`` is the way for large ones."""
    layout = layout_of(path)
    out = np.full(layout.shape, layout.fill, layout.dtype)
    for number in range(prod(layout.grid)):
        block = _chunk(path, layout, number)
        if block is not None:
            corner = [i * c for i, c in zip(np.unravel_index(number, layout.grid), layout.chunks, strict=True)]
            part = out[tuple(slice(k, k + c) for k, c in zip(corner, layout.chunks, strict=True))]
            part[:] = block[tuple(map(slice, part.shape))]
    return out


def read_cells(spark: SparkSession, path: str, axes: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    """Every cell of an array as (``axes``, value); a task reads a chunk at a time, absent ones as the fill value."""
    layout = layout_of(path)
    n = prod(layout.grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (i for b in batches for i in b.column("id").to_pylist()):
            block = _chunk(path, layout, number)
            block = layout.empty().reshape(layout.chunks) if block is None else block
            corner = [i * c for i, c in zip(np.unravel_index(number, layout.grid), layout.chunks, strict=True)]
            there = tuple(min(c, s - k) for c, s, k in zip(layout.chunks, layout.shape, corner, strict=True))
            at = [x.reshape(-1) + k for x, k in zip(np.indices(there), corner, strict=True)]
            values = block[tuple(map(slice, there))].reshape(-1).astype(np.float64)
            for lo in range(0, len(values), 100_000):
                yield pa.record_batch([pa.array(c[lo : lo + 100_000]) for c in (*at, values)], names=[*axes, "value"])

    schema = ", ".join(f"{a} bigint" for a in axes) + ", value double"
    return spark.range(0, n, 1, numPartitions=max(1, min(n, 10_000))).mapInArrow(run, schema)


# --- rechunking -------------------------------------------------------------------------


def default_chunks(shape: tuple[int, ...]) -> tuple[int, ...]:
    """Chunks of a [c, z, y, x] array for reading images: many channels, one plane, tiles of 64."""
    if len(shape) != 4:
        raise ConfigurationError(f"state the chunks of an array of {len(shape)} axes")
    return min(10_000, shape[0]), 1, min(64, shape[2]), min(64, shape[3])


def _pieces(path: str, old: Layout, new: Layout):
    """A chunk of the old grid as the parts of it that chunks of the new grid hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (i for b in batches for i in b.column("id").to_pylist()):
            block = _chunk(path, old, number)
            if block is None:
                continue
            corner = [int(i) * c for i, c in zip(np.unravel_index(number, old.grid), old.chunks, strict=True)]
            ends = [min(k + c, s) for k, c, s in zip(corner, old.chunks, old.shape, strict=True)]
            spans = [range(k // c, -(-e // c)) for k, e, c in zip(corner, ends, new.chunks, strict=True)]
            held: list[tuple] = []
            for cell in np.ndindex(*map(len, spans)):
                target = [s[i] for s, i in zip(spans, cell, strict=True)]
                lo = [max(k, t * c) for k, t, c in zip(corner, target, new.chunks, strict=True)]
                hi = [min(e, (t + 1) * c) for e, t, c in zip(ends, target, new.chunks, strict=True)]
                part = block[tuple(slice(a - k, b - k) for a, b, k in zip(lo, hi, corner, strict=True))]
                held.append((int(np.ravel_multi_index(target, new.grid)), [a - t * c for a, t, c in zip(lo, target, new.chunks, strict=True)], list(part.shape), part.tobytes()))
                if len(held) == 1000:
                    yield _piece_rows(held)
                    held = []
            if held:
                yield _piece_rows(held)

    return run


_PIECE = [("chunk", pa.int64()), ("corner", pa.list_(pa.int64())), ("size", pa.list_(pa.int64())), ("raw", pa.binary())]


def _piece_rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([h[k] for h in held], kind) for k, (_, kind) in enumerate(_PIECE)], names=[n for n, _ in _PIECE])


def rechunk(spark: SparkSession, path: str, out: str, chunks: tuple[int, ...] | None = None) -> int:
    """The array ``path`` again as ``out``, in ``chunks``; returns the number of chunks written.

    Each chunk is read once and cut where the new grid runs; a shuffle brings the parts of a new chunk together.
    A task holds one old and one new chunk, both within ``LARGEST`` bytes, however large the array.  Attributes stay;
    ``out`` appears when it is whole.
    """
    old = layout_of(path)
    new = Layout(old.shape, tuple(chunks) if chunks is not None else default_chunks(old.shape), old.dtype, old.level, old.fill)
    n = prod(old.grid)
    with storage.whole(spark, out) as stage:
        create(stage, new)
        if storage.size(f"{path}/.zattrs") is not None:
            storage.write(f"{stage}/.zattrs", storage.read(f"{path}/.zattrs"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, done = None, new.empty(), []
            for b in batches:
                for r in b.to_pylist():
                    if r["chunk"] != at:
                        if at is not None:
                            storage.write(f"{stage}/{new.name(at)}", new.pack(held))
                            done.append(at)
                        at, held = r["chunk"], new.empty().reshape(new.chunks)
                    where = tuple(slice(a, a + s) for a, s in zip(r["corner"], r["size"], strict=True))
                    held[where] = np.frombuffer(r["raw"], new.dtype).reshape(r["size"])
            if at is not None:
                storage.write(f"{stage}/{new.name(at)}", new.pack(held))
                done.append(at)
            yield pa.record_batch([pa.array(done, pa.int64())], names=["chunk"])

        pieces = spark.range(0, n, 1, numPartitions=max(1, min(n, 10_000))).mapInArrow(_pieces(path, old, new), "chunk bigint, corner array<bigint>, size array<bigint>, raw binary")
        return pieces.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk bigint").count()


# --- sparse matrices --------------------------------------------------------------------


def row_starts(matrix: DataFrame, row: str = "pixel_idx") -> DataFrame:
    """(row, n, start) of rows with entries: how many each has, and how many stand in rows before it."""
    return balance.prefix_sums(matrix.groupBy(row).agg(F.count("*").alias("n")), row, F.col("n"), name="start")


def write_csr(matrix: DataFrame, path: str, shape: tuple[int, int], rows_a_chunk: int = 1 << 16, entries_a_chunk: int = 1 << 20) -> int:
    """``matrix(pixel_idx, mz_idx, intensity)`` of distinct cells as the compressed sparse rows ``path``; returns its entries.

    ``path`` is a group of ``indptr``, ``indices`` and ``data`` with the attributes of a csr_matrix.  An entry's
    place is the number of entries in lesser blocks of rows plus its rank in its own block.  Rows without
    entries repeat the start of the next.  The matrix is computed once and held in the shared folder meanwhile.
    """
    rows, columns = shape
    outside = F.raise_error(F.lit("a cell lies outside the matrix")).cast("bigint")
    inside = F.col("pixel_idx").between(0, rows - 1) & F.col("mz_idx").between(0, columns - 1)
    with storage.held(matrix.select(F.when(inside, F.col("pixel_idx")).otherwise(outside).alias("pixel_idx"), "mz_idx", "intensity")) as cells:
        total = cells.count()
        _write_entries(cells, path, rows, total, entries_a_chunk)
        _write_indptr(cells, path, rows, total, rows_a_chunk)
    _put(f"{path}/.zgroup", {"zarr_format": 2})
    _put(f"{path}/.zattrs", {"encoding-type": "csr_matrix", "encoding-version": "0.1.0", "shape": [rows, columns]})
    return total


def _write_entries(cells: DataFrame, path: str, rows: int, total: int, size: int) -> None:
    """``indices`` and ``data`` in chunks of ``size`` entries; blocks are of rows with 16,384 entries in the mean, of 4096 rows at most."""
    kinds = {"data": Layout((total,), (size,)), "indices": Layout((total,), (size,), "<i8")}
    for name, layout in kinds.items():
        create(f"{path}/{name}", layout)
    width = max(1, min(4096, 16_384 * rows // max(1, total)))
    block = F.floor(F.col("pixel_idx") / width).alias("block")
    sizes = cells.groupBy(block).agg(F.count("*").alias("n"))
    before = balance.prefix_sums(sizes, "block", F.col("n")).select("block", "before")
    dealt = cells.select(block, "pixel_idx", "mz_idx", "intensity").repartition(balance.tasks(cells.sparkSession, total), "block")
    rank = F.row_number().over(W.partitionBy("block").orderBy("pixel_idx", "mz_idx", "intensity")) - 1
    at = dealt.withColumn("rank", rank).join(before, "block").select((F.col("before") + F.col("rank")).alias("at"), F.col("intensity").alias("data"), F.col("mz_idx").alias("indices"))
    write_cells(at.select(F.floor(F.col("at") / size).alias("chunk"), (F.col("at") % size).alias("place"), "data", "indices"), path, kinds, parts=_parts(kinds["data"]))


def _write_indptr(cells: DataFrame, path: str, rows: int, total: int, size: int) -> None:
    """The number of entries before each row, and at the end all of them.  A chunk's first row, of place -1, is its base."""
    ends = Layout((rows + 1,), (size,), "<i8")
    create(f"{path}/indptr", ends)
    spark = cells.sparkSession
    counts = cells.repartition(balance.tasks(spark, total), "pixel_idx").groupBy("pixel_idx").agg(F.count("*").alias("n"))
    own = counts.select(F.floor(F.col("pixel_idx") / size).alias("chunk"), (F.col("pixel_idx") % size).alias("place"), "n")
    every = spark.range(ends.grid[0]).withColumnRenamed("id", "chunk").join(cells.groupBy(F.floor(F.col("pixel_idx") / size).alias("chunk")).agg(F.count("*").alias("n")), "chunk", "left")
    bases = balance.prefix_sums(every, "chunk", F.col("n")).select("chunk", F.lit(-1).cast("bigint").alias("place"), F.col("before").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base, held, done = None, 0, np.zeros(0, np.int64), []

        def close() -> None:
            if at is not None:
                storage.write(f"{path}/indptr/{at}", ends.pack(base + np.cumsum(held) - held))
                done.append(at)

        for b in batches:
            chunk, place, many = (b.column(k).to_numpy() for k in ("chunk", "place", "n"))
            edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if chunk[lo] != at:
                    close()
                    at, base, held, lo = int(chunk[lo]), int(many[lo]), np.zeros(size, np.int64), lo + 1
                held[place[lo:hi]] = many[lo:hi]
        close()
        yield pa.record_batch([pa.array(done, pa.int64())], names=["chunk"])

    _by_chunk(own.union(bases), _parts(ends)).sortWithinPartitions("chunk", "place").mapInArrow(run, "chunk bigint").count()


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """``matrix(pixel_idx, mz_idx, intensity)`` of compressed sparse rows: a task reads a chunk of entries and the chunks of row starts that reach into it."""
    ends, kinds = layout_of(f"{path}/indptr"), {name: layout_of(f"{path}/{name}") for name in ("data", "indices")}
    size, n, total = kinds["data"].chunks[0], ends.grid[0], kinds["data"].shape[0]
    if kinds["indices"].chunks[0] != size:
        raise FormatError(f"{path}: chunks of indices and data differ")

    def starts(c: int) -> np.ndarray:
        """The starts of a chunk's rows, and the end of the last."""
        own = _chunk(f"{path}/indptr", ends, c)[: ends.shape[0] - c * ends.chunks[0]]
        return np.append(own, _chunk(f"{path}/indptr", ends, c + 1)[:1]) if c + 1 < n else own

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in (i for b in batches for i in b.column("id").to_pylist()):
            v = starts(c)
            yield pa.record_batch([pa.array([c]), pa.array(v[:1]), pa.array(v[-1:])], names=["rows", "start", "end"])

    of = spark.range(0, n, 1, numPartitions=_parts(ends)).mapInArrow(spans, "rows bigint, start bigint, end bigint").where("start < end")
    met = of.select("rows", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("chunk"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for b in batches:
            for c, r in zip(b.column("chunk").to_pylist(), b.column("rows").to_pylist(), strict=True):
                if c != at:
                    at, held = c, {name: _chunk(f"{path}/{name}", kinds[name], c) for name in ("indices", "data")}
                v = starts(r)
                first, last = max(int(v[0]), c * size), min(int(v[-1]), (c + 1) * size, total)
                for lo in range(first, last, 100_000):
                    hi = min(lo + 100_000, last)
                    row = np.searchsorted(v, np.arange(lo, hi), "right") - 1 + r * ends.chunks[0]
                    yield pa.record_batch([pa.array(row), *(pa.array(held[k][lo - c * size : hi - c * size]) for k in ("indices", "data"))], names=["pixel_idx", "mz_idx", "intensity"])

    return _by_chunk(met, _parts(kinds["data"])).sortWithinPartitions("chunk", "rows").mapInArrow(entries, "pixel_idx bigint, mz_idx bigint, intensity double")
