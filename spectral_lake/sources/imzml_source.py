"""``spark.read.format("imzml")``: spectra of an imzML file by byte ranges of its XML.

A partition is a range of bytes: its spectra are those whose element begins there.  Filters on
spectrum_idx, x, y and z are decided from the XML, and a schema without the arrays needs no more than that:
only spectra that are asked for are read from the binary file, in ranges that are merged where they
are near each other.

Options: ``path``; ``split``, bytes of XML a partition (default 32 MB); ``filesystem``, a factory as in ``storage``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .. import storage
from ..errors import FormatError
from . import accessions as A
from .decoding import SCHEMA, Batches, Unreadable

SPLIT, BLOCK = 32 << 20, 1 << 20
#: Bytes of arrays that a task reads before it decodes them.
READ = 16 << 20
_BEGIN, _END = re.compile(rb"<spectrum[\s>]"), b"</spectrum>"
_COMPARE = {EqualTo: lambda v, to: v == to, GreaterThan: lambda v, to: v > to, GreaterThanOrEqual: lambda v, to: v >= to, LessThan: lambda v, to: v < to, LessThanOrEqual: lambda v, to: v <= to, In: lambda v, to: v in to}
_PLACES = ("spectrum_idx", "x", "y", "z")


@dataclass(frozen=True)
class Array:
    """Where one array of a spectrum stands in the binary file, and how."""

    at: int
    n: int
    size: int
    kind: str
    packed: bool

    def decode(self, raw: bytes) -> np.ndarray:
        if len(raw) != self.size:
            raise Unreadable("range", f"{len(raw)} of {self.size} bytes at {self.at}")
        try:
            values = np.frombuffer(zlib.decompress(raw) if self.packed else raw, self.kind)
        except (zlib.error, ValueError) as e:
            raise Unreadable("corrupt", str(e)) from e
        if len(values) < self.n:
            raise Unreadable("corrupt", f"{len(values)} of {self.n} values")
        return values[: self.n].astype(np.float64)


def header(uri: str, factory: str | None = None) -> bytes:
    """The XML before the first spectrum."""
    fs, path = storage.locate(uri, factory)
    got = b""
    with fs.open_input_stream(path) as f:
        while block := f.read(BLOCK):
            got += block
            if found := _BEGIN.search(got):
                return got[: found.start()]
    return got


def groups_of(head: bytes) -> dict[str, list[tuple[str, str]]]:
    """Accession and value of each parameter of the header's referenceable groups."""
    out = {}
    for m in re.finditer(rb"<referenceableParamGroup\s.*?</referenceableParamGroup>", head, re.S):
        group = ElementTree.fromstring(m[0])
        out[group.get("id")] = [(p.get("accession"), p.get("value") or "") for p in group.iter("cvParam")]
    return out


def elements(uri: str, begin: int, end: int, factory: str | None = None) -> Iterator[bytes]:
    """Spectrum elements that begin in [begin, end), read in blocks; one's rest may stand beyond."""
    fs, path = storage.locate(uri, factory)
    with fs.open_input_file(path) as f:
        length = f.size()
        held, at, place = b"", begin, begin  # ``held`` stands at byte ``at``; ``place`` is where the next block begins

        def more() -> bool:
            nonlocal held, place
            f.seek(place)
            block = f.read(min(BLOCK, length - place)) if place < length else b""
            held, place = held + block, place + len(block)
            return bool(block)

        while True:
            found = _BEGIN.search(held)
            if found is None:
                keep = min(len(held), 16)  # a tag may be cut by the block's end
                at, held = at + len(held) - keep, held[len(held) - keep :]
                if at >= end or not more():
                    return
                continue
            if at + found.start() >= end:
                return
            at, held = at + found.start(), held[found.start() :]
            looked = 0
            while (close := held.find(_END, looked)) < 0:
                looked = max(0, len(held) - len(_END))
                if not more():
                    return  # the file ends within a spectrum
            yield held[: close + len(_END)]
            at, held = at + close + len(_END), held[close + len(_END) :]


class ImzmlReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.factory, self.split = options["path"], options.get("filesystem"), int(options.get("split", SPLIT))
        self.columns = schema.fieldNames()
        self.pushed: list[tuple[str, type, object]] = []
        self.groups: dict[str, list[tuple[str, str]]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in _PLACES or type(f) not in (*_COMPARE, IsNotNull):
                yield f
            elif type(f) is not IsNotNull:  # places are never null
                self.pushed.append((column, type(f), f.value))

    def partitions(self) -> list[InputPartition]:
        length = storage.size(self.path, self.factory)
        if length is None:
            raise FormatError(f"{self.path}: does not exist")
        groups = groups_of(header(self.path, self.factory))
        return [InputPartition((lo, min(lo + self.split, length), groups)) for lo in range(0, max(length, 1), self.split)]

    def _wanted(self, place: tuple[int, ...]) -> bool:
        at = dict(zip(_PLACES, place, strict=True))
        return all(_COMPARE[kind](at[column], to) for column, kind, to in self.pushed)

    def _place(self, element: ElementTree.Element) -> tuple[int, int, int, int]:
        found = {p.get("accession"): p.get("value") for p in element.iterfind("scanList/scan/cvParam")}
        x, y, z = (int(found[a]) if a in found else d for a, d in ((A.X, 1), (A.Y, 1), (A.Z, 0)))
        return int(element.get("index")), x - 1, y - 1, z - 1 if z > 0 else 0

    def _arrays(self, element: ElementTree.Element) -> dict[str, Array]:
        out = {}
        for a in element.iterfind("binaryDataArrayList/binaryDataArray"):
            told = [p for r in a.iterfind("referenceableParamGroupRef") for p in self.groups.get(r.get("ref"), [])] + [(p.get("accession"), p.get("value") or "") for p in a.iterfind("cvParam")]
            value = dict(told)
            kind = next((A.KINDS[k] for k, _ in reversed(told) if k in A.KINDS), None)
            role = next((r for r in (A.MZ, A.INTENSITY) if r in value), None)
            if role is None or role in out:
                continue
            try:
                at, n = int(value[A.OFFSET]), int(value[A.LENGTH])
                size = int(value[A.BYTES]) if A.BYTES in value else n * np.dtype(kind).itemsize
            except (KeyError, ValueError):
                continue
            if kind is not None and at >= 0 and n >= 0:
                out[role] = Array(at, n, size, kind, A.ZLIB in value)
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        begin, end, self.groups = partition.value
        out = Batches(self.columns)
        needs = bool({"mzs", "intensities", "error"} & set(self.columns))
        held: list[tuple[tuple[int, int, int, int], dict[str, Array]]] = []
        size = 0
        for text in elements(self.path, begin, end, self.factory):
            element = ElementTree.fromstring(text)
            place = self._place(element)
            if not self._wanted(place):
                continue
            if not needs:
                yield from out.add(place, None, None, None)
                continue
            arrays = self._arrays(element)
            held.append((place, arrays))
            size += sum(a.size for a in arrays.values())
            if size >= READ or len(held) >= 5000:
                yield from self._decode(held, out)
                held, size = [], 0
        yield from self._decode(held, out)
        yield from out.rest()

    def _decode(self, held: list[tuple[tuple[int, int, int, int], dict[str, Array]]], out: Batches) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        fs, path = storage.locate(re.sub(r"\.imzml$", ".ibd", self.path, flags=re.I), self.factory)
        with fs.open_input_file(path) as f:
            length = f.size()
            spans = storage.merged([(a.at, min(a.at + a.size, length)) for _, arrays in held for a in arrays.values() if a.size and a.at < length])
            starts, blocks = [lo for lo, _ in spans], [f.read_at(hi - lo, lo) for lo, hi in spans]
        for place, arrays in held:
            got, why = [None, None], None
            try:
                for k, (role, name) in enumerate(((A.MZ, "m/z"), (A.INTENSITY, "intensity"))):
                    if role not in arrays:
                        raise Unreadable("missing", f"no {name} array")
                    a = arrays[role]
                    raw = b""
                    if a.size and a.at < length:
                        i = int(np.searchsorted(starts, a.at, "right")) - 1
                        raw = blocks[i][a.at - starts[i] : a.at - starts[i] + a.size]
                    got[k] = a.decode(raw) if a.n else np.empty(0)
                if len(got[0]) != len(got[1]):
                    raise Unreadable("lengths", f"{len(got[0])} m/z, {len(got[1])} intensities")
            except Unreadable as e:
                got, why = [None, None], str(e)
            yield from out.add(place, *got, why)


class ImzmlSource(DataSource):
    """One row a spectrum: spectrum_idx, x, y, z from 0, mzs, intensities, and error, which says why both are null."""

    @classmethod
    def name(cls) -> str:
        return "imzml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ImzmlReader:
        if "path" not in self.options:
            raise FormatError("imzml needs a path")
        return ImzmlReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    if not getattr(spark, "_spectral_imzml", False):
        spark.dataSource.register(ImzmlSource)
        spark._spectral_imzml = True
