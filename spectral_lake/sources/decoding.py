"""Arrow batches of spectra: bounded by peaks, lists built from buffers, one row a spectrum whether it could be read or not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Why a spectrum was not read.  ``error`` is one of these, a colon and the detail.
CAUSES = ("missing", "lengths", "range", "corrupt", "decoder")
ROW = [("spectrum_idx", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("z", pa.int32()), ("mzs", pa.list_(pa.float64())), ("intensities", pa.list_(pa.float64())), ("error", pa.string())]
SCHEMA = "spectrum_idx bigint, x int, y int, z int, mzs array<double>, intensities array<double>, error string"
#: Peaks and rows of a batch at most; a longer spectrum is a batch of its own.
PEAKS, ROWS = 500_000, 10_000


class Unreadable(Exception):
    """Why one spectrum cannot be read; it is told in its row and does not end the task."""

    def __init__(self, cause: str, detail: str = "") -> None:
        super().__init__(f"{cause}: {detail}" if detail else cause)


def lists(values: list[np.ndarray | None]) -> pa.Array:
    """A list column straight from the arrays' memory; None is null."""
    sizes = [0 if v is None else len(v) for v in values]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    flat = np.concatenate([np.empty(0), *(v for v in values if v is not None and len(v))])
    return pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([v is None for v in values]))


class Batches:
    """Collects spectra and gives them out as record batches of ``columns``."""

    def __init__(self, columns: list[str], peaks: int = PEAKS, rows: int = ROWS) -> None:
        self.columns, self.most, self.rows = columns, peaks, rows
        self._clear()

    def _clear(self) -> None:
        self.held: dict[str, list] = {name: [] for name, _ in ROW}
        self.n = 0

    def add(self, place: tuple[int, int, int, int], mzs: np.ndarray | None, intensities: np.ndarray | None, error: str | None) -> Iterator[pa.RecordBatch]:
        size = 0 if mzs is None else len(mzs)
        if self.n + size > self.most and self.held["x"]:
            yield self._batch()
        for name, value in zip(self.held, (*place, mzs, intensities, error), strict=True):
            self.held[name].append(value)
        self.n += size
        if len(self.held["x"]) >= self.rows:
            yield self._batch()

    def _batch(self) -> pa.RecordBatch:
        columns = [lists(self.held[name]) if pa.types.is_list(kind) else pa.array(self.held[name], kind) for name, kind in ROW if name in self.columns]
        out = pa.record_batch(columns, names=[name for name, _ in ROW if name in self.columns]).select(self.columns)
        self._clear()
        return out

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held["x"]:
            yield self._batch()
