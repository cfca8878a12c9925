"""The common m/z axis: distinct values with a dense index, and its ppm consolidation.

Nothing here sorts all values in one task.  Values are dealt by coarse buckets of m/z; a small
table of bucket sizes gives each bucket its offset, and windows run within buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage

BUCKET = 1.0


def _offsets(df: DataFrame, n: Column, name: str = "offset") -> DataFrame:
    """For each bucket the sum of ``n`` over the buckets before it: one row a bucket."""
    per = df.groupBy("bucket").agg(n.alias("_n"))
    return per.select("bucket", F.coalesce(F.sum("_n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias(name))


def dense_index(values: DataFrame, width: float = BUCKET) -> DataFrame:
    """``values(mz)`` of distinct m/z as ``(mz_idx, mz)``, ascending from 0."""
    v = values.select("mz", F.floor(F.col("mz") / width).alias("bucket"))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy("mz")) - 1
    return v.withColumn("r", rank).join(_offsets(v, F.count("*")), "bucket").select((F.col("offset") + F.col("r")).alias("mz_idx"), "mz")


def processed_axis(peaks: DataFrame) -> DataFrame:
    """Every distinct m/z of ``peaks(mz)``."""
    return dense_index(peaks.select("mz").distinct())


def continuous_axis(spectra: DataFrame, first: int = 0) -> DataFrame:
    """The m/z values of one spectrum as they stand, neither sorted nor made distinct."""
    return spectra.where(F.col("spectrum_idx") == first).select(F.posexplode("mzs").alias("mz_idx", "mz")).select(F.col("mz_idx").cast("bigint"), "mz")


def strategy(n_spectra: Column, limit_mb: float = 1024.0, per_spectrum: int = 1500) -> Column:
    """How much memory an axis held in one place would need, as a label."""
    mb = n_spectra * per_spectrum * 8 / 1048576.0
    return F.when(n_spectra.isNull(), "streaming").when(mb < limit_mb / 2, "fast").when(mb < limit_mb, "memory_efficient").otherwise("streaming")


# --- ppm consolidation ------------------------------------------------------------------


def _next(v: np.ndarray, tolerance_ppm: float) -> np.ndarray:
    """For each of ascending values the place of the first one beyond its group."""
    at = np.searchsorted(v, v * (1 + tolerance_ppm * 1e-6), "right")
    beyond = lambda k: (v[np.minimum(k, len(v) - 1)] - v) / v * 1e6 > tolerance_ppm  # noqa: E731  the rule itself, as rounding has it
    while (low := (at < len(v)) & ~beyond(at)).any():
        at += low
    while (high := (at - 1 > np.arange(len(v))) & beyond(at - 1)).any():
        at -= high
    return at


def _parts(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Part after part of rows sorted by it, as arrays."""
    at, held = None, []
    for b in batches:
        part = b.column("part").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for lo, hi in zip(edges, edges[1:]):
            if lo < hi:
                if part[lo] != at:
                    if held:
                        yield at, [np.concatenate(x) for x in zip(*held)]
                    at, held = int(part[lo]), []
                held.append([b.column(c).to_numpy(zero_copy_only=False)[lo:hi] for c in columns])
    if held:
        yield at, [np.concatenate(x) for x in zip(*held)]


def _dealt(first: np.ndarray, tolerance_ppm: float):
    """Values of sorted parts, and for earlier parts those that a group begun there may reach, with the first one beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, (v,) in _parts(batches, "mz"):
            yield pa.record_batch([pa.array(np.full(len(v), own)), pa.array(v)], names=["part", "mz"])
            # a value is sent to where the one before it may belong to a group; the next part's first value is ours to send
            after = np.append(v[1:], first[own + 1 : own + 2])
            before = v[: len(after)]
            top = np.where(after > v[-1], own, own - 1)
            least = np.maximum(0, np.searchsorted(first, before / (1 + tolerance_ppm * 1e-6) * (1 - 1e-9), "left") - 1)
            n = np.maximum(0, top - least + 1)
            part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(least, n)
            yield pa.record_batch([pa.array(part.astype(np.int64)), pa.array(np.repeat(after, n))], names=["part", "mz"])

    return run


def _exits(first: np.ndarray, tolerance_ppm: float):
    """(entry, exit): for each value that can begin a part's first group, the one that then begins a later part's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (v,) in _parts(batches, "mz"):
            end = len(v) if part + 1 == len(first) else int(np.searchsorted(v, first[part + 1]))
            at = _next(v, tolerance_ppm)
            # a value before the part is less than its first: it reaches no further than a group begun there
            entries = np.arange(min(end, 1 if part == 0 else int(np.searchsorted(v, v[0] * (1 + tolerance_ppm * 1e-6) * (1 + 1e-9), "right")) + 1))
            last = np.arange(len(v))
            inside = np.where(at < end, at, last)  # doubling: from start to start, as far as the part goes
            while (inside[inside] != inside).any():
                inside = inside[inside]
            reached = np.append(v, np.nan)[at[inside[entries]]]  # none: the axis ends
            yield pa.record_batch([pa.array(v[entries]), pa.array(reached)], names=["entry", "exit"])

    return run


def _orbit(jumps: DataFrame, start: float, rounds: int) -> DataFrame:
    """Entries that ``start`` leads to, by doubling: after k rounds, 2**k jumps from it."""
    spark = jumps.sparkSession
    jumps = storage.written(jumps.where(~F.isnan("exit")))
    reached = spark.createDataFrame([(start,)], "entry double")
    for k in range(rounds):
        reached = storage.written(reached.union(reached.join(jumps, "entry").select("exit")))
        if k + 1 < rounds:
            on = jumps.select(F.col("entry").alias("exit"), F.col("exit").alias("_far"))
            jumps = storage.written(jumps.join(on, "exit").select("entry", F.col("_far").alias("exit")))
    return reached


def _means(first: np.ndarray, tolerance_ppm: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (v, opens) in _parts(batches, "mz", "opens"):
            end = len(v) if part + 1 == len(first) else int(np.searchsorted(v, first[part + 1]))
            begin = np.flatnonzero(opens[:end])
            if not len(begin):
                continue  # one group covers the part
            at, starts = _next(v, tolerance_ppm), []
            k = int(begin[0])
            while k < end:
                starts.append(k)
                k = int(at[k])
            starts = np.array(starts)
            sums = np.concatenate([[0.0], np.cumsum(v - v[0])])  # small summands: no loss beside the values themselves
            sizes = at[starts] - starts
            yield pa.record_batch([pa.array(v[0] + (sums[at[starts]] - sums[starts]) / sizes)], names=["mz"])

    return run


def ppm_axis(axis: DataFrame, tolerance_ppm: float = 5.0, rows: int = 1 << 16, most_parts: int = 10_000) -> DataFrame:
    """Groups that start at their least m/z and reach ``tolerance_ppm`` from it, as their mean.

    Where a group starts hangs on all groups before it, gaps or none.  So the axis is cut in parts of
    ``rows`` values (more where that makes over ``most_parts``).  Each part tells, for each value that may begin its first
    group, which value then begins the first group of a later part; doubling these jumps gives the
    true ones, one a part, and with them all parts fold their groups at once.  A group that
    runs on into the next part finds its values there, since each part also holds those within the tolerance of its end.
    """
    dense = axis if "mz_idx" in axis.columns else dense_index(axis.select("mz"))
    dense = storage.written(dense.select("mz_idx", "mz"))  # three steps read it
    n = dense.count()
    if not n:
        return dense
    step = max(rows, -(-n // most_parts))
    first = np.array([r["mz"] for r in dense.where(F.col("mz_idx") % step == 0).select("mz").orderBy("mz").collect()])  # one value a part
    own = dense.select(F.floor(F.col("mz_idx") / step).alias("part"), "mz").repartition("part").sortWithinPartitions("part", "mz")
    if len(first) == 1:
        v = own.withColumn("opens", F.col("mz") == F.lit(float(first[0])))
    else:
        v = own.mapInArrow(_dealt(first, tolerance_ppm), "part bigint, mz double")
        jumps = v.repartition("part").sortWithinPartitions("part", "mz").mapInArrow(_exits(first, tolerance_ppm), "entry double, exit double")
        found = _orbit(jumps, float(first[0]), len(first).bit_length()).distinct().select(F.col("entry").alias("mz"), F.lit(True).alias("_opens"))
        v = v.join(found, "mz", "left").select("part", "mz", F.col("_opens").isNotNull().alias("opens")).repartition("part").sortWithinPartitions("part", "mz")
    means = storage.written(v.mapInArrow(_means(first, tolerance_ppm), "mz double"))
    return dense_index(means)
