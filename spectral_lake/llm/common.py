"""Shared helpers: tables, the shared working folder, and byte arithmetic."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SHARED = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    A session in one process, as in tests, gets a temporary one where none is set; a cluster must
    name its own.
    """
    context = spark.sparkContext
    found = spark.conf.get(_SHARED, None) or context.getCheckpointDir()
    if not found and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spectral-lake-"))
        found = context.getCheckpointDir()
    if not found:
        raise ValueError(f"these operators keep intermediate tables: set {_SHARED} to a folder that the driver and all executors share")
    return found.rstrip("/")


def bounded_batches(df: DataFrame, size: str = "8m", rows: int = 4000) -> DataFrame:
    """``df``, with its session's Arrow batches bounded by bytes: texts may be long, and a task holds several copies of a batch."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def trim() -> None:
    """Give freed memory back to the system: Python workers stay for later tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(f):
    """A generator over Arrow batches that trims its worker when a task ends."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    return run


_made: list[str] = []  # folders and tables of intermediate results that nobody has removed yet


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage: a lost executor costs the tasks after this point only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def materialise_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """The same, as a table bucketed by ``key``: later grouping by it needs no shuffle."""
    spark = df.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    _made.append(path)
    out = spark.table(name)
    out.scratch = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    name = path.rpartition("/")[2]
    if name.startswith("llm_"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*frames: DataFrame) -> None:
    """Remove intermediate tables that no later step reads."""
    for df in frames:
        _remove(df.sparkSession, df.scratch)
        _made.remove(df.scratch)


def sweep(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Remove all intermediate tables but ``keep``: call it when results that were built on them are written."""
    left = [keep.scratch] if keep is not None else []
    for path in [x for x in _made if x not in left]:
        _remove(spark, path)
        _made.remove(path)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``; root is the least node reachable.

    Alternating large-star and small-star rounds re-attach each edge to the least neighbour.
    Least neighbours are aggregates, written on their own: the joins then read two plain
    exchanges, whose large partitions adaptive execution splits, so that a hub's edges are not
    one task's load.  Each round is written to the shared folder and the one before removed; the
    loop stops when the edge set no longer changes.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        large = materialise(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: each node's smaller neighbours, and itself, attach to the least of them
        floor = materialise(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(floor, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        told = Observation()  # of the edges as they are written
        before, now = now, materialise(small.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")))
        discard(before, least, large, floor)
        if told.get == seen:
            break
        seen = told.get
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


# --- byte arithmetic -------------------------------------------------------------------

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(salt))


_BYTE = seeds(256, 77) | _U(1)
_BASE = _U(0xD1342543DE82EF95)
_INVERSE = _U(pow(0xD1342543DE82EF95, -1, 1 << 64))
_pow = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        size = max(1 << 18, 1 << n.bit_length())
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _pow.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _pow["up"], _pow["down"]


class Rolling:
    """Polynomial hashes modulo 2**64 of any stretch of ``buf`` in constant time."""

    def __init__(self, buf: np.ndarray) -> None:
        up, self.down = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, _U)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=self.sums[1:])

    @classmethod
    def digests(cls, parts: list[bytes]) -> np.ndarray:
        ends = np.cumsum([0, *map(len, parts)])
        return cls(np.frombuffer(b"".join(parts), np.uint8)).of(ends[:-1], ends[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def as_bytes(column) -> list[bytes | None]:
    """An Arrow string or binary column as UTF-8 bytes."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()
