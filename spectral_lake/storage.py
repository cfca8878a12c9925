"""Byte ranges and whole small files on any file system that Arrow knows, and folders that appear whole or not at all.

Tasks open files by URI.  A path without a scheme is local or mounted; ``file://``, ``s3://``, ``gs://``,
``hdfs://`` and the like go to Arrow's own file systems; any other store is named by a factory,
``"package.module:function"``, that gives ``(file system, path)`` for a URI.  It is a string, so that it
can be an option of a data source and be resolved in every worker.
"""

from __future__ import annotations

import importlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigurationError, ImagingError


def locate(uri: str, factory: str | None = None) -> tuple[pafs.FileSystem, str]:
    """The file system of ``uri`` and the path on it."""
    if factory:
        module, _, name = factory.partition(":")
        try:
            return getattr(importlib.import_module(module), name)(uri)
        except (ImportError, AttributeError) as e:
            raise ConfigurationError(f"no file system {factory!r}: {e}") from e
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def there(uri: str, factory: str | None = None) -> bool:
    """Whether ``uri`` is a file or a folder."""
    fs, path = locate(uri, factory)
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def size(uri: str, factory: str | None = None) -> int | None:
    """Bytes of a file; None if there is none."""
    fs, path = locate(uri, factory)
    found = fs.get_file_info(path)
    return found.size if found.type == pafs.FileType.File else None


def read(uri: str, factory: str | None = None) -> bytes:
    fs, path = locate(uri, factory)
    with fs.open_input_stream(path) as f:
        return f.read()


def write(uri: str, content: bytes, factory: str | None = None) -> None:
    """A small file, whole: written beside and moved, so that a task that runs again replaces its own."""
    fs, path = locate(uri, factory)
    if isinstance(fs, pafs.LocalFileSystem):
        fs.create_dir(path.rpartition("/")[0] or ".", recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(content)
    fs.move(part, path)


def merged(ranges: list[tuple[int, int]], gap: int = 1 << 16) -> list[tuple[int, int]]:
    """Ascending ranges (begin, end), those within ``gap`` bytes of each other as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def hadoop(spark: SparkSession, path: str):
    """A path and the file system that Spark has it on."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = hadoop(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = hadoop(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    at, fs = hadoop(spark, old)
    if not fs.rename(at, hadoop(spark, new)[0]):
        raise ImagingError(f"{old} could not be renamed to {new}")


@contextmanager
def whole(spark: SparkSession, path: str, replace: bool = False) -> Iterator[str]:
    """A folder to write in that becomes ``path`` when the block ends well and vanishes when it does not.

    Without ``replace``, ``path`` must not exist, neither before nor after.  With it, the old folder steps
    aside while the new one takes its name, and comes back if that fails.  On a store without
    renaming of folders, the rename copies: readers should wait for the call to return.
    """
    path = path.rstrip("/")
    stage, aside = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("making", "former"))
    if not replace and exists(spark, path):
        raise ImagingError(f"{path}: exists already")
    try:
        yield stage
        there = exists(spark, path)
        if there and not replace:
            raise ImagingError(f"{path}: exists already")
        if there:
            move(spark, path, aside)
        try:
            move(spark, stage, path)
        except Exception:
            if there:
                move(spark, aside, path)
            raise
        if there:
            remove(spark, aside)
    except BaseException:
        remove(spark, stage)
        raise


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: ``spark.checkpoint.dir``, or the context's.

    Where none is set, a session in one process, as in tests, gets a temporary one; a cluster must name its own.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spectral-lake-"))
        found = context.getCheckpointDir()
    if not found:
        raise ConfigurationError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as Parquet in the shared folder while the block runs: for steps that read it several times and end there."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove(df.sparkSession, path)


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: lineage ends here, and a lost executor costs later tasks only."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
