"""Views of order and event tables as spectra, frames and vocabulary parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NX = NY = 128


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Line items as peaks: an order is a spectrum, its lines are its peaks in order; ``parts``: partitions by spectrum in which they are numbered."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_quantity", "l_partkey")
    mz = F.lit(100.0).cast("double") + F.col("l_partkey") * F.lit(0.5).cast("double")
    lines = read(spark, sf_dir, "lineitem")
    lines = lines.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey").repartition(parts, "l_orderkey") if parts else lines
    return lines.select(F.col("l_orderkey").alias("spectrum_idx"), (F.row_number().over(order) - 1).cast("bigint").alias("peak_pos"), mz.alias("mz"), F.col("l_quantity").alias("intensity"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as spectra on one shared axis."""
    mzs = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.lit(100.0).cast("double") + i.cast("double"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spectrum_idx"), mzs.alias("mzs"), F.col("embedding").cast("array<double>").alias("intensities"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frames with their peak counts."""
    n = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("num_peaks"))
    o = read(spark, sf_dir, "orders")
    return o.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select((F.col("o_orderkey") + 1).alias("frame_id"), F.coalesce("num_peaks", F.lit(0)).cast("bigint").alias("num_peaks"))


def frame_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the frames; one in fifty has none."""
    o = read(spark, sf_dir, "orders").where(F.col("o_orderkey") % 50 != 7)
    return o.select((F.col("o_orderkey") + 1).alias("frame"), (669 + F.col("o_orderkey") % NX).alias("x_pos"), (109 + F.floor(F.col("o_orderkey") / NX)).cast("bigint").alias("y_pos"))


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as parameters: users are terms, event types are files."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("file"), F.col("event_id").alias("seq"), F.concat(F.when(F.col("user_id") % 2 == 0, "MS:").otherwise("IMS:"), F.col("user_id").cast("string")).alias("accession"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the known terms."""
    n = read(spark, sf_dir, "nation")
    return n.select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "MS:").otherwise("IMS:"), F.col("n_nationkey").cast("string")).alias("accession"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("load_order"))
