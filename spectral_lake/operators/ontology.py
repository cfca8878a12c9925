"""Controlled-vocabulary terms: loading, matching, counting, reporting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def load_obo(spark: SparkSession, path: str) -> DataFrame:
    """(accession, name, value_type) of an OBO file's terms; obsolete ones included.

    Stanzas are records of the text reader, so a file is split like any other.
    """
    stanza = spark.read.option("lineSep", "\n[Term]\n").text(path).select("value")
    line = lambda key: F.regexp_extract("value", rf"(?m)^{key}: ?(.*)$", 1)
    kind = F.regexp_extract("value", r"(?m)^xref: value-type:(xsd\\?:\w+)", 1)
    terms = stanza.select(line("id").alias("accession"), line("name").alias("name"), F.nullif(F.replace(kind, F.lit("\\"), F.lit("")), F.lit("")).alias("value_type"))
    return terms.where("accession like '%:%'").dropDuplicates(["accession"])


def load_vocabularies(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Terms of several OBO files, ``updated`` in the order of ``paths``."""
    files = [load_obo(spark, p).withColumns({"vocabulary": F.lit(i), "seq": F.monotonically_increasing_id()}) for i, p in enumerate(paths)]
    return updated(reduce(DataFrame.union, files))


def updated(terms: DataFrame) -> DataFrame:
    """(accession, name, value_type, load_order) of ``terms(accession, name, value_type, vocabulary, seq)``, one row an accession.

    A term of a later vocabulary, or later in one, replaces what is known of its accession.  load_order stays
    where the accession was first met: it decides in ``by_name`` which of equal names is found.
    """
    at = F.struct("vocabulary", "seq")
    last = F.max_by(F.struct("name", "value_type"), at)
    one = terms.groupBy("accession").agg(last.alias("t"), F.min(at).alias("load_order"))
    return one.select("accession", "t.name", "t.value_type", "load_order")


def prefix(accession):
    """What stands before the colon; none without one."""
    return F.when(F.contains(accession, F.lit(":")), F.split_part(accession, F.lit(":"), F.lit(1)))


def matched(params: DataFrame, terms: DataFrame) -> DataFrame:
    """Each parameter with its term's name; null if unknown."""
    return params.join(terms.select("accession", F.col("name").alias("term")), "accession", "left")


def unknown(params: DataFrame, terms: DataFrame) -> DataFrame:
    return params.join(terms, "accession", "left_anti")


def term_counts(params: DataFrame) -> DataFrame:
    return params.where("accession <> ''").groupBy("accession").agg(F.count("*").alias("n"), F.min("seq").alias("first_seen"))


def summary(params: DataFrame, terms: DataFrame) -> DataFrame:
    """Totals, known and unknown; an empty accession is unknown."""
    m = matched(params, terms)
    n, known = F.count("*"), F.count("term")
    return m.agg(n.alias("total"), known.alias("known"), (n - known).alias("unknown"), F.count_distinct("accession").alias("distinct_terms"), F.when(n > 0, known * 100.0 / n).otherwise(0.0).alias("known_percent"))


def most_common(params: DataFrame, terms: DataFrame, n: int = 15) -> DataFrame:
    """Most frequent terms; the first seen of equals comes first."""
    top = term_counts(params).orderBy(F.desc("n"), "first_seen").limit(n)
    return top.join(terms.select("accession", "name"), "accession", "left").select("accession", "n", "name")


def unknown_by_prefix(params: DataFrame, terms: DataFrame, shown: int = 10) -> DataFrame:
    """(prefix, accession, n, more): the first ``shown`` unknown accessions of each prefix, and how many follow."""
    u = term_counts(unknown(params, terms)).withColumn("prefix", F.coalesce(prefix(F.col("accession")), F.lit("OTHER")))
    w = W.partitionBy("prefix")
    u = u.withColumn("r", F.row_number().over(w.orderBy("accession"))).withColumn("more", F.greatest(F.count("*").over(w) - shown, F.lit(0)))
    return u.where(F.col("r") <= shown).select("prefix", "accession", "n", "more")


def rollup_by_file(params: DataFrame, terms: DataFrame) -> DataFrame:
    """Totals and the set of unknown accessions of each file."""
    m = matched(params, terms)
    bad = F.array_join(F.array_sort(F.collect_set(F.when(F.col("term").isNull(), F.col("accession")))), ",")
    return m.groupBy("file").agg(F.count("*").alias("total"), F.count("term").alias("known"), bad.alias("unknown"))


def by_name(terms: DataFrame) -> DataFrame:
    """Accession of each lower-case name; of equals the one loaded last."""
    return terms.groupBy(F.lower("name").alias("name")).agg(F.max_by("accession", "load_order").alias("accession"))


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, accession, name, value) of every cvParam of an XML file, or of all .imzML files in a folder and below."""
    schema = "_accession string, _name string, _value string, _cvRef string"
    reader = spark.read.format("xml").option("rowTag", "cvParam").schema(schema)
    if not path.lower().endswith((".imzml", ".mzml", ".xml")):
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.imzML")
    raw = reader.load(path)
    return raw.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("seq"), F.coalesce("_accession", F.lit("")).alias("accession"), F.col("_name").alias("name"), F.col("_value").alias("value"))


def results(params: DataFrame, terms: DataFrame) -> dict:
    """Totals of all files, the union of their unknown accessions, and the totals of each: what a report stores.

    The driver gets a row a file and the distinct unknown accessions.
    """
    s = summary(params, terms).first().asDict()
    files = [r.asDict() for r in rollup_by_file(params, terms).orderBy("file").collect()]
    missing = [r["accession"] for r in unknown(params, terms).select("accession").distinct().orderBy("accession").collect()]
    return {"files": len(files), **s, "unknown_terms": missing, "per_file": files}


def report(params: DataFrame, terms: DataFrame, shown: int = 10) -> str:
    """The summary as text, for people."""
    s = summary(params, terms).first()
    lines = [f"Total terms: {s['total']}", f"Known: {s['known']} ({s['known_percent']:.1f}%)", f"Unknown: {s['unknown']}", "Most common:"]
    lines += [f"  {r['accession']} ({r['name'] or 'unknown'}): {r['n']}" for r in most_common(params, terms).orderBy(F.desc("n")).collect()]
    rest = unknown_by_prefix(params, terms, shown).orderBy("prefix", "accession").collect()
    lines += [f"  unknown {r['accession']}: {r['n']}" for r in rest]
    lines += [f"  ... and {more} more of {p}" for p, more in sorted({(r["prefix"], r["more"]) for r in rest}) if more]
    return "\n".join(lines)
