"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each source has one token constraint: the rates r_i of its documents satisfy
sum r_i * size_i = target with 0 <= r_i <= cap, and stay as close to 1 in relative entropy as
that allows.  The dual is convex in one multiplier a source and its solution an exponential
tilt, r_i = min(cap, exp(lambda * size_i / mean size)).  Newton steps, kept inside a bracket,
find all multipliers at once; a step reads the table of (source, size, documents), which is
aggregated first, and each step's sums are one aggregate.

Rates become whole copies: within a source, documents in order of size share one running
remainder, and what is over or missing at the end goes to the sizes that fit into it.  Running
sums are over distinct sizes; the documents of one size are ranked in salted parts.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise
from .quality_rules import SPLIT, WHITE

SALTS = 64


def size_of(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPLIT))).cast("bigint")


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with the place ``rank`` of each source by code point, null last, from 0: counted within ranges, then shifted."""
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(sizes.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"))  # a row a partition
    ahead = counts.select(F.col("range").alias("r"), F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    local = F.row_number().over(W.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("local", local).join(ahead, F.col("range") == F.col("r")).withColumn("rank", F.col("local") + F.col("ahead")).drop("local", "range", "r", "ahead")


def targets(sizes: DataFrame, cap: float) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, source_size)``: one row a source.

    Weights 1, 2, 3 repeat over the sources by code point, null last.  Shares stop at ``cap``
    times the source; what is over goes to the others by weight, until none is above.  Each
    such step is one aggregate over the sources, of which there may be many.
    """
    w = _ranked(sizes).withColumn("weight", (F.pmod("rank", F.lit(3)) + 1).cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    w = materialise(w.select("source", "source_size", "weight", "most"))
    total, weights = w.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, capped = (total / weights if weights else 0.0), None
    while weights:
        over = F.col("most") < F.col("weight") * F.lit(level)
        n, used, rest = w.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not rest:
            break
        level, capped = (total - used) / rest, n
    return w.select("source", "source_size", F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def _tilt(z: Column, lam: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * z, F.lit(50.0))))


def balance(groups: DataFrame, goal: DataFrame, cap: float, steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """(source, mean, lam) from ``groups(source, size, n)`` and ``goal(source, source_size, target)``.

    Steps end when each source is within ``tolerance`` of its target; if some are not after
    ``steps``, which bisection alone would bring near, a warning says how many.
    """
    g = groups.where("size > 0")
    facts = g.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    ratio = F.col("target") / F.col("source_size")
    edge = F.log(F.greatest(ratio, F.lit(1e-300))) / (F.col("least") / F.col("mean"))
    top = F.log(F.lit(float(cap))) / (F.col("least") / F.col("mean"))
    state = goal.withColumnsRenamed({"source": "s"}).join(facts, F.col("s").eqNullSafe(F.col("source"))).select(
        F.col("s"), "mean", "target", F.least(edge, F.lit(0.0)).alias("lo"), F.when(ratio <= 1, F.lit(0.0)).otherwise(top).alias("hi"), F.lit(0.0).alias("lam"), F.lit(False).alias("done")
    )
    state = materialise(state)
    z = F.col("size") / F.col("mean")
    for _ in range(steps):
        r = _tilt(z, F.col("lam"), cap)
        sums = g.join(state, F.col("source").eqNullSafe(F.col("s"))).groupBy("s", "mean", "target", "lo", "hi", "lam", "done").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("f"), F.sum(F.when(r < float(cap), F.col("n") * F.col("size") * z * r).otherwise(0.0)).alias("slope")
        )
        over = F.col("f") - F.col("target")
        lo, hi = F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
        now = sums.withColumn("lo", lo).withColumn("hi", hi)
        newton = F.col("lam") - over / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        settled = F.abs(over) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        lam = F.when(settled, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = materialise(now.select("s", "mean", "target", "lo", "hi", lam.alias("lam"), settled.alias("done")))
        if state.where("not done").isEmpty():
            break
    else:
        warnings.warn(f"{state.where('not done').count()} sources are not within {tolerance} of their targets", stacklevel=2)
    return state.select(F.col("s").alias("source"), "mean", "lam")


def mix_sources(docs: DataFrame, cap: float = 3.0) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` reduced to doc_id, source, size, source_size, target, rate, copies, taken.

    One row for each input row, repeated rows and null ids included.  A null text has size 0 and
    is taken zero times; a source whose texts are all empty has target 0.  Texts of any length
    are counted whole.  An empty table gives an empty table; columns of the input besides doc_id,
    text and source are left out, whatever their names.  Reruns agree.
    """
    return _taken(_measured(docs), cap).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "h")


def mix_documents(docs: DataFrame, cap: float = 3.0) -> DataFrame:
    """``docs(doc_id, text, source, ...)``, each row as often as the mix takes it; cases as in ``mix_sources``."""
    whole = F.struct(*[f"`{c}`" for c in docs.columns]).alias("input")
    taken = _taken(_measured(docs, whole), cap).where("copies > 0")
    return taken.select("input", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("input.*")


def _measured(docs: DataFrame, *more: Column) -> DataFrame:
    h = F.xxhash64("doc_id", "text")
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), h.alias("h"), F.pmod(h, F.lit(SALTS)).cast("int").alias("salt"), *more)


def _taken(measured: DataFrame, cap: float) -> DataFrame:
    """``measured(doc_id, source, size, h, salt, ...)`` with source_size, target, rate and copies."""
    parts = materialise(measured)
    cells = materialise(parts.groupBy("source", "size", "salt").agg(F.count("*").alias("n")))
    groups = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goal = materialise(targets(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), cap))
    lams = balance(groups, goal, cap)
    g = goal.withColumnRenamed("source", "s")
    rated = groups.join(g, F.col("source").eqNullSafe(F.col("s"))).drop("s").join(lams.withColumnRenamed("source", "l"), F.col("source").eqNullSafe(F.col("l")), "left").drop("l")
    full = F.col("target") >= F.col("source_size") * F.lit(float(cap))
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(full, F.lit(float(cap))).otherwise(_tilt(F.col("size") / F.col("mean"), F.col("lam"), cap))
    rated = rated.withColumn("rate", rate).withColumn("base", F.floor("rate")).withColumn("part", F.col("rate") - F.col("base"))
    # running remainder, in copies, over the sizes of a source
    down = W.partitionBy("source").orderBy("size")
    run = F.sum(F.col("part") * F.col("n")).over(down.rowsBetween(W.unboundedPreceding, 0))
    rated = rated.withColumn("run", run + 0.5).withColumn("extra", F.floor("run") - F.floor(F.col("run") - F.col("part") * F.col("n")))
    rated = rated.withColumn("k", (F.col("n") * F.col("base") + F.greatest(F.least("extra", "n"), F.lit(0))).cast("bigint"))
    # what is still over or missing goes to the largest sizes that fit into it, three times
    per = W.partitionBy("source")
    for _ in range(3):
        rest = F.col("target") - F.sum(F.col("k") * F.col("size")).over(per)
        rated = rated.withColumn("rest", F.when(F.col("target") < F.col("source_size") * F.lit(float(cap)), rest).otherwise(0.0))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("rest"))
        room = F.when(fits, F.when(F.col("rest") > 0, F.greatest(F.least(F.col("n"), F.col("n") * F.lit(int(cap)) - F.col("k")), F.lit(0))).otherwise(F.least("n", "k"))).otherwise(0)
        rated = rated.withColumn("room", room.cast("bigint"))
        before = F.coalesce(F.sum(F.col("room") * F.col("size")).over(per.orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        take = F.least(F.greatest(F.floor((F.abs("rest") - before) / F.when(F.col("size") > 0, F.col("size"))), F.lit(0)), F.col("room"))
        rated = rated.withColumn("k", (F.col("k") + F.signum("rest") * F.coalesce(take, F.lit(0))).cast("bigint"))
    base = F.floor(F.col("k") / F.col("n")).cast("bigint")
    rated = rated.select("source", "size", "source_size", "target", "rate", base.alias("base"), (F.col("k") - F.col("n") * base).alias("extra"))
    # which documents of a size are taken once more: the first ``extra`` by (salt, digest)
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("source", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = cells.withColumn("ahead", ahead)
    c = placed.join(rated.withColumnsRenamed({"source": "rs", "size": "rz"}), F.col("source").eqNullSafe(F.col("rs")) & (F.col("size") == F.col("rz"))).drop("rs", "rz", "n")
    c = c.withColumnsRenamed({"source": "cs", "size": "cz", "salt": "ck"})
    rank = F.row_number().over(W.partitionBy("source", "size", "salt").orderBy("h", "doc_id"))
    out = parts.withColumn("rank", rank).join(c, F.col("source").eqNullSafe(F.col("cs")) & (F.col("size") == F.col("cz")) & (F.col("salt") == F.col("ck")))
    copies = F.col("base") + F.when(F.col("ahead") + F.col("rank") <= F.col("extra"), 1).otherwise(0)
    return out.withColumn("copies", F.least(copies, F.lit(int(cap))))
