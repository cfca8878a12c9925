"""How far the sources of a language are apart in their words: an inverted index of corrections to a baseline.

Each (lang, source) group, and each language, gives every kept term a smoothed share p of a
thousand million.  Two groups differ by the sum of |p - q| over all V kept terms.

A term that neither group has gives f0 = |p(0) - q(0)|, so each pair starts at V * f0 and only
postings correct it:

* a term that the one group has changes f0 to |p(n) - q(0)|.  What that adds depends on the count n
  alone, so a group's postings are first summed up as counts of counts;
* a term that both have adds |p(n) - q(m)| - |p(n) - q(0)| - |p(0) - q(m)| + f0 once more, by a
  self-join of the postings on the term.

Corrections of zero are not emitted.  Everything is whole numbers.  A frequent term has a posting
for each source at most, a source one for each term: a source that holds a third of all
documents is no heavier here than others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, lean, materialise

#: A-Z as a-z, other ASCII characters as blanks; bytes of other characters as they are.
_TERMS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Entries that a task holds before it sends its counts.
_HELD = 400_000


def _rows(held: dict) -> pa.RecordBatch:
    """Counts as rows; the row without a term stands for the group itself."""
    lang, source, term, n, docs = [], [], [], [], []
    for (a, b), (all_of, once) in held.items():
        size = len(all_of) + 1
        lang += [a] * size
        source += [b] * size
        term += [None, *all_of]
        n += [0, *all_of.values()]
        docs += [0, *(once[t] for t in all_of)]
    texts = [pa.array(x, pa.binary()).view(pa.string()) for x in (lang, source, term)]
    return pa.record_batch([*texts, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


@lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
    size = 0
    for b in batches:
        for text, lang, source in zip(*(as_bytes(b.column(c)) for c in ("text", "lang", "source")), strict=True):
            all_of, once = held.setdefault((lang or b"", source or b""), (Counter(), Counter()))
            words = (text or b"").translate(_TERMS).split()
            before = len(all_of)
            all_of.update(words)
            once.update(set(words))
            size += len(all_of) - before
            if size > _HELD:
                yield _rows(held)
                held, size = {}, 0
    if held:
        yield _rows(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term; one row without a term for each group."""
    slim = bounded_batches(docs).select("text", "lang", "source")
    counted = slim.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kept)); null without kept terms.  Decimals: the product outgrows a long."""
    top = F.lit(10**9).cast("decimal(10,0)") * (n + 5).cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", top, F.nullif(total + 5 * kept, F.lit(0).cast("bigint")).cast("decimal(20,0)"))


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs(text, lang, source)``.

    Terms are runs of letters, A-Z lower-cased, other characters beyond ASCII included; a language
    keeps those in ``least_docs`` of its documents or more.  Part ``pair`` ranks the other sources of the
    language by their distance; part ``term`` ranks the terms that a source has and uses more than its
    language does, up to ``top``.  Ranks go by value, then by the item's bytes, so ties are defined.

    Null texts, languages and sources count as ''.  Repeated rows count each.  A group without terms
    has pairs but no terms; a language without kept terms has pairs of value 0; a language of one
    source has no pair; an empty table gives no row.  Other columns are ignored.
    """
    counts = materialise(term_counts(docs))
    kept = materialise(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("everywhere")).where(F.col("docs") >= least_docs).drop("docs"))
    postings = materialise(counts.where("term is not null").drop("docs").join(kept, ["lang", "term"]))
    # sizes of groups and languages
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("everywhere").alias("lang_size"))
    zero = F.lit(0).cast("bigint")
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "kept", "lang_size"])
    groups = materialise(groups.withColumn("none", F.coalesce(share(zero, F.col("size"), F.col("kept")), zero)))
    shares = materialise(
        postings.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("size"), F.col("kept")).alias("p"), "none", share(F.col("everywhere"), F.col("lang_size"), F.col("kept")).alias("q"))
    )
    # every pair's baseline; a, b: the shares of a term that a group lacks
    pairs = groups.select("lang", "source", "kept", F.col("none").alias("a")).join(groups.select("lang", F.col("source").alias("item"), F.col("none").alias("b")), "lang").where("source < item")
    base = F.abs(F.col("a") - F.col("b"))
    pairs = materialise(pairs.withColumn("value", F.col("kept") * base))
    same = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    ends = pairs.select("lang", "source", "item", F.col("source").alias("of"), F.col("b").alias("other"), base.alias("base")).union(pairs.select("lang", "source", "item", F.col("item").alias("of"), F.col("a").alias("other"), base.alias("base")))
    alone = ends.join(same.select("lang", F.col("source").alias("of"), "p", "terms"), ["lang", "of"])
    alone = alone.select("lang", "source", "item", (F.col("terms") * (F.abs(F.col("p") - F.col("other")) - F.col("base"))).alias("value"))
    left = shares.select("lang", "term", "source", "p", F.col("none").alias("a"))
    right = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("none").alias("b"))
    both = left.join(right, ["lang", "term"]).where("source < item")
    both = both.select("lang", "source", "item", (F.abs(F.col("p") - F.col("r")) - F.abs(F.col("p") - F.col("b")) - F.abs(F.col("a") - F.col("r")) + base).alias("value"))
    corrections = alone.union(both).where("value <> 0")
    total = pairs.select("lang", "source", "item", "value").union(corrections).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    total = materialise(total)
    mirrored = total.union(total.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    by_pair = mirrored.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))
    terms = shares.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return by_pair.union(terms.withColumn("rank", place).where(F.col("rank") <= top))


def divergence_sql(least_docs: int = 30, top: int = 50) -> str:
    """The same in DuckDB SQL, summing every kept term for every pair."""
    p = lambda n, size: f"(1 + 1000000000::HUGEINT * ({n} + 5) // ({size} + 5 * kept))::BIGINT"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
found AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS everywhere FROM found GROUP BY ALL HAVING count(DISTINCT id) >= {least_docs}),
langs AS (SELECT lang, count(*) AS kept, sum(everywhere) AS lang_size FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT lang, source, term, everywhere, (SELECT 0) + coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM found GROUP BY ALL) USING (lang, source, term)),
shares AS (SELECT lang, source, term, n, {p("n", "sum(n) OVER (PARTITION BY lang, source)")} AS p, {p("everywhere", "lang_size")} AS q FROM cells JOIN langs USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
rows_of AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM rows_of) WHERE part = 'pair' OR rank <= {top}"""
