"""Document quality: a threshold table compiled into one projection, without user functions.

Counts are built once per text from its words and lines; each rule of ``RULES`` is a ratio of
two counts with a lower or upper limit.  ``compile_rules`` turns the table into one boolean
column, so that a changed table is a changed projection and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it not of on or that the this to was with "
    "au aux avec dans de des du elle en est et la le les ne par pas pour que qui sur un une "
    "auf das dem den der des die ein eine für ich im in ist mit nicht sich und von zu "
    "al como con del el en es la las lo los no o para por que se su un una y"
).split()

#: (name, count, divided by, least, most); None is no limit.  A ratio over zero passes.
RULES = (
    ("symbols", "n_symbols", "word_chars", None, 0.1),
    ("capitals", "n_capitals", "word_chars", None, 0.3),
    ("exclamations", "n_exclamations", "n_words", None, 0.3),
    ("digits", "n_digits", "word_chars", None, 0.5),
    ("word length", "word_chars", "n_words", 2.0, 15.0),
    ("stop words", "n_stop_words", "n_words", 0.02, None),
    ("repeated lines", "n_dup_lines", "n_lines", None, 0.4),
)


def _count(chars: str) -> Column:
    return F.char_length(F.regexp_replace("_s", f"[^{chars}]+", "")).cast("bigint")


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of each whole text; a null text has none.  Columns may have any name but a count's."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    # the input's columns stay in a struct, so that none of its names meets one of ours
    out = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_in"), text.alias("_t"), trimmed.alias("_trimmed"))
    out = out.withColumn("_words", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", SPLIT)))
    out = out.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    # what is left without small letters and letters beyond ASCII holds all other counts
    out = out.withColumn("_s", F.regexp_replace("_t", "[^\\x00-\\x60\\x7B-\\x7F]+", ""))
    out = out.withColumn(
        "_h",
        F.expr(
            """slice(zip_with(zip_with(_words, slice(_words, 2, size(_words)), (a, b) -> struct(a, b)),
               slice(_words, 3, size(_words)), (p, c) -> xxhash64(p.a, p.b, c)), 1, greatest(size(_words) - 2, 0))"""
        ),
    )
    # digests of the 3-word windows with their place, in order, where any occurs twice: equal windows are neighbours
    out = out.withColumn("_grams", F.expr("if(size(array_distinct(_h)) < size(_h), array_sort(transform(_h, (h, i) -> struct(h, i))), cast(array() as array<struct<h: bigint, i: int>>))"))
    out = out.withColumn("_twice", F.expr("filter(zip_with(_grams, slice(_grams, 2, size(_grams)), (x, y) -> if(x.h = y.h, struct(x.i as a, y.i as b), null)), z -> z is not null)"))
    out = out.withColumn("_at", F.expr("array_sort(array_union(transform(_twice, z -> z.a), transform(_twice, z -> z.b)))"))
    stop = F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))
    counts = F.struct(
        F.size("_words").cast("bigint").alias("n_words"),
        (F.char_length("_t") - _count("\\x20\\x09-\\x0D")).alias("word_chars"),
        _count(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr("aggregate(zip_with(_at, slice(_at, 2, size(_at)), (p, q) -> least(3, coalesce(q - p, 3))), 0L, (s, x) -> s + x)").alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size(stop).cast("bigint").alias("n_stop_words"),
        _count("A-Z").alias("n_capitals"),
        _count("!").alias("n_exclamations"),
        _count("0-9").alias("n_digits"),
    )
    # one generated row each: a filter on a count stays above it and does not count again
    return out.select("_in", F.explode(F.array(counts)).alias("_m")).select("_in.*", "_m.*")


def compile_rules(rules=RULES) -> tuple[Column, Column]:
    """(all rules pass, names of those that fail) over the columns of ``measures``."""
    bad = []
    for name, count, over, least, most in rules:
        ratio = F.col(count) / F.when(F.col(over) > 0, F.col(over))
        fails = F.lit(False)
        if least is not None:
            fails = fails | (ratio < least)
        if most is not None:
            fails = fails | (ratio > most)
        bad.append(F.when(F.coalesce(fails, F.lit(False)), F.lit(name)))
    failed = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    return F.size(failed) == 0, failed


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs(doc_id, text, ...)`` with counts, base_failed, failed_rules and kept.

    base_failed: under 50 words, or over half of the words stand in 3-word windows found twice.
    Empty and null texts have no words and fail.  Columns of the input with the name of a
    count are replaced; repeated rows and null ids are rows like others.  A text of any length
    takes time in proportion (the windows that repeat are sorted); an empty table gives an empty one.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_capitals", "n_exclamations", "n_digits"]
    passes, failed = compile_rules(rules)
    out = measures(docs.drop(*counts, "base_failed", "failed_rules", "kept"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & passes)


def rules_sql() -> str:
    """The same table as DuckDB SQL over ``documents``, for comparison."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    fails = " OR ".join(
        f"coalesce({count} / nullif({over}, 0)::DOUBLE {sign} {limit}, false)" for _, count, over, least, most in RULES for sign, limit in (("<", least), (">", most)) if limit is not None
    )
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: trim(x, {ws}) <> '') AS lines FROM d),
g AS (SELECT r, i, {{'a': words[i], 'b': words[i + 1], 'c': words[i + 2]}} AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
f AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM f WHERE c > 1) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
  len(lines) AS n_lines, len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words, length(t) - length(translate(t, '{UPPER}', '')) AS n_capitals,
  length(t) - length(translate(t, '!', '')) AS n_exclamations, length(t) - length(translate(t, '0123456789', '')) AS n_digits
  FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({fails}) AS kept FROM b"""
