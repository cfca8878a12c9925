"""License detection by ordered signature rules, with DataFrame operations only.

The rules are the hand-written expressions of ``license_signatures``, over normalised words.  A
text without any of their keywords is not scanned.  In others, each word that an expression may
start with is a candidate; the words from there on are tried against the expressions of that word
only, each a constant pattern.  Detections keep their word interval; one that lies in an interval
of better priority, or in a longer one of the same, is suppressed.  As no expression spans more
than ``SPAN`` words, the intervals that may hold another start at the last ``SPAN`` candidates:
the work is in proportion to the text, however many licenses it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_signatures import KEYWORDS, SPAN, signature_rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

FOUND = "struct<label: string, prio: int, conf: double, i: int, lo: int, hi: int>"


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _tried() -> str:
    """SQL for the detections at candidate ``c``: a struct of word number i, word w and the words t from it on."""
    by_word: dict[str, list[str]] = {}
    for i, prio, conf, label, words, rx in signature_rules():
        pattern = f"'^(?:{rx})(?= |$)'"
        size = f"regexp_count(regexp_extract(c.t, {pattern}, 0), ' ')"
        found = f"if(c.t rlike {pattern}, named_struct('label', '{label}', 'prio', {prio}, 'conf', double({conf}), 'i', {i}, 'lo', c.i, 'hi', c.i + {size}), null)"
        for w in words:
            by_word.setdefault(w, []).append(found)
    cases = " ".join(f"when '{w}' then array({', '.join(found)})" for w, found in by_word.items())
    return f"array_compact(case c.w {cases} end)"


#: SQL: whether detection e suppresses detection d.
_BEATS = "e.lo <= d.lo and e.hi >= d.hi and (e.prio < d.prio or (e.prio = d.prio and (e.hi - e.lo > d.hi - d.lo or (e.hi - e.lo = d.hi - d.lo and e.i < d.i))))"


def scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    detections lists the label, priority, confidence and word interval of what is left after
    suppression.  A null text is empty and has no label; score is the best confidence, 0
    without any.  Repeated rows and null ids are rows like others, a text of any length takes time
    in proportion, an empty table gives an empty table; columns of the input with a name of the
    result are replaced, any other name may stand.
    """
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    docs = docs.drop(*made)
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    # the input's columns stay in a struct, so that none of its names meets one of ours
    out = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("input"), F.btrim(F.regexp_replace(lower, GAP, " ")).alias("norm"))
    n_words = F.when(F.col("norm") == "", 0).otherwise(F.char_length("norm") - F.char_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1)
    gate = _any([F.contains("norm", F.lit(k.strip())) for k in KEYWORDS])
    out = out.select("input", n_words.cast("bigint").alias("n_words"), F.when(gate, F.split("norm", " ")).alias("words"))
    firsts = sorted({w for r in signature_rules() for w in r[4]} | {phrase.split()[0] for phrase, _ in BASE})
    starts = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda c: c["w"].isin(firsts))
    context = F.transform(starts, lambda c: F.struct(c["i"], c["w"], F.array_join(F.slice("words", c["i"] + 1, SPAN), " ").alias("t")))
    out = out.select("input", "n_words", context.alias("starts"))
    base = F.expr("array_compact(transform(starts, c -> case " + " ".join(f"when c.w = '{p.split()[0]}' and startswith(concat(c.t, ' '), '{p} ') then struct(c.i as at, '{label}' as label)" for p, label in BASE) + " end))")
    tried = F.expr(f"filter(transform(starts, c -> {_tried()}), x -> size(x) > 0)")
    out = out.select("input", "n_words", base.alias("base"), tried.alias("tried"))
    # first among the detections of one start, which leaves few, then against the starts before
    own = F.expr(f"transform(tried, x -> filter(x, d -> not exists(x, e -> {_BEATS})))")
    out = out.select("input", "n_words", "base", own.alias("own"))
    kept = F.expr(f"flatten(transform(own, (x, k) -> filter(x, d -> not exists(flatten(slice(own, greatest(k + 2 - {SPAN}, 1), least(k + 1, {SPAN}))), e -> {_BEATS}))))")
    out = out.select("input", "n_words", F.coalesce("base", F.array().cast("array<struct<at: int, label: string>>")).alias("base"), F.coalesce(kept, F.array().cast(f"array<{FOUND}>")).alias("detections"))
    at, labels = F.transform("base", lambda b: b["at"]), F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    every = F.array_sort(F.array_union(labels, F.transform("detections", lambda d: d["label"])))
    best = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["conf"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.6).otherwise(0.0))
    return out.select(
        "input.*",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(at).cast("bigint").alias("first_word"),
        F.array_max(at).cast("bigint").alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        best.alias("score"),
        "detections",
    )
