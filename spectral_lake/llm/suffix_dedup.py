"""Removal of long repeated byte strings with a sparse, range-partitioned suffix array.

A string of ``length`` bytes that starts at two places is found without listing every suffix:

1. *Sparse suffixes.*  In each window of ``length`` bytes the ``gram``-byte string with the
   least hash is its anchor.  The choice depends on the window's content only, so equal
   windows have equal anchors at equal offsets.  Consecutive windows with one anchor form a
   run; a run is the suffix that starts at its anchor, with the text to its left.
2. *Copies.*  Runs are counted by content before anything is shuffled whole.  Runs that occur
   twice are repeated from end to end; an anchor with a single run is unique.  Only runs
   that share an anchor with a different run need comparing, once for each content.
3. *Suffix array.*  These are dealt by sampled splitters over the leading bytes of the suffix
   (``repartitionByRange``) and each bucket sorts its suffixes, and the reversed texts to
   their left, by multikey quicksort.  Two runs share the window at offset t if they agree on
   t bytes to the left and length - t to the right, which adjacent common prefixes tell.
4. *Across boundaries.*  Equal leading bytes never straddle a bucket.  An anchor with more than
   ``hot`` different runs would be one bucket's load; the digests of its windows are dealt over
   all tasks instead, packed by block, which finds the same windows whatever the anchor's size.

Contents are compared by two 64-bit digests (anchor and run) in step 2, byte by byte in step 3.

``repeats_and_passages`` takes two lengths.  A repeated string of the greater one lies within what
repeats at the lesser, so its search reads those stretches only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, as_bytes, bounded_batches, discard, lean, materialise, mix, trim

_U = np.uint64
_SEGMENT = 1 << 20
RUN = "doc_id bigint, rk bigint, base bigint, ahash bigint, rhash bigint, start bigint, n int, off int"


def sliding_min(v: np.ndarray, span: int) -> np.ndarray:
    """Least of each ``span`` neighbours, in log2(span) passes."""
    out, have = v, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs_of(buf: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """(anchor digest, run digest, first window, windows, anchor - first window) of each run."""
    if len(buf) < length:
        return None
    found = []
    for base in range(0, len(buf) - length + 1, _SEGMENT):
        part = buf[base : base + _SEGMENT + length - 1]
        rolling = Rolling(part)
        h = rolling.grams(gram)
        keyed = (h & ~_U(0xFFFFFFFF)) | np.arange(len(h), dtype=_U)
        anchor = (sliding_min(keyed, length - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first, last = np.r_[0, cut], np.r_[cut, len(anchor)]
        at = anchor[first]
        shape = (last - first).astype(_U) * _U(1 << 32) + (at - first).astype(_U)
        digest = mix(rolling.of(first, last - 1 + length) ^ mix(shape))
        found.append((h[at], digest, first + base, last - first, at - first))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(length: int, gram: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, texts = [b.column(k) for k in ("doc_id", "rk", "base")], as_bytes(b.column("text"))
            rows, parts, held = [], [], 0
            for i, t in enumerate(texts):
                if t and (got := runs_of(np.frombuffer(t, np.uint8), length, gram)) is not None:
                    rows.append(np.full(len(got[0]), i))
                    parts.append(got)
                    held += len(got[0])
                if held > 200_000 or (i == len(texts) - 1 and parts):
                    at = pa.array(np.concatenate(rows))
                    a, r, s, n, o = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pa.record_batch(
                        [*(c.take(at) for c in own), pa.array(a.view(np.int64)), pa.array(r.view(np.int64)), pa.array(s.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(o.astype(np.int32))],
                        names=["doc_id", "rk", "base", "ahash", "rhash", "start", "n", "off"],
                    )
                    rows, parts, held = [], [], 0

    return run


def _contexts(length: int, gram: int):
    """The bytes of each wanted run: those before its anchor reversed, those from it on."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            held = 0
            texts, wanted = as_bytes(b.column("text")), b.column("wanted").to_pylist()
            for i, (t, want) in enumerate(zip(texts, wanted, strict=True)):
                for w in want:
                    s, n, o = w["start"], w["n"], w["off"]
                    a = s + o
                    right = t[a : s + n - 1 + length]
                    for to, x in zip(out, (w["ahash"], w["rhash"], w["variants"], n, o, right[:gram], t[s:a][::-1], right), strict=True):
                        to.append(x)
                    held += n + length
                if held > 1 << 24 or (i == len(texts) - 1 and out[0]):
                    yield _context_batch(out)
                    out, held = [[] for _ in range(8)], 0

    return run


def _context_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["ahash", "rhash", "variants", "n", "off", "lead", "before", "after"])


CONTEXT = "ahash bigint, rhash bigint, variants bigint, n int, off int, lead binary, before binary, after binary"
FLAG = "ahash bigint, rhash bigint, lo int, hi int"


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    """Strings as rows of ``width`` bytes, a multiple of 8, padded with zeros."""
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


def multikey_sort(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``rows`` within ``group`` and the common prefix of each with the one before it.

    Multikey quicksort, a word of eight bytes as a character, all unsettled segments at once:
    each pass refines only the segments whose members still agree.  The prefix is -1 where
    the group changes.
    """
    words = rows.view(">u8").astype(_U)
    order = np.argsort(group, kind="stable")
    g = group[order]
    fresh = np.r_[True, g[1:] != g[:-1]]
    for d in range(words.shape[1]):
        segment = np.cumsum(fresh)
        open_ = np.flatnonzero(~fresh | np.r_[~fresh[1:], False])
        if not len(open_):
            break
        key = words[order[open_], d]
        by = np.lexsort((key, segment[open_]))
        order[open_] = order[open_[by]]
        key = key[by]
        same = np.r_[False, (key[1:] == key[:-1]) & (segment[open_][1:] == segment[open_][:-1])]
        fresh[open_] = ~same
    g, sorted_rows = group[order], rows[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, np.r_[-1, np.where(g[1:] == g[:-1], lcp, -1)]


def shared_windows(group: np.ndarray, before: list[bytes], after: list[bytes], n: np.ndarray, off: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(run, first window, last window) of the windows that another run of its group also has."""
    pad = lambda k: max(8, -(-k // 8) * 8)
    m = len(group)
    hit = np.zeros((m, int(n.max()) + 2), np.int8)  # of each run, its windows from place 1 on
    r_order, r_lcp = multikey_sort(group, _matrix(after, pad(max(map(len, after)))))
    l_order, l_lcp = multikey_sort(group, _matrix(before, pad(max(map(len, before)))))
    r_class, l_class = np.empty(m, np.int64), np.empty(m, np.int64)
    low, high = off - n + 1, off
    for t in range(int(low.min()), int(high.max()) + 1):
        pick = np.flatnonzero((low <= t) & (t <= high))
        if len(pick) < 2:
            continue
        r_class[r_order] = np.cumsum(r_lcp < length - t)
        l_class[l_order] = np.cumsum(l_lcp < t)
        key = r_class[pick] * (m + 1) + l_class[pick]
        by = np.argsort(key, kind="stable")
        k = key[by]
        same = k[1:] == k[:-1]
        twice = np.r_[same, False] | np.r_[False, same]
        run = pick[by[twice]]
        hit[run, off[run] - t + 1] = 1
    step = np.diff(hit, axis=1)
    run, first = np.nonzero(step == 1)
    last = np.nonzero(step == -1)[1]
    return list(zip(run.tolist(), first.tolist(), (last - 1).tolist(), strict=True))


def _bucket(length: int, step: int = 4096):
    """Compares the runs of a bucket, sorted by leading bytes; a few thousand runs at a time."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush(rows: list[dict]) -> pa.RecordBatch:
            col = lambda k: np.array([r[k] for r in rows], np.int64)
            found = shared_windows(np.unique(col("ahash"), return_inverse=True)[1], [r["before"] for r in rows], [r["after"] for r in rows], col("n"), col("off"), length)
            return pa.record_batch(
                [pa.array([rows[i][k] for i, _, _ in found], pa.int64()) for k in ("ahash", "rhash")] + [pa.array([x[k] for x in found], pa.int32()) for k in (1, 2)],
                names=["ahash", "rhash", "lo", "hi"],
            )

        for b in batches:
            for r in b.to_pylist():
                if len(held) >= step and (r["lead"], r["ahash"]) != (held[-1]["lead"], held[-1]["ahash"]):
                    yield flush(held)
                    held = []
                held.append(r)
        if held:
            yield flush(held)

    return run


#: A block of hot runs: its windows (own), and their digests dealt over buckets.
BLOCK = "block bigint, bucket int, digests binary, own binary"


def _block_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("block", pa.int64()), ("bucket", pa.int32()), ("digests", pa.binary()), ("own", pa.binary()))
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


def _hot_blocks(length: int, buckets: int, step: int = 400_000):
    """For runs of hot anchors: blocks of windows, and the digests of each block by bucket."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            w, ah, rh, j = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = w % _U(buckets)
            order = np.lexsort((w, bucket))
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=_U))
            dealt = [(block, k, w[order[x:y]].tobytes(), None) for k, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if x < y]
            return _block_rows([*dealt, (block, None, None, np.stack([w, ah, rh, j.astype(_U)]).tobytes())])

        size = 0
        for b in batches:
            cols = [b.column(k).to_pylist() for k in ("ahash", "rhash", "n", "before", "after")]
            for ah, rh, n, before, after in zip(*cols, strict=True):
                j = np.arange(n)
                w = mix(Rolling(np.frombuffer(before[::-1] + after, np.uint8)).of(j, j + length) ^ mix((len(before) - j).astype(_U)))
                whose = np.full(n, ah, np.int64).view(_U)
                held.append((mix(w + whose), whose, np.full(n, rh, np.int64).view(_U), j))
                size += n
                if size > step:
                    yield flush()
                    block, held, size = block + 1, [], 0
        if held:
            yield flush()

    return run


@lean
def _met_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows in bucket order: of each block's digests those that the bucket holds twice or more."""
    held: list[dict] = []

    def flush(rows: list[dict]) -> pa.RecordBatch:
        own = [np.frombuffer(r["digests"], _U) for r in rows]
        values, counts = np.unique(np.concatenate(own), return_counts=True)
        twice = values[counts > 1]
        return _block_rows([(r["block"], r["bucket"], hit.tobytes(), None) for r, x in zip(rows, own, strict=True) if len(hit := np.intersect1d(x, twice))])

    for b in batches:
        for r in b.to_pylist():
            if held and held[-1]["bucket"] != r["bucket"]:
                yield flush(held)
                held = []
            held.append(r)
    if held:
        yield flush(held)


def _stretches(left: pa.Table, right: pa.Table) -> pa.Table:
    """The windows of a block that were met twice, as stretches of neighbours."""
    (block,) = left.to_pylist()
    w, ah, rh, j = np.frombuffer(block["own"], _U).reshape(4, -1)
    twice = np.concatenate([np.empty(0, _U), *(np.frombuffer(r["digests"], _U) for r in right.to_pylist())])
    at = np.flatnonzero(np.isin(w, twice))
    ah, rh, j = ah[at].view(np.int64), rh[at].view(np.int64), j[at].astype(np.int32)
    first = np.flatnonzero(np.r_[True, (ah[1:] != ah[:-1]) | (rh[1:] != rh[:-1]) | (np.diff(j) != 1)][: len(at)])
    last = np.r_[first[1:], len(at)][: len(first)] - 1
    trim()
    return pa.table({"ahash": pa.array(ah[first]), "rhash": pa.array(rh[first]), "lo": pa.array(j[first]), "hi": pa.array(j[last])})


def cut(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """``text`` without ``spans`` (lo, hi), the bytes removed, and the stretches these make."""
    out, end, removed, n = [], 0, 0, 0
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if lo > end or n == 0:
            out.append(text[end:lo])
            removed, n, end = removed + hi - lo, n + 1, hi
        elif hi > end:
            removed, end = removed + hi - end, hi
    out.append(text[end:])
    return b"".join(out), removed, n


def _finish(pairs: tuple[tuple[str, tuple[str, str, str]], ...]):
    """For each column of spans: the bytes kept, how many went, in how many stretches."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in as_bytes(b.column("text"))]
            gone = [x for x in b.schema.names if x == "text" or x in dict(pairs)]
            rest = [x for x in b.schema.names if x not in gone]
            made = {"n_bytes": pa.array(map(len, texts), pa.int64())}
            for column, names in pairs:
                kept, removed, n = zip(*map(cut, texts, b.column(column).to_pylist()), strict=True) if texts else ((), (), ())
                # a cut may split a character: as text, its bytes on either side are dropped
                whole = pa.array([x.decode(errors="ignore") for x in kept], pa.string()) if names[0].endswith("text") else pa.array(kept, pa.binary())
                made |= dict(zip(names, (whole, pa.array(removed, pa.int64()), pa.array(n, pa.int64())), strict=True))
            yield pa.record_batch([*(b.column(x) for x in rest), *made.values()], names=[*rest, *made])

    return run


def _pieces(length: int):
    """The stretches of at least ``length`` bytes of each text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for i, (t, spans) in enumerate(zip(as_bytes(b.column("text")), b.column("spans").to_pylist(), strict=True)):
                end, stretches = -1, []
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
                    if lo > end:
                        stretches.append([lo, hi])
                    stretches[-1][1] = end = max(hi, stretches[-1][1])
                for lo, hi in stretches:
                    if hi - lo >= length:
                        for to, x in zip(out, (i, lo, t[lo:hi]), strict=True):
                            to.append(x)
            at = pa.array(out[0], pa.int64())
            yield pa.record_batch([b.column("doc_id").take(at), b.column("rk").take(at), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["doc_id", "rk", "base", "text"])

    return run


def repeated_spans(slim: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """(doc_id, rk, spans) from ``slim(doc_id, rk, base, text)``, where ``text`` starts at byte ``base`` of its document.

    spans lists the stretches (lo, hi) of a document that are covered by ``length``-byte strings
    which start at two or more places of all texts.  The result is written; what led to it is removed.
    """
    spark = slim.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = materialise(slim.mapInArrow(_runs(length, gram), RUN))
    again = materialise(every.groupBy("ahash").agg(F.count("*").alias("total")).where("total > 1").select("ahash"))
    runs = materialise(every.join(again, "ahash", "left_semi"))
    discard(every, again)
    kinds = runs.groupBy("ahash", "rhash").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "rk", "base", "start", "n", "off")).alias("rep"))
    kinds = materialise(kinds.select("ahash", "rhash", "copies", "rep.*"))
    per = materialise(kinds.groupBy("ahash").agg(F.count("*").alias("variants")).where("variants > 1"))  # written, so that the join can split an anchor
    wanted = kinds.join(per, "ahash").groupBy("doc_id", "rk", "base").agg(F.collect_list(F.struct("ahash", "rhash", "variants", "start", "n", "off")).alias("wanted"))
    d, m = slim.alias("d"), wanted.alias("m")
    found = d.join(m, (F.col("d.rk") == F.col("m.rk")) & F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.base") == F.col("m.base"))).select("d.text", "m.wanted")
    contexts = materialise(found.mapInArrow(_contexts(length, gram), CONTEXT).dropDuplicates(["ahash", "rhash"]))
    calm = contexts.where(F.col("variants") <= hot)
    flags = calm.repartitionByRange(parts, "lead", "ahash").sortWithinPartitions("lead", "ahash").mapInArrow(_bucket(length), FLAG)
    buckets = min(60_000, 2 * parts)
    blocks = materialise(contexts.where(F.col("variants") > hot).select("ahash", "rhash", "n", "before", "after").mapInArrow(_hot_blocks(length, buckets), BLOCK))
    dealt = blocks.where("own is null").select("block", "bucket", "digests", "own").repartition(parts, "bucket").sortWithinPartitions("bucket")
    hits = dealt.mapInArrow(_met_twice, BLOCK).withColumnRenamed("block", "of")
    stretches = blocks.where("own is not null").groupBy("block").cogroup(hits.groupBy("of")).applyInArrow(_stretches, FLAG)
    whole = kinds.where("copies > 1").select("ahash", "rhash", F.lit(0).alias("lo"), (F.col("n") - 1).cast("int").alias("hi"))
    flags = materialise(flags.union(stretches).union(whole))
    start = F.col("base") + F.col("start")
    span = F.struct((start + F.col("lo")).alias("lo"), (start + F.col("hi") + length).alias("hi"))
    out = materialise(runs.join(flags, ["ahash", "rhash"]).groupBy("doc_id", "rk").agg(F.collect_set(span).alias("spans")))
    discard(runs, kinds, per, contexts, blocks, flags)
    return out


def _attach(left: DataFrame, spans: DataFrame, name: str, how: str = "left") -> DataFrame:
    """``left(doc_id, rk, ...)`` with the spans of each row as ``name``."""
    s = spans.select(F.col("doc_id").alias("s_doc"), F.col("rk").alias("s_rk"), F.col("spans").alias(name))
    return left.join(s, (F.col("rk") == F.col("s_rk")) & F.col("doc_id").eqNullSafe(F.col("s_doc")), how).drop("s_doc", "s_rk")


def _written(joined: DataFrame, pairs: tuple[tuple[str, tuple[str, str, str]], ...]) -> DataFrame:
    rest = [f for f in joined.drop("rk", "text", *dict(pairs)).schema]
    made = ["n_bytes bigint"] + [f"{kept} {'string' if kept.endswith('text') else 'binary'}, {removed} bigint, {n} bigint" for _, (kept, removed, n) in pairs]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + made)
    return joined.select(*[f"`{f.name}`" for f in rest], "text", *dict(pairs)).mapInArrow(_finish(pairs), schema)


REPEATS = ("spans", ("kept_bytes", "n_removed", "n_spans"))
AS_TEXT = ("spans", ("kept_text", "n_removed", "n_spans"))
PASSAGES = ("passage_spans", ("passage_free_text", "n_passage_bytes", "n_passages"))
_OWN = ("rk", "base", "spans", "passage_spans", "s_doc", "s_rk", "n_bytes", "kept_text", *REPEATS[1], *PASSAGES[1])


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 64, hot: int = 256, text: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` without each byte in a ``length``-byte string that starts anywhere else too.

    The text column gives way to kept_bytes (binary), n_bytes, n_removed and n_spans; other
    columns stay.  With ``text``, kept_text (string) stands for kept_bytes.  Strings are judged on the input and never cross documents.  A null text is
    empty; rows with equal doc_id and text, or a null doc_id, each keep their row.  A text of any
    length is read in segments.  An empty table gives an empty table.  Columns of the input named
    as those of ``_OWN`` are dropped.
    """
    keyed = bounded_batches(docs).drop(*_OWN).withColumn("rk", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(keyed.select("doc_id", "rk", F.lit(0).cast("bigint").alias("base"), "text"), length, gram, hot)
    return _written(_attach(keyed, spans, "spans"), (AS_TEXT if text else REPEATS,))


def repeats_and_passages(docs: DataFrame, length: int = 400, passage: int = 250, gram: int = 64, hot: int = 256) -> DataFrame:
    """``remove_repeats`` at ``length`` bytes and, besides, at ``passage`` bytes, which is at most ``length``.

    Passages are kept in columns of their own: passage_free_text (string), n_passage_bytes, n_passages.
    250 bytes is what 50 words of prose take at least.  Other cases as in ``remove_repeats``.
    """
    keyed = bounded_batches(docs).drop(*_OWN).withColumn("rk", F.xxhash64("doc_id", "text"))
    slim = keyed.select("doc_id", "rk", F.lit(0).cast("bigint").alias("base"), "text")
    short = repeated_spans(slim, passage, min(gram, passage // 4), hot)
    long_ones = short.where(F.expr(f"aggregate(spans, 0L, (s, x) -> s + x.hi - x.lo) >= {length}"))
    pieces = materialise(_attach(slim.drop("base"), long_ones, "spans", "inner").select("doc_id", "rk", "text", "spans").mapInArrow(_pieces(length), "doc_id bigint, rk bigint, base bigint, text binary"))
    spans = repeated_spans(pieces, length, gram, hot)
    discard(pieces)
    return _written(_attach(_attach(keyed, short, "passage_spans"), spans, "spans"), (REPEATS, PASSAGES))
