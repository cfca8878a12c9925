"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

1. A document becomes its set of word shingles (64-bit digests), a 128-bit digest of the
   whole set and ``chunks * width`` MinHash symbols of 16 bits.  Equal sets are one node.
2. *Multi-index join.*  A signature is split in ``chunks`` of ``width`` symbols.  By the
   pigeonhole principle two signatures at distance < chunks * (errors + 1) agree in some chunk
   but for ``errors`` symbols; each choice of the symbols in error is left out in turn and the
   rest, with chunk and choice, is a key.  All pairs under the distance share a key.
3. Keys with the same members are one bucket.  Within a bucket, nodes whose signatures differ
   in at most ``distance + slack`` symbols are linked, as a spanning forest and not as pairs; the
   components of these links are the candidate groups.
4. Each candidate group compares its full sets, again keeping a spanning forest of the true
   links.  A pair that is already connected is not compared.

Groups are bounded: a group heavier than its cap is split in blocks that share eight pivots.
What stays apart from the first pivot is compared with every block, slice by slice, so that no
link is lost whatever the group's size.

At similarity 0.85 a pair shares no key with probability below 1e-6, at 0.80 2e-5 (8 chunks of 5
symbols, 1 error).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, as_bytes, bounded_batches, components, lean, materialise, mix, seeds

_U = np.uint64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_digests(text: bytes) -> np.ndarray:
    """A digest of each word, A-Z as a-z."""
    buf = np.frombuffer(text.translate(_LOWER), np.uint8)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    step = np.diff(inside)
    lo, hi = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return Rolling(buf).of(lo, hi)


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct digests of the ``words``-word shingles; a shorter text is one shingle."""
    w = word_digests(text) if text else np.empty(0, _U)
    if not len(w):
        return w
    take = min(words, len(w))
    weights = seeds(words, 5) | _U(1)
    total = sum((w[k : len(w) - take + 1 + k] * weights[k] for k in range(take)), np.full(len(w) - take + 1, take, _U))
    return np.unique(mix(total))


def set_digest(items: np.ndarray) -> bytes:
    """128 bits that tell a set from others."""
    return np.array([mix(items).sum(dtype=_U), mix(items ^ _U(0x5BD1E995)).sum(dtype=_U) + _U(len(items))], _U).tobytes()


def signature(items: np.ndarray, size: int) -> np.ndarray:
    a, c = seeds(size, 11) | _U(1), seeds(size, 13)
    least = np.full(size, np.iinfo(_U).max, _U)
    for i in range(0, len(items), 2048):
        least = np.minimum(least, (items[i : i + 2048, None] * a + c).min(axis=0))
    return (mix(least) & _U(0xFFFF)).astype(np.uint16)


def chunk_keys(sigs: np.ndarray, chunks: int, width: int, errors: int) -> np.ndarray:
    """A key for each chunk and each choice of symbols in error: rows x keys."""
    parts = sigs.reshape(len(sigs), chunks, width).astype(_U)
    salt, out = seeds(width, 17) | _U(1), []
    for number, gone in enumerate(combinations(range(width), errors)):
        rest = [i for i in range(width) if i not in gone]
        h = mix((parts[:, :, rest] * salt[rest]).sum(axis=2, dtype=_U))
        for i in rest:  # 16-bit symbols, one after another: no two sequences mix to one value by sum alone
            h = mix(h * _U(0x10001) + parts[:, :, i])
        out.append(mix(h + seeds(chunks, 1000 + number)))
    return np.concatenate(out, axis=1)


def _sketch(words: int, size: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, sigs = [], [], []
            for t in as_bytes(b.column("text")):
                s = shingle_set(t, words)
                n.append(len(s))
                node.append(set_digest(s) if len(s) else None)
                sigs.append(signature(s, size).tobytes() if len(s) else None)
            yield pa.record_batch([b.column("doc_id"), b.column("rk"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "rk", "n_shingles", "node", "sig"])

    return run


def _keyed(chunks: int, width: int, errors: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(part.num_rows, -1)
                keys = chunk_keys(sigs, chunks, width, errors)
                at = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), part.column("node").take(at)], names=["grp", "node"])

    return run


class Forest:
    def __init__(self, n: int) -> None:
        self.of = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = self.of[i], self.of[j]
            if a != b:
                self.of[self.of == b] = a
                self.edges.append((i, j))


class BySignature:
    """Pairs whose signatures differ in at most ``most`` symbols."""

    def __init__(self, most: int, symbol: type = np.uint16) -> None:
        self.most, self.symbol = most, symbol

    def load(self, rows: list[dict]) -> None:
        self.sigs = np.frombuffer(b"".join(r["payload"] for r in rows), self.symbol).reshape(len(rows), -1)

    def like(self, i: int, others: np.ndarray) -> np.ndarray:
        return others[(self.sigs[others] != self.sigs[i]).sum(axis=1) <= self.most]


class BySet:
    """Pairs with 100 * common >= percent * union on the full shingle sets."""

    def __init__(self, percent: int, words: int) -> None:
        self.percent, self.words = percent, words

    def load(self, rows: list[dict]) -> None:
        sets = [shingle_set(r["payload"], self.words) for r in rows]
        self.n = np.array([len(s) for s in sets])
        self.flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.ends = np.cumsum(self.n)
        self.mark = np.zeros(int(self.flat.max()) + 1 if len(self.flat) else 1, bool)

    def like(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.flat[self.ends[i] - self.n[i] : self.ends[i]]
        close = others[100 * np.minimum(self.n[others], self.n[i]) >= self.percent * np.maximum(self.n[others], self.n[i])]
        if not len(close):
            return close
        self.mark[own] = True
        if 4 * len(close) > len(self.n):
            common = np.add.reduceat(self.mark[self.flat], self.ends - self.n, dtype=np.int64)[close]
        else:
            common = np.array([self.mark[self.flat[self.ends[j] - self.n[j] : self.ends[j]]].sum() for j in close.tolist()])
        self.mark[own] = False
        return close[100 * common >= self.percent * (self.n[close] + self.n[i] - common)]


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows of one key after another, of batches sorted by them."""
    held: list[dict] = []
    at = None
    for b in batches:
        for r in b.to_pylist():
            now = tuple(r[k] for k in keys)
            if held and now != at:
                yield held
                held = []
            at = now
            held.append(r)
    if held:
        yield held


LINK = "grp bigint, a binary, b binary"


def _link_rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["grp", "a", "b"])


def _blocks(measure: BySignature | BySet):
    """Links of a block.  role 0: a member, 1: a pivot, 2: one to be compared with the members only.

    A row (node, null) says that the node stays apart from the block's first pivot.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _grouped(batches, ("grp", "block", "slice")):
            best: dict[bytes, dict] = {}
            for r in rows:
                if r["node"] not in best or r["role"] > best[r["node"]]["role"]:
                    best[r["node"]] = r
            rows = sorted(best.values(), key=lambda r: (-r["role"], r["node"]))
            if len(rows) < 2:
                continue
            measure.load(rows)
            forest, role = Forest(len(rows)), np.array([r["role"] for r in rows])
            every = np.arange(len(rows))
            for i in range(len(rows)):
                if role[i] == 0 and role[0] == 2:
                    break  # members of one block have been compared
                rest = every[i + 1 :]
                rest = rest[forest.of[rest] != forest.of[i]]
                if len(rest):
                    forest.link(i, measure.like(i, rest))
            grp = rows[0]["grp"]
            out += [(grp, rows[i]["node"], rows[j]["node"]) for i, j in forest.edges]
            if role[0] == 1:
                out += [(grp, rows[i]["node"], None) for i in np.flatnonzero(forest.of != forest.of[0]).tolist()]
            if len(out) > 20_000:
                yield _link_rows(out)
                out = []
        if out:
            yield _link_rows(out)

    return run


def group_links(members: DataFrame, measure: BySignature | BySet, cap: int) -> DataFrame:
    """A spanning forest of the links in each group of ``members(grp, node, weight, payload)``.

    Groups up to ``cap`` in weight are one block.  Heavier ones are dealt over blocks by node,
    each with the group's pivots; nodes apart from the first pivot then meet every block.  Beyond
    256 blocks these grow with the group, to 16 times ``cap``: fewer blocks to meet.
    """
    spark = members.sparkSession
    members = materialise(members)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = lambda most: F.ceil(F.sum("weight") / F.lit(most))
    blocks_of = F.least(share(cap), F.greatest(F.lit(256), share(16 * cap))).cast("int")
    sizes = members.groupBy("grp").agg(blocks_of.alias("blocks"))
    run = lambda df: df.repartition(parts, "grp", "block", "slice").sortWithinPartitions("grp", "block", "slice").mapInArrow(_blocks(measure), LINK)
    zero = F.lit(0)
    large = materialise(sizes.where("blocks > 1"))
    if large.isEmpty():
        return run(members.select("grp", zero.alias("block"), zero.alias("slice"), zero.alias("role"), "node", "payload")).select("a", "b")
    small = members.join(large, "grp", "left_anti").select("grp", zero.alias("block"), zero.alias("slice"), zero.alias("role"), "node", "payload")
    h = F.xxhash64("node")
    big = materialise(members.join(large, "grp").withColumn("block", F.pmod(h, "blocks").cast("int")))
    pivots = big.groupBy("grp", F.pmod(F.shiftright(h, 20), F.lit(8)).alias("k")).agg(F.min_by(F.struct("node", "payload", "blocks"), h).alias("p"))
    spread = pivots.select("grp", F.explode(F.sequence(zero, F.col("p.blocks") - 1)).alias("block"), zero.alias("slice"), F.lit(1).alias("role"), "p.node", "p.payload")
    first = materialise(run(big.select("grp", "block", zero.alias("slice"), zero.alias("role"), "node", "payload").union(spread)))
    apart = first.where("b is null").select("grp", F.col("a").alias("node")).distinct()
    left = big.join(apart, ["grp", "node"])
    slices = left.groupBy("grp").agg(blocks_of.alias("slices"))
    left = left.join(slices, "grp").withColumn("slice", F.pmod(F.shiftright(h, 10), "slices").cast("int"))
    asked = left.select("grp", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), "slice", F.lit(2).alias("role"), "node", "payload")
    against = big.join(slices, "grp").select("grp", "block", F.explode(F.sequence(zero, F.col("slices") - 1)).alias("slice"), zero.alias("role"), "node", "payload")
    second = run(asked.union(against))
    return run(small).union(first.where("b is not null")).union(second).select("a", "b")


def row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with rk, which tells rows apart that share a doc_id or have none."""
    return docs.withColumn("rk", F.xxhash64("doc_id", "text"))


def grouped(docs: DataFrame, words: int = 5, percent: int = 85, chunks: int = 8, width: int = 5, errors: int = 1, slack: int = 5, cap: int = 256, set_cap: int = 256_000) -> DataFrame:
    """``near_duplicates`` with, besides, the row's key rk and the digest ``root`` of its group, null without words."""
    size, distance = chunks * width, chunks * (errors + 1) - 1
    slim = row_key(bounded_batches(docs).select("doc_id", "text"))
    sketch = materialise(slim.mapInArrow(_sketch(words, size), "doc_id bigint, rk bigint, n_shingles bigint, node binary, sig binary"))
    nodes = materialise(sketch.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("rk").alias("rk"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")))
    keyed = nodes.select("sig", "node").mapInArrow(_keyed(chunks, width, errors), "grp bigint, node binary")
    buckets = keyed.groupBy("grp").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("c > 1")
    chosen = buckets.groupBy("c", "x", "y").agg(F.min("grp").alias("grp")).select("grp")
    members = keyed.join(chosen, "grp").distinct().join(nodes.select("node", "sig"), "node").select("grp", "node", F.lit(1).alias("weight"), F.col("sig").alias("payload"))
    groups = components(group_links(members, BySignature(distance + slack), cap))
    # whole texts of the nodes in candidate groups, one row's each; should two rows share a key, the set tells them apart
    wanted = groups.join(nodes, "node").select("node", F.xxhash64("root").alias("grp"), "rk", (F.col("n") + 1000).alias("weight"))
    texts = slim.join(wanted, "rk").select("grp", "node", "weight", F.col("text").alias("payload"))
    checked = texts.mapInArrow(_own_text(words), "grp bigint, node binary, weight bigint, payload binary").dropDuplicates(["grp", "node"])
    roots = components(group_links(checked, BySet(percent, words), set_cap))
    placed = nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = materialise(placed.groupBy("root").agg(F.min("rep").alias("component_id")))  # written, so that the join can split a large group
    of = placed.join(least, "root").select("node", "root", "component_id")
    out = sketch.select("doc_id", "rk", "n_shingles", "node").join(of, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "rk", "root").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text)``; options as in ``grouped``.

    component_id is the least doc_id reachable over links of similarity >= percent/100; kept
    tells whether it is the row's own.  Null or wordless texts have an empty set and no link.
    A null doc_id counts as greater than any other.  Repeated rows share one component and
    each keep their row; an empty table gives an empty table.
    """
    return grouped(docs, **options).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group: a row with the least doc_id, null after all others.

    Rows without words are no group and stay, equal ones once.  Different texts stay if they
    share a doc_id or have none.  A column rk of the input is dropped.
    """
    docs = docs.drop("rk")
    kept = grouped(docs, **options).where("kept").select("rk", "root")
    grouped_rows = kept.where("root is not null").groupBy("root").agg(F.min("rk").alias("rk")).select("rk")
    chosen = grouped_rows.union(kept.where("root is null").select("rk"))
    return row_key(docs).join(chosen, "rk", "left_semi").dropDuplicates(["rk"]).drop("rk")


def _own_text(words: int) -> Callable:
    """Rows whose text is that of their node; texts as bytes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = as_bytes(b.column("payload")), []
            for i, (t, node) in enumerate(zip(texts, b.column("node").to_pylist(), strict=True)):
                s = shingle_set(t, words)
                if len(s) and node == set_digest(s):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([b.column("grp").take(at), b.column("node").take(at), b.column("weight").take(at), pa.array([texts[i] for i in keep], pa.binary())], names=["grp", "node", "weight", "payload"])

    return run
