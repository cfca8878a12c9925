"""Documents whose word n-grams agree: a Jaccard join over signature trees.

1. A document becomes its set of 4-word shingles; equal sets are one node.
2. *Blocks.*  With shingles in one common order, two sets at the threshold share one of each
   other's first n - ceil(n * percent / 100) + 1; frequent shingles come last in it, so that
   passages of many documents rarely make a block.  A block is such a shingle and a size class, a
   range of sizes from one power of two to the next; a set that a smaller class can link with is in that too.
3. *Signature trees.*  A set's bitmap has a bit for each shingle's hash; what collides is its excess.
   A tree over a block's sets, by size, holds in each node the OR of its bitmaps, the range of its
   sizes and its largest excess.  No set below the one node has more in common with a set below the other than

       bits that both nodes have + the lesser of the two excesses.

   A dual traversal from the roots goes below pairs of nodes that this leaves a chance.
4. Sets that the leaves leave are candidates; the components of these compare their full sets, by
   trees again, and exactly at the leaves.

Links are kept as spanning forests; large blocks are split by ``minhash.group_links``.
No link is lost: every bound is exact, the order of shingles decides only how large blocks are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, components, discard, lean, materialise, mix, seeds
from .minhash import BySet, _own_text, group_links, row_key, set_digest, shingle_set

_U = np.uint64
#: A shingle that so many documents of one Arrow batch share counts as frequent; the most frequent ones are told to all tasks, 16 bytes each.
OFTEN, TOLD = 8, 1 << 18
_CLASS = _U(63)


# --- signatures -------------------------------------------------------------------------


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of words for each set: a bit for each item's hash, modulo ``bits``."""
    out = np.zeros((len(sets), bits), bool)
    for i, s in enumerate(sets):
        out[i, (s & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1, bitorder="little").view(_U)


def size_class(n: int) -> int:
    return n.bit_length() - 1


def bits_of(level: int) -> int:
    """Bits of the bitmaps of a size class: two to four a shingle."""
    return max(64, 4 << level)


class SignatureTree:
    """Sets by size, in nodes of ``fan``; each level holds OR of bitmaps, size range, largest excess."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, fan: int = 8) -> None:
        self.order = np.argsort(sizes, kind="stable")
        words, sizes = words[self.order], sizes[self.order].astype(np.int64)
        excess = sizes - np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        self.fan, self.levels = fan, [(words, sizes, sizes, excess)]
        while len(words) > 1:
            at = np.arange(0, len(words), fan)
            words = np.bitwise_or.reduceat(words, at, axis=0)
            low, high, excess = (f.reduceat(x, at) for f, x in zip((np.minimum, np.maximum, np.maximum), self.levels[-1][1:], strict=True))
            self.levels.append((words, low, high, excess))

    def _hopeful(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        words, low, high, excess = self.levels[level]
        fit = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        i, j = i[fit], j[fit]
        step = max(1, (1 << 20) // words.shape[1])
        common = [np.bitwise_count(words[i[k : k + step]] & words[j[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), step)]
        most = np.concatenate([*common, np.empty(0, np.int64)]) + np.minimum(excess[i], excess[j])
        fit[fit] = (100 + percent) * most >= percent * (low[i] + low[j])
        return fit

    def pairs(self, percent: int, step: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places i, j of pairs of sets that may have 100 * common >= percent * union, each once; ``step`` pairs of nodes at a time."""
        child = np.arange(self.fan)
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, i, j = todo.pop()
            if len(i) > step:
                todo.append((level, i[step:], j[step:]))
                i, j = i[:step], j[:step]
            fit = self._hopeful(level, i, j, percent)
            i, j = i[fit], j[fit]
            if not level:
                yield self.order[i], self.order[j]
            elif len(i):
                a = np.broadcast_to(i[:, None, None] * self.fan + child[:, None], (len(i), self.fan, self.fan)).reshape(-1)
                b = np.broadcast_to(j[:, None, None] * self.fan + child, (len(j), self.fan, self.fan)).reshape(-1)
                there = len(self.levels[level - 1][1])
                keep = (a < there) & (b < there) & (a <= b)
                todo.append((level - 1, a[keep], b[keep]))

    def matrix(self, percent: int) -> np.ndarray:
        near = np.zeros((len(self.order), len(self.order)), bool)
        for i, j in self.pairs(percent):
            near[i, j] = near[j, i] = True
        return near


class ByTree:
    """Pairs that a signature tree over a block's bitmaps leaves.  A payload is the set's size and its bitmap."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def load(self, rows: list[dict]) -> None:
        width = bits_of(rows[0]["grp"] & 63) // 64
        sizes, words = np.zeros(len(rows), np.int64), np.zeros((len(rows), width), _U)
        for k, r in enumerate(rows):
            sizes[k] = int.from_bytes(r["payload"][:8], "big")
            own = np.frombuffer(r["payload"], _U, offset=8)
            words[k] = np.bitwise_or.reduce(own.reshape(-1, width))  # a larger class's bitmap, folded
        self.near = SignatureTree(words, sizes).matrix(self.percent)

    def like(self, i: int, others: np.ndarray) -> np.ndarray:
        return others[self.near[i, others]]


class TreeOfSets(BySet):
    """Pairs with 100 * common >= percent * union: a tree leaves few, and these compare their full sets."""

    def load(self, rows: list[dict]) -> None:
        super().load(rows)
        bits = 1 << min(17, max(6, int(4 * self.n.max(initial=1)).bit_length()))  # larger sets have an excess instead of more bits
        sets = np.split(self.flat.astype(_U), self.ends[:-1])
        self.near = SignatureTree(bitmaps([mix(s) for s in sets], bits), self.n).matrix(self.percent)

    def like(self, i: int, others: np.ndarray) -> np.ndarray:
        return super().like(i, others[self.near[i, others]])


#: Rows of a table that is sent to every executor at most; a larger one is joined by a shuffle.
SENT = 1 << 20


def _sent(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its size allows."""
    return F.broadcast(df) if df.count() <= SENT else df


# --- blocks -----------------------------------------------------------------------------


def _often(words: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, words) for t in as_bytes(b.column("text"))]
            found, n = np.unique(np.concatenate([*sets, np.empty(0, _U)]), return_counts=True)
            many = n >= OFTEN
            yield pa.record_batch([pa.array(found[many].view(np.int64)), pa.array(n[many].astype(np.int64))], names=["item", "n"])

    return run


def frequent(texts: DataFrame, words: int, told: int = TOLD) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents share, ascending, and how often they were met: the most frequent ones, ``told`` at most.

    It only orders shingles: one that is left out counts as rare.  How often is told in steps of a fourth of
    a doubling, so that a few counts say which steps go to the driver; no step goes in part.
    """
    step = F.floor(4 * F.log2("n")).cast("int").alias("step")
    counted = materialise(texts.mapInArrow(_often(words), "item bigint, n bigint").groupBy("item").agg(F.sum("n").alias("n")).select("item", step))
    least, left = 1 << 20, told
    for r in counted.groupBy("step").count().orderBy(F.desc("step")).collect():  # 252 rows at most
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    got = counted.where(F.col("step") >= least).toPandas()
    discard(counted)
    items = got["item"].to_numpy(np.int64).view(_U)
    order = np.argsort(items)
    return items[order], got["step"].to_numpy(np.int64)[order] + 1


def prefix(items: np.ndarray, percent: int, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first items in the common order, rare ones before frequent ones, of which linked sets share one."""
    take = len(items) + (-percent * len(items)) // 100 + 1
    if len(known[0]):
        at = np.minimum(np.searchsorted(known[0], items), len(known[0]) - 1)
        rank = np.where(known[0][at] == items, known[1][at], 0)
        if rank.any():
            items = items[np.lexsort((items, rank))]
    return items[:take]


def _sketch(words: int, percent: int, known: tuple[np.ndarray, np.ndarray]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, first, bits = [], [], [], []
            for t in as_bytes(b.column("text")):
                s = shingle_set(t, words)
                n.append(len(s))
                node.append(set_digest(s) if len(s) else None)
                # six bytes an item: those that agree by chance only meet
                first.append(prefix(s, percent, known).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() if len(s) else None)
                bits.append(bitmaps([s], bits_of(size_class(len(s)))).tobytes() if len(s) else None)
            yield pa.record_batch([b.column("doc_id"), b.column("rk"), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (node, first, bits))], names=["doc_id", "rk", "n_shingles", "node", "first", "bits"])

    return run


def _keyed(percent: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = seeds(64, 29)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                keys, owner = [], []
                for k, (n, first) in enumerate(zip(part.column("n").to_pylist(), part.column("first").to_pylist(), strict=True)):
                    items = np.zeros((len(first) // 6, 8), np.uint8)
                    items[:, :6] = np.frombuffer(first, np.uint8).reshape(-1, 6)
                    items, level = items.view(_U).reshape(-1), size_class(n)
                    for c in (level, level - 1):
                        if c == level or c >= 0 and percent * n <= 100 * ((1 << level) - 1):  # the largest set of the class below is in reach
                            keys.append(mix(items ^ salt[c]) & ~_CLASS | _U(c))
                            owner.append(np.full(len(items), k))
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), part.column("node").take(pa.array(np.concatenate(owner)))], names=["grp", "node"])

    return run


def linked(docs: DataFrame, words: int = 4, percent: int = 85, cap: int = 256, set_cap: int = 256_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs(doc_id, text)``.

    Two documents link if 100 * |common| >= percent * |union| of their distinct shingles of ``words``
    words, A-Z lower-cased; component_id is the least doc_id that links reach, its own included.

    A text of fewer words is one shingle; a null or wordless one has an empty set and no link, and
    its component is its own doc_id.  Repeated rows and equal sets share a component and keep a row each; a null
    doc_id counts as greater than any other.  Other columns are ignored; an empty table gives an empty table.
    """
    slim = row_key(bounded_batches(docs).select("doc_id", "text"))
    known = frequent(slim.select("text"), words)
    full = materialise(slim.mapInArrow(_sketch(words, percent, known), "doc_id bigint, rk bigint, n_shingles bigint, node binary, first binary, bits binary"))
    some = full.where("node is not null").groupBy("node")
    nodes = materialise(some.agg(F.min("doc_id").alias("rep"), F.min("rk").alias("rk"), F.first("n_shingles").alias("n"), F.first("first").alias("first"), F.first("bits").alias("bits")))
    sketch = materialise(full.select("doc_id", "rk", "n_shingles", "node"))
    discard(full)
    keyed = nodes.select("n", "first", "node").mapInArrow(_keyed(percent), "grp bigint, node binary")
    # blocks with the same members are one
    blocks = keyed.groupBy("grp").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("c > 1")
    chosen = materialise(blocks.groupBy("c", "x", "y", F.expr("grp & 63").alias("level")).agg(F.min("grp").alias("grp")).select("grp"))
    met = keyed.join(_sent(chosen), "grp").distinct()
    size = F.unhex(F.lpad(F.hex("n"), 16, "0"))
    members = met.join(nodes.select("node", F.concat(size, "bits").alias("payload")), "node").select("grp", "node", F.lit(1).alias("weight"), "payload")
    groups = components(group_links(members, ByTree(percent), cap))
    wanted = materialise(groups.join(nodes, "node").select("node", F.xxhash64("root").alias("grp"), "rk", (F.col("n") + 1000).alias("weight")))
    texts = slim.join(_sent(wanted), "rk").select("grp", "node", "weight", F.col("text").alias("payload"))
    checked = texts.mapInArrow(_own_text(words), "grp bigint, node binary, weight bigint, payload binary").dropDuplicates(["grp", "node"])
    roots = components(group_links(checked, TreeOfSets(percent, words), set_cap))
    placed = nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = materialise(placed.groupBy("root").agg(F.min("rep").alias("component_id")))
    of = placed.join(least, "root").select("node", "component_id")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return sketch.join(of, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def linked_sql(words: int = 4, percent: int = 85) -> str:
    """``linked`` in DuckDB SQL: an inverted index of all shingles, and every document that links reach."""
    return f"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT rid, unnest(list_distinct(list_transform(range(1, greatest(len(w) - {words}, 0) + 2), lambda i: array_to_string(w[i : i + {words - 1}], ' ')))) AS s FROM docs WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT rid, count(*) AS n FROM sets GROUP BY rid),
common AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM sets a JOIN sets b USING (s) WHERE a.rid <> b.rid GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach(rid, other) AS (SELECT rid, rid FROM sizes UNION SELECT r.rid, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, CASE WHEN z.n IS NULL THEN d.doc_id ELSE least_id END AS component_id
FROM docs d LEFT JOIN sizes z USING (rid) LEFT JOIN (SELECT r.rid, min(o.doc_id) AS least_id FROM reach r JOIN docs o ON o.rid = r.other GROUP BY r.rid) USING (rid)"""
