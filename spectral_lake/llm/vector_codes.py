"""Product codes of vectors: codebooks by exact rounds of assignment, entries found by annular norm pruning.

Vectors become integers, floor(1024 * x), and are cut in parts of equal width; each part has a
codebook.  The nearest entry of a part is found among entries sorted by their norm: with a
best distance d at hand, the triangle inequality leaves only entries whose norm lies within d of
the part's own.  Binary search gives that interval, bounds included, and exactly its
entries are evaluated.

Each round is one pass over the input: tasks send a sum and a count for each component of
each entry, Spark adds them up, and only the new codebooks come to the driver.  These are as large
as ``parts * entries * width`` numbers, whatever the input's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, materialise

SCALE = 1024
#: Components saturate here, errors at the largest long: beyond any embedding, but finite floats go further.
FAR, LARGEST = 1 << 62, (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """``books[part][entry]`` is a tuple of integers; ``width`` is the vectors' length before padding."""

    books: tuple[tuple[tuple[int, ...], ...], ...]
    width: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for entry in book for v in entry).encode()).hexdigest()


def _exact(bound: int, width: int) -> bool:
    """Whether squared distances of components up to ``bound`` are whole numbers that a double holds."""
    return width * (2 * bound) ** 2 < 1 << 53


def integers(x: np.ndarray, width: int, parts: int) -> np.ndarray:
    """Rows of ``width`` floats as rows x parts x components, padded with zeros to equal parts."""
    scaled = np.floor(x.reshape(-1, width).astype(np.float64) * SCALE)
    out = np.clip(scaled, -float(FAR), float(FAR)).astype(np.int64)
    return np.pad(out, ((0, 0), (0, -width % parts))).reshape(len(out), parts, -(-width // parts))


class NormIndex:
    """A codebook's entries by ascending norm."""

    def __init__(self, book: tuple[tuple[int, ...], ...]) -> None:
        entries = np.array(book, np.int64).reshape(len(book), len(book[0]))
        self.bound = int(max(abs(int(entries.max(initial=0))), abs(int(entries.min(initial=0)))))
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        self.place = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.place], entries[self.place]

    def nearest(self, x: np.ndarray, rows: int = 512, near: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Place and squared distance of the nearest entry of each row of ``x``; ties to the lower place."""
        top = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), self.bound))
        kind = np.float64 if _exact(top, x.shape[1]) else object  # object: Python's integers, for vectors out of the ordinary
        x, entries = x.astype(kind), self.entries.astype(kind)
        own, size = (x * x).sum(axis=1), (entries * entries).sum(axis=1)
        norm = np.sqrt(own.astype(np.float64))
        best, dist = np.zeros(len(x), np.int64), np.zeros(len(x), kind if kind is object else np.int64)
        order = np.argsort(norm, kind="stable")
        for i in range(0, len(x), rows):
            at = order[i : i + rows]
            mid = np.searchsorted(self.norms, norm[at[len(at) // 2]])
            lo, hi = max(0, mid - near), min(len(entries), mid + near)
            first = (own[at, None] + size[lo:hi] - 2 * (x[at] @ entries[lo:hi].T)).min(axis=1)  # the best so far
            reach = np.sqrt(first.astype(np.float64)) * (1 + 1e-12) + (norm[at] + self.norms[-1]) * 1e-12  # rounding leaves no entry out
            left, right = np.searchsorted(self.norms, norm[at] - reach, "left"), np.searchsorted(self.norms, norm[at] + reach, "right")
            lo, hi = int(left.min()), int(right.max())
            d = own[at, None] + size[lo:hi] - 2 * (x[at] @ entries[lo:hi].T)
            column = np.arange(lo, hi)
            inside = (column >= left[:, None]) & (column < right[:, None])
            least = np.where(inside, d, d.max() + 1).min(axis=1)
            best[at] = np.where(inside & (d == least[:, None]), self.place[lo:hi], len(entries)).min(axis=1)
            dist[at] = least
        return best, dist


def _usable() -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.col("embedding").isNotNull() & ~F.exists("embedding", bad)


def _kept(vectors: DataFrame, width: int) -> DataFrame:
    return vectors.where(_usable() & (F.size("embedding") == width))


def _rows(b: pa.RecordBatch, width: int, parts: int) -> np.ndarray:
    flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False)
    return integers(flat, width, parts) if width else np.zeros((b.num_rows, parts, 0), np.int64)


def _sums(now: Codebooks) -> Callable:
    parts = len(now.books)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = [NormIndex(b) for b in now.books]
        k, w = len(now.books[0]), len(now.books[0][0])
        total, count = np.zeros((parts, k, w), object), np.zeros((parts, k), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _rows(b, now.width, parts)
            for p in range(parts):
                best, _ = index[p].nearest(x[:, p])
                order = np.argsort(best, kind="stable")
                found, at = np.unique(best[order], return_index=True)
                small = np.abs(x[:, p]).max(initial=0) < 1 << 40
                total[p, found] += np.add.reduceat(x[order, p].astype(np.int64 if small else object), at, axis=0).astype(object)
                count[p, found] += np.diff([*at, len(best)])
        used = np.repeat(count.reshape(-1) > 0, w)
        yield pa.record_batch(
            [pa.array(np.flatnonzero(used), pa.int64()), pa.array(np.repeat(count.reshape(-1), w)[used]), pa.array([Decimal(v) for v in total.reshape(-1)[used].tolist()], pa.decimal128(38, 0))], names=["at", "n", "total"]
        )

    return run


def _least(vectors: DataFrame, entries: int, few: int = 100_000) -> DataFrame:
    """Rows of which the ``entries`` least vec_ids are some, and not many more: an approximate quantile bounds them again and again.

    Each task of an ordered limit sends so many rows to the driver; these bounds leave few tasks with any.
    """
    found, n = vectors, vectors.count()
    while n > few:
        share = min(1.0, (entries + n / 5000) / n)  # the quantile may be off by n / 10000
        bound = found.agg(F.percentile_approx("vec_id", share, 10_000)).first()[0]
        nearer = found.where(F.col("vec_id") <= bound)
        m = nearer.count()
        if not entries <= m < n:
            break  # ids that are null or equal: the ordered limit alone decides
        found, n = nearer, m
    return found


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks | None:
    """Codebooks of ``vectors(vec_id, embedding)``; None if no vector is usable.

    Entries start as the parts of the ``entries`` vectors with the least vec_id (null last; of equal
    ids the lesser vector), fewer if there are fewer.  Each round assigns every part to its nearest
    entry and moves entries to the floor of their parts' mean; unused entries stay.

    A null vector, one with a null, infinite or not-a-number component, and one whose length is not
    that of the first usable vector are left out.  A length that ``parts`` does not divide is padded with zeros.
    Other columns are ignored.  The input is read once a round: write a costly one first.
    """
    vectors = bounded_batches(vectors).select("vec_id", "embedding")
    usable = vectors.where(_usable())
    first = usable.agg(F.min(F.struct(F.col("vec_id").isNull().alias("last"), "vec_id", "embedding")).alias("row")).first()["row"]
    if first is None:
        return None
    width = len(first["embedding"])
    start = _least(_kept(vectors, width), entries).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    x = integers(np.array([r["embedding"] for r in start], np.float64), width, parts) if width else np.zeros((len(start), parts, 0), np.int64)
    now = Codebooks(tuple(tuple(tuple(e) for e in x[:, p].tolist()) for p in range(parts)), width)
    for _ in range(rounds if width else 0):
        sums = _kept(vectors, width).select("embedding").mapInArrow(_sums(now), "at bigint, n bigint, total decimal(38,0)")
        new = np.array(now.books, object)
        flat = new.reshape(-1)
        for r in sums.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # one row a component of a codebook
            flat[r["at"]] = int(r["total"]) // r["n"]
        now = Codebooks(tuple(tuple(tuple(e) for e in book) for book in new.tolist()), width)
    return now


def _coded(now: Codebooks) -> Callable:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = [NormIndex(b) for b in now.books]
        digits = np.array([f"{i:02x}" for i in range(max(256, len(now.books[0])))])
        for b in batches:
            x = _rows(b, now.width, len(index))
            code, error = np.full(len(x), ""), np.zeros(len(x), object)
            for p, found in enumerate(index):
                best, dist = found.nearest(x[:, p])
                code, error = np.char.add(code, digits[best]), error + dist.astype(object)
            yield pa.record_batch([b.column("vec_id"), b.column("label"), pa.array(code.tolist(), pa.string()), pa.array([min(e, LARGEST) for e in error.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def encode(vectors: DataFrame, books: Codebooks | None) -> DataFrame:
    """(vec_id, label, code, error) of each usable row of ``vectors(vec_id, embedding, label)``.

    code has two hex digits a part; error is the squared distance to the coded vector, at most the
    largest long.  Repeated rows keep one row each; vectors left out in ``train`` are left out here;
    without codebooks there is no row.
    """
    vectors = bounded_batches(vectors).select("vec_id", "embedding", "label")
    kinds = dict(vectors.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    return _kept(vectors, books.width).mapInArrow(_coded(books), schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors summed over equal labels, nulls together; at most the largest long."""
    coded = materialise(coded)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(LARGEST))).cast("bigint")
    sums = materialise(coded.groupBy(F.col("label").alias("same")).agg(total.alias("label_error")))  # written, so that the join can split a frequent label
    return coded.join(sums, F.col("label").eqNullSafe(F.col("same"))).drop("same")


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``coded`` with ``decoded``, the integer components of the entries that its code names."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(v) for v in e]) for e in book]) for book in books.books])
    pieces = [F.get(F.get(entries, F.lit(p)), F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")) for p in range(len(books.books))]
    return coded.withColumn("decoded", F.slice(F.concat(*pieces), 1, max(1, books.width)))


def codes_sql(table: str = "embeddings", parts: int = 4, entries: int = 256, rounds: int = 4, width: int = 64) -> str:
    """The whole of ``train``, ``encode`` and ``with_label_error`` as DuckDB SQL, for vectors of one width that ``parts`` divides."""
    w = width // parts
    assign = (  # squared distances of whole numbers, exact in doubles
        "SELECT id, part, min_by(entry, d * 1024 + entry) AS entry, min(d) AS d FROM (SELECT v.id, v.part, b.entry, list_dot_product(v.x, v.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(v.x, b.x) AS d FROM pieces v JOIN {book} b USING (part)) GROUP BY id, part"
    )
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM {table} WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"pieces AS MATERIALIZED (SELECT id, part, list_slice(v, part * {w} + 1, part * {w} + {w}) AS x FROM kept, range({parts}) t(part))",
        f"book0 AS MATERIALIZED (SELECT part, id AS entry, x FROM pieces WHERE id < {entries})",
    ]
    for i in range(rounds):
        steps.append(f"found{i} AS MATERIALIZED ({assign.format(book=f'book{i}')})")
        means = f"SELECT part, entry, list(m ORDER BY k) AS x FROM (SELECT f.part, f.entry, k, floor(sum(p.x[k]) / count(*)) AS m FROM found{i} f JOIN pieces p USING (id, part), range(1, {w + 1}) t(k) GROUP BY f.part, f.entry, k) GROUP BY part, entry"
        steps.append(f"book{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN ({means}) m USING (part, entry))")
    steps.append(f"last AS MATERIALIZED ({assign.format(book=f'book{rounds}')})")
    steps.append("coded AS MATERIALIZED (SELECT vec_id, label, code, error FROM kept JOIN (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last GROUP BY id) USING (id))")
    digest = f"(SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: c::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) FROM book{rounds})"
    return "WITH " + ", ".join(steps) + f" SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, {digest} AS codebooks_sha256 FROM coded"
