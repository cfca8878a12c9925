"""Fingerprints under edit distance: a shared random walk, bit sampling, banding and verification.

Embedding.  All texts walk over their characters by the same random rule: at step t the walk writes
the symbol it stands on, and moves on or stays by a coin that depends on t and what it reads (three
characters).  Two texts at edit distance d fall back in step after O(d * d) expected steps, so that
edit distance becomes Hamming distance of what they write.  A text of n characters takes 2n steps.

Bit sampling.  A fingerprint has ``SLOTS`` places of four bits: what the walk writes at sampled
steps.  Each place draws its step among the 2n by a consistent rule: as n grows, a record process
replaces the step now and then, so that two lengths share a place's step with the probability
shorter / longer, whatever the lengths.  Likeness is the share of equal places, corrected for
chance: one less the sampled Hamming distance.

Banding.  ``near_classes`` groups fingerprints that agree in a whole band of places and verifies the
likeness of those that meet, all of them, as a spanning forest of each bucket's links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, components, lean, materialise, mix, seeds
from .minhash import BySignature, group_links

_U = np.uint64
SLOTS, PERIOD, RUN = 128, 251, 4096
#: Coins: a row for each step, repeating; the last symbol, past a text's end, never moves.
_COINS = (mix(seeds(PERIOD, 23)[:, None] + np.arange(256, dtype=_U) * _U(0x9E3779B97F4A7C15)) >> _U(63)).astype(np.uint8)
_COINS[:, 255] = 0
_ROWS = [row.tobytes() for row in np.tile(_COINS, (-(-RUN // PERIOD) + 1, 1))]


def _records() -> np.ndarray:
    """The steps that each place draws as texts grow: after step t, a new one at floor(t / u) with u uniform in (0, 1)."""
    out = np.full((SLOTS, 80), np.iinfo(np.int64).max)
    for slot, row in enumerate(out):
        at = 1
        for k, u in enumerate(((seeds(79, 1000 + slot) >> _U(11)).astype(float) + 1) / (1 << 53)):
            row[k] = at - 1
            at = int(at / u) + 1
            if at > 1 << 50:
                break
    return out


_STEPS = _records()


def steps_of(n: int) -> np.ndarray:
    """The sampled step of each place for a text of ``n`` characters."""
    return _STEPS[np.arange(SLOTS), (_STEPS < max(1, 2 * n)).sum(axis=1) - 1]


def read(text: str) -> tuple[bytes, bytes]:
    """What each place of a text reads: a symbol of 0 to 254 for the coins, one of four bits to be written; one more past the end."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
    c = np.r_[c, _U(0), _U(0)]
    a = seeds(3, 37) | _U(1)
    h = mix(c[:-2] * a[0] + c[1:-1] * a[1] + c[2:] * a[2])
    return ((h >> _U(8)) % _U(255)).astype(np.uint8).tobytes() + b"\xff", (h & _U(15)).astype(np.uint8).tobytes() + b"\0"


def walk(symbols: bytes, stops: list[int], t: int = 0, at: int = 0) -> list[int]:
    """Where the walk stands at the steps ``stops``, ascending, having stood at ``at`` at step ``t``."""
    out = []
    for stop in stops:
        while t < stop:
            phase, run = t % PERIOD, min(RUN, stop - t)
            for row in _ROWS[phase : phase + run]:
                at += row[symbols[at]]
            t += run
        out.append(at)
    return out


class Walked:
    """A text's walk, at its own sampled steps and, if told, at those of an edited text's length."""

    def __init__(self, text: str, other: int | None = None) -> None:
        self.coins, self.written = read(text)
        self.steps = steps_of(len(text))
        self.stops = np.unique(self.steps if other is None else np.r_[self.steps, steps_of(other)])
        self.places = np.array(walk(self.coins, self.stops.tolist()), np.int64)

    def print(self) -> np.ndarray:
        return np.frombuffer(self.written, np.uint8)[self.places[np.searchsorted(self.stops, self.steps)]]

    def edited(self, text: str, keep: int) -> np.ndarray:
        """The fingerprint of ``text``, which begins with the same ``keep`` characters: the walk goes on where that ends."""
        same = max(0, keep - 2)  # three characters are read at a time
        coins, written = read(text[same:])
        coins, written = self.coins[:same] + coins, self.written[:same] + written
        steps = steps_of(len(text))
        stops = np.unique(steps)
        known = self.places[np.searchsorted(self.stops, stops)]
        sure = int((known < same).sum())  # so far only what is the same has been read
        at = known[:sure].tolist()
        rest = walk(coins, stops[sure:].tolist(), int(stops[sure - 1]), at[-1]) if sure else walk(coins, stops.tolist())
        return np.frombuffer(written, np.uint8)[np.array(at + rest, np.int64)[np.searchsorted(stops, steps)]]


def fingerprint(text: str) -> np.ndarray:
    """SLOTS values of four bits; an empty text has all zero."""
    return Walked(text).print()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(max(0.0, ((a == b).mean() - 1 / 16) * 16 / 15))


def as_text(values: np.ndarray) -> str:
    return "".join(map("0123456789abcdef".__getitem__, values.tolist()))


def _compress(splits: np.ndarray):
    """Rows with their bucket of the doc_id order, texts compressed; a bucket's first row also closes the one before it."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            packed = [squeeze(t or b"") for t in as_bytes(b.column("text"))]
            # null ids come after all others, in the last bucket
            bucket = [len(splits) if i is None else int(np.searchsorted(splits, i, side="right")) for i in ids]
            known = splits.tolist()
            first = set(known)
            again = [(j, known.index(i)) for j, i in enumerate(ids) if i in first and len(known)]
            again = [(j, (k if k else len(splits))) for j, k in again]
            if not known:  # without any doc_id the rows are one bucket, whose least text closes it
                again = [(j, 0) for j in sorted(range(len(ids)), key=packed.__getitem__)[:1]]
            yield pa.record_batch(
                [
                    pa.array([*bucket, *(k for _, k in again)], pa.int32()),
                    pa.array([False] * len(ids) + [True] * len(again)),
                    pa.array([*ids, *(ids[j] for j, _ in again)], pa.int64()),
                    pa.array([*packed, *(packed[j] for j, _ in again)], pa.binary()),
                ],
                names=["bucket", "tail", "doc_id", "packed"],
            )

    return run


ROWS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(step: int):
    """For rows in doc_id order: the fingerprint of each text, of its edited text, and their likeness."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        grow = zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []  # (bucket, tail, doc_id, text)
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            out, prints = [], {}
            for k, (now, after) in enumerate(zip(rows, [*rows[1:], None], strict=True)):
                if now[1] or after is None or after[0] != now[0]:
                    continue
                text, cut = now[3], len(now[3]) // 4
                edited = text[: len(text) - cut] + after[3][:cut] if cut else text
                walked = Walked(text, len(edited))
                prints[k] = walked.print()
                out.append([now[2], len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[k], walked.edited(edited, len(text) - cut), k + 1])
            for x in out:
                a, b, k = x[3:]
                c = prints[k] if k in prints else prints.setdefault(k, fingerprint(rows[k][3]))
                x[3:] = [as_text(a), as_text(b), likeness(a, b), likeness(a, c)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in ROWS.split(", ")])

        for b in batches:
            for bucket, tail, doc, packed in zip(*(b.column(k).to_pylist() for k in ("bucket", "tail", "doc_id", "packed")), strict=True):
                if held and held[-1][1] and held[-1][0] == bucket:
                    continue  # one closing row is enough
                held.append((bucket, tail, doc, grow(packed).decode()))
                size += len(held[-1][3])
                if size > step:
                    yield flush(held)
                    held = held[-1:]
                    size = len(held[0][3])
        if held:
            yield flush(held)

    return run


def edited_fingerprints(docs: DataFrame, buckets: int | None = None, step: int = 1_000_000) -> DataFrame:
    """Fingerprints of each text and of its edited text, by ascending doc_id.

    The edited text replaces the last floor(n/4) characters by the first as many of the next
    document; after the last comes the first.  Null texts are empty; rows with equal ids follow
    each other in any order and null ids come last.  A text of any length is walked once.  An empty
    table gives an empty table; other columns of the input are left out, whatever their names.
    Documents are dealt by sampled doc_ids that exist, so that a bucket's first row is known and can
    close the bucket before it; each bucket is a partition.
    """
    spark = docs.sparkSession
    parts = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = bounded_batches(docs).select("doc_id")
    cut = ids.agg(F.min("doc_id").alias("a"), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q")).first()
    splits = np.unique(np.array([x for x in [cut["a"], *(cut["q"] or [])] if x is not None], np.int64))
    rows = docs.select("doc_id", "text").mapInArrow(_compress(splits), "bucket int, tail boolean, doc_id bigint, packed binary")
    dealt = rows.repartitionById(len(splits) + 1, F.col("bucket")).sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_last(), "packed")
    return dealt.mapInArrow(_edited(step), ROWS)


#: Places of the bands: 16 of neighbours, 8 of places that lie 16 apart, 8 places each.
BANDS = [[8 * b + k for k in range(8)] for b in range(16)] + [[16 * k + 2 * b for k in range(8)] for b in range(8)]


def near_classes(prints: DataFrame, least: float = 0.8, cap: int = 256) -> DataFrame:
    """(fingerprint, near_class) from ``prints(doc_id, fingerprint)``: the least doc_id reachable over links of likeness ``least`` or more.

    A pair at likeness 0.8 shares none of the ``BANDS`` with a probability of 0.6 %, one at 0.9 with
    less than 1e-5.  Whoever meets in a band is verified on the whole fingerprint.  Equal
    fingerprints are one; null doc_ids count as greater than any other.  An empty table gives an
    empty table.
    """
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn("id", F.xxhash64("fingerprint")))
    places = lambda band: F.concat(*[F.substring("fingerprint", p + 1, 1) for p in band])
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("fingerprint", band[0] + 1, 8) if band[1] == band[0] + 1 else places(band)) for b, band in enumerate(BANDS)])
    keyed = nodes.select(F.explode(bands).alias("grp"), "id")
    buckets = keyed.groupBy("grp").agg(F.count("*").alias("c"), F.bit_xor("id").alias("x"), F.bit_xor(F.xxhash64("id")).alias("y")).where("c > 1")
    chosen = buckets.groupBy("c", "x", "y").agg(F.min("grp").alias("grp")).select("grp")  # buckets with the same members are one
    code = F.col("fingerprint").cast("binary")
    members = keyed.join(chosen, "grp", "left_semi").join(nodes, "id").select("grp", code.alias("node"), F.lit(1).alias("weight"), code.alias("payload"))
    most = int(SLOTS * (1 - least) * 15 / 16)
    roots = components(group_links(members, BySignature(most, np.uint8), cap))
    placed = nodes.join(roots.select(F.col("node").cast("string").alias("fingerprint"), "root"), "fingerprint", "left").withColumn("root", F.coalesce("root", code))
    classes = materialise(placed.groupBy("root").agg(F.min("least").alias("near_class")))  # written, so that the join can split a large class
    return placed.join(classes, "root").select("fingerprint", "near_class")
