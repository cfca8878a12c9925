"""Byte-level BPE over a global distinct-word shuffle.

Texts are cut in pre-tokens.  A chunk of texts keeps its sequence of local word numbers, the
positions, so that each distinct word leaves it once.  Words are dealt by digest over buckets and
travel packed, one row a chunk and bucket; all chunks' words of a bucket meet in one task, which
encodes each distinct word once and sends its ids back to the chunks.  There the sequence puts
them in place.  Decoding joins the table of token bytes, which is as large as the vocabulary
and so is broadcast.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, lean, materialise_by, trim

#: Characters of text in one chunk: bounds what a task holds at once.
CHUNK = 8_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    return load_ranks(path)


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: the pair of neighbours of least rank is merged, leftmost first, until none has a rank.

    Pairs wait in a heap and pieces are chained, so that a pre-token of any length takes n log n.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # where the piece that starts here ends; 0 once it is part of another
    before = list(range(-1, n - 1))
    waiting = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(waiting)
    while waiting:
        _, i, stop = heappop(waiting)
        middle = end[i]
        if not middle or middle >= stop or end[middle] != stop:
            continue  # one of the two has been merged meanwhile
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heappush(waiting, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heappush(waiting, (r, p, stop))
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


PART = "chunk bigint, bucket int, words binary, rest binary, lengths binary, seq binary, dealt binary"


def _pack(values: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed: small ones are mostly zeros."""
    import zstandard

    return zstandard.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpack(packed: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)


def _pack_words(words: list[bytes]) -> bytes:
    import zstandard

    sizes = np.array([len(words), *map(len, words)], "<u4").tobytes()
    return zstandard.compress(sizes + b"".join(words), 3)


def _unpack_words(packed: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1]], ends, strict=True)] if n else []


def _ipc(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _chunks(pattern: str, buckets: int):
    """Rows of two kinds: a chunk (other columns of its texts, tokens per text, word numbers, bucket of each word), and its words of a bucket."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, done = regex.compile(pattern).findall, 0
        part = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            raw = [w.encode() for w in number]
            dealt = np.fromiter((crc32(w) % buckets for w in raw), np.uint16, len(raw))
            order = np.argsort(dealt, kind="stable").tolist()
            used, starts = np.unique(dealt[order], return_index=True)
            ends = [*starts.tolist()[1:], len(order)]
            packed = [_pack_words([raw[i] for i in order[x:y]]) for x, y in zip(starts.tolist(), ends, strict=True)] if raw else []
            n = len(packed)
            return pa.record_batch(
                [
                    pa.array([part + done] * (n + 1), pa.int64()),
                    pa.array([None, *used.tolist()], pa.int32()),
                    pa.array([None, *packed], pa.binary()),
                    pa.array([_ipc(rest)] + [None] * n, pa.binary()),
                    pa.array([np.array(lengths, np.int64).tobytes()] + [None] * n, pa.binary()),
                    pa.array([_pack(np.concatenate(seq))] + [None] * n, pa.binary()),
                    pa.array([_pack(dealt)] + [None] * n, pa.binary()),
                ],
                names=["chunk", "bucket", "words", "rest", "lengths", "seq", "dealt"],
            )

        number: dict[str, int] = {}
        rest, lengths, seq, size = [], [], [], 0
        for b in batches:
            others, first = b.drop_columns(["text"]), 0
            for at, text in enumerate(as_bytes(b.column("text"))):
                text = (text or b"").decode()
                if lengths and size + len(text) > CHUNK:
                    rest.append(others.slice(first, at - first))
                    first = at
                    yield flush()
                    number, rest, lengths, seq, size, done = {}, [], [], [], 0, done + 1
                words = find(text)
                seq.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words)))
                lengths.append(len(words))
                size += len(text)
            rest.append(others.slice(first))
        if lengths:
            yield flush()

    return run


def _encode_words(path: str):
    """The ids of each chunk's words, for rows in bucket order; a bucket's distinct words are encoded once."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(path)
        bucket, known = None, {}
        for b in batches:
            counts, ids = [], []
            for k, packed in zip(b.column("bucket").to_pylist(), b.column("words").to_pylist(), strict=True):
                if k != bucket:
                    bucket, known = k, {}
                own = []
                for w in _unpack_words(packed):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = merge_word(w, ranks)
                    own.append(got)
                counts.append(_pack(np.fromiter(map(len, own), np.uint32, len(own))))
                ids.append(_pack(np.fromiter(chain.from_iterable(own), np.uint32)))
            yield pa.record_batch([b.column("chunk"), b.column("bucket"), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], names=["of", "bucket", "counts", "ids"])

    return run


def _assemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """One chunk: its words' ids put in the place of its word numbers."""
    (chunk,) = left.to_pylist()
    with pa.ipc.open_stream(chunk["rest"]) as f:
        rest = f.read_all()
    back = sorted(right.to_pylist(), key=lambda r: r["bucket"])
    empty = np.empty(0, np.uint32)
    flat = np.concatenate([empty, *(_unpack(r["ids"]) for r in back)])
    dealt = _unpack(chunk["dealt"])
    size = np.empty(len(dealt), np.int64)
    order = np.argsort(dealt, kind="stable")
    size[order] = np.concatenate([empty, *(_unpack(r["counts"]) for r in back)])
    start = np.empty(len(dealt), np.int64)
    start[order] = np.cumsum(size[order]) - size[order]
    seq, end, out = _unpack(chunk["seq"]), 0, []
    for n in np.frombuffer(chunk["lengths"], np.int64).tolist():
        s = seq[end : end + n]
        end += n
        count = size[s]
        at = np.repeat(start[s] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        out.append(flat[at].astype("<u4").tobytes())
    del seq, flat, back
    trim()
    return rest.append_column("ids", pa.array(out, pa.binary()))


def _decode(table):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, start, size = table.value
        for b in batches:
            texts = []
            for x in as_bytes(b.column("ids")):
                ids = np.frombuffer(x or b"", "<u4")
                count = size[ids]
                at = np.repeat(start[ids] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                texts.append(flat[at].tobytes())
            yield pa.record_batch([*b.columns, pa.array(texts, pa.binary())], names=[*b.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``docs(text, ...)`` with ``ids``, the tokens as little-endian unsigned 32-bit integers, in place of text.

    ``ranks`` is a path that every executor can read.  Null and empty texts have no ids; rows,
    repeated ones included, each stay.  A text of any length is one text of its chunk.  An empty
    table gives an empty table.  A column ids of the input is replaced; other names may be any.
    """
    rest = [f for f in bounded_batches(docs).schema if f.name not in ("text", "ids")]
    names = [f"`{f.name}`" for f in rest]
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialise_by(docs.select(*names, F.col("text")).mapInArrow(_chunks(pattern, min(60_000, 2 * shuffled)), PART), "chunk", shuffled)
    words = parts.where("bucket is not null").select("chunk", "bucket", "words")
    back = words.repartition(shuffled, "bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(ranks), "of bigint, bucket int, counts binary, ids binary")
    chunks = parts.where("seq is not null").select("chunk", "rest", "lengths", "seq", "dealt")
    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rest, strict=True)] + ["ids binary"])
    return chunks.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_assemble, schema)


def decode(docs: DataFrame, ranks: str) -> DataFrame:
    """``docs(ids, ...)`` with the bytes of its ids as ``decoded``; null ids give none."""
    table = load_ranks(ranks)
    pieces = [b""] * (max(table.values()) + 1)
    for piece, i in table.items():
        pieces[i] = piece
    size = np.array([len(p) for p in pieces], np.int64)
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast((flat, np.cumsum(size) - size, size))
    docs = docs.drop("decoded")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["decoded binary"])
    return docs.mapInArrow(_decode(shared), schema)
