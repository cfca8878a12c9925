"""Main text of web pages: what a host repeats across distinct pages is removed, the unique runs stay.

A page becomes blocks of words.  Those of its ``article`` or ``main`` are the story and stay whole: many
a story quotes a line that other pages of the host have, and must not lose it.  All else, on a page without either
element everything, is the host's token stream.  Each position with ``least`` words to follow on the page is a suffix; a
host's suffixes are sorted by their words, and neighbours of two distinct pages whose common prefix has
``least`` words are a repeat.  Longer repeats are unions of such, so that no more of a suffix is needed.  Covered words
are boilerplate, the runs between them stay.  Pages with equal words are one page.

Menus, forms and the like are left out by element, role or class too (``lists``).

Only suffixes that may repeat are sorted.  Pages are parsed once and kept in chunks; each distinct
suffix of a chunk's outside goes out as 24 bits of its digest, and those that are met twice in
their bucket go out again, as the words' own digests, 32 bits each, with the page they are from.
A bucket of the second round is the suffix array's stretch: sorted by host and words and compared from neighbour to neighbour.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, bounded_batches, lean, materialise_by, mix, seeds, trim

_U = np.uint64
CHUNK = 8_000_000

#: Element names and words of class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg canvas object select title math video audio xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br td th".split())
CHROME = frozenset("nav header footer aside form button menu dialog fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup sidebar comment comments respond disqus breadcrumb breadcrumbs menu nav navbar navigation masthead topbar footer header "
    "share sharing social related widget toolbar pagination pager".split()
)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPLIT_WORDS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _hidden(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element is left out; ``inside`` an article its header stays."""
    if name in CHROME and not (name == "header" and inside):
        return True
    if not attrs or name in ("html", "body"):
        return False
    for key, value in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id") and name not in INLINE:
            parts = set(SPLIT_WORDS.split(value.lower()))
            if inside or name in ("main", "article"):
                parts -= {"header", "share", "related", "notice", "subscription"} if name in ("main", "article") else {"header"}
            if parts & WORDS and not (name == "main"):
                return True
    return False


def blocks(page: str, lists: bool = True) -> list[tuple[str, int]]:
    """(text, flags) of each block of a page, in order: 1 in an article, 2 left out.

    Without ``lists``, only raw elements are left out.  Time is linear in the page: open elements are found by name,
    and an end without its begin costs nothing.
    """
    out: list[tuple[str, int]] = []
    words: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, in an article, left out
    place: dict[str, list[int]] = {}  # where elements of a name stand in it
    main = hidden = False
    at, size, last = 0, len(page), page.rfind(">")

    def close() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text:
            out.append((text, main + 2 * hidden))

    while at < size:
        if at > last:  # no tag ends any more
            words.append(page[at:].partition("<!--")[0])
            break
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                words.append(m[0])
            continue
        name, shut, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if not shut and name in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            words.append(" ")
            continue
        if name in INLINE:
            if name in ("br", "td", "th"):
                words.append(" ")
        else:
            close()
        if name in VOID:
            continue
        if shut:
            if place.get(name):
                i = place[name][-1]
                if not (name in INLINE and stack[i][1:] != (main, hidden)):  # an inline end does not close blocks
                    _, main, hidden = stack[i]
                    for gone, _, _ in stack[i:]:
                        place[gone].pop()
                    del stack[i:]
        elif not attrs.endswith("/"):
            hide = lists and _hidden(name, attrs, main)
            if hide and not hidden and words:
                close()
            place.setdefault(name, []).append(len(stack))
            stack.append((name, main, hidden))
            main = main or (name in ("article", "main") and not (hidden or hide))
            hidden = hidden or hide
    close()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", (url or "").strip().lower())
    return re.sub(r"^(?:www|m)\.", "", m[1]) if m else ""


class Streams:
    """The blocks of many pages as one token stream."""

    def __init__(self, hosts: list[str], pages: list[list[tuple[str, int]]]) -> None:
        self.counts = np.array([len(p) for p in pages], np.int64)
        self.flags = np.array([flags for p in pages for _, flags in p], np.uint8)
        self.hosts = Rolling.digests([h.encode("utf-8", "surrogatepass") for h in hosts])
        self.raw = "\n".join(t for p in pages for t, _ in p).encode("utf-8", "surrogatepass")

    def pack(self) -> bytes:
        return _squeeze(np.array([len(self.counts), len(self.flags)], "<i8").tobytes() + self.counts.astype("<i8").tobytes() + self.hosts.astype("<u8").tobytes() + self.flags.tobytes() + self.raw)

    @classmethod
    def unpack(cls, packed: bytes) -> Streams:
        raw, self = _grow(packed), cls.__new__(cls)
        pages, blocks = np.frombuffer(raw, "<i8", 2).tolist()
        self.counts, self.hosts = np.frombuffer(raw, "<i8", pages, 16), np.frombuffer(raw, "<u8", pages, 16 + 8 * pages).astype(_U)
        self.flags, self.raw = np.frombuffer(raw, np.uint8, blocks, 16 + 16 * pages), raw[16 + 16 * pages + blocks :]
        return self

    def read(self, least: int) -> Streams:
        """Place words, and lay out the suffixes of what is no story."""
        buf = np.frombuffer(self.raw, np.uint8)
        gaps = np.flatnonzero((buf == 32) | (buf == 10)) if len(buf) else np.empty(0, np.int64)
        lo, hi = (np.r_[0, gaps + 1], np.r_[gaps, len(buf)]) if len(self.flags) else (gaps, gaps)
        rolling = Rolling(buf)
        self.words = rolling.of(lo, hi)
        self.block = np.r_[0, np.cumsum(buf[gaps] == 10)] if len(self.flags) else np.empty(0, np.int64)
        self.first = np.searchsorted(self.block, np.arange(len(self.flags) + 1))  # a block's first word
        self.of_block = np.repeat(np.arange(len(self.counts)), self.counts)
        page = self.of_block[self.block]
        # a page is its words, wherever they stand: a digest of all of them and the host
        weight = mix(self.words + seeds(1, 91)[0] * np.arange(1, len(page) + 1, dtype=_U)[np.arange(len(page)) - np.searchsorted(page, page)]) if len(page) else self.words
        sums = np.r_[_U(0), np.cumsum(weight, dtype=_U)]
        ends = np.searchsorted(page, np.arange(len(self.counts) + 1))
        self.owner = mix(sums[ends[1:]] - sums[ends[:-1]] + self.hosts + np.diff(ends).astype(_U))
        other = ((self.flags & 3) != 1)[self.block] if len(self.block) else np.empty(0, bool)
        self.suffixes = Suffixes(self, page, np.flatnonzero(other), least)
        return self

    def suspects(self, code: np.ndarray, buckets: int) -> dict:
        """Suffixes whose first round's code is in ``code``."""
        keys = self.suffixes.keys
        return self.suffixes.rows(_among((keys & _U(0xFFFFFF)) + (_bucket(keys, buckets) << _U(24)), code))

    def texts(self, repeated: np.ndarray, least: int) -> list[str]:
        """The main text of each page, given the digests of repeats."""
        covered = self.suffixes.covered(_among(self.suffixes.keys, repeated), least)
        touched = np.zeros(len(self.flags) + 1, bool)
        touched[self.block[covered]] = True
        out: list[list[str]] = [[] for _ in self.counts]
        blocks = self.raw.split(b"\n") if len(self.flags) else []
        for i, p in enumerate(self.of_block.tolist()):
            if self.flags[i] & 2:
                continue
            text = blocks[i].decode("utf-8", "surrogatepass")
            if touched[i]:
                text = unique_words(text, covered[self.first[i] : self.first[i + 1]], least)
            if text:
                out[p].append(text)
        return ["\n\n".join(x) for x in out]


class Suffixes:
    """Positions ``at`` of a stream with ``least`` words to follow on their page, the digests ``keys`` of host and these words, and their ``page``."""

    def __init__(self, streams: Streams, page: np.ndarray, places: np.ndarray, least: int) -> None:
        self.places, self.size, self.streams, self.least = places, len(page), streams, least
        own, words = page[places], streams.words[places]
        n = max(0, len(places) - least + 1)
        self.at = np.flatnonzero(own[:n] == own[least - 1 : n + least - 1])
        self.page = own[self.at]
        keys, weights = streams.hosts[self.page], seeds(least, 43) | _U(1)
        for k in range(least):
            keys = mix(keys + words[self.at + k] * weights[k])
        self.keys = keys

    def rows(self, pick: np.ndarray) -> dict:
        """Distinct suffixes of those picked: digest, host and words, and the page, or 0 if two pages of the chunk have one."""
        at = np.flatnonzero(pick)
        k, w = self.keys[at], self.streams.owner[self.page[at]] & _U(0xFFFFFFFF) | _U(1)
        order = np.lexsort((w, k))
        k, w, at = k[order], w[order], at[order]
        first = np.r_[True, k[1:] != k[:-1]][: len(k)]
        edge = np.flatnonzero(first)
        one = w[edge] == w[np.r_[edge[1:], len(k)] - 1] if len(k) else w
        words = self.streams.words[self.places[self.at[at[edge]][:, None] + np.arange(self.least)]]
        return {"keys": k[edge], "owners": np.where(one, w[edge], _U(0)), "hosts": self.streams.hosts[self.page[at[edge]]], "words": (words & _U(0xFFFFFFFF)).astype(np.uint32)}

    def covered(self, hit: np.ndarray, least: int) -> np.ndarray:
        """Words of all streams that a suffix in ``hit`` begins with."""
        step = np.zeros(len(self.places) + 1, np.int64)
        np.add.at(step, self.at[hit], 1)
        np.add.at(step, self.at[hit] + least, -1)
        out = np.zeros(self.size, bool)
        out[self.places] = np.cumsum(step)[:-1] > 0
        return out


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def unique_words(text: str, covered: np.ndarray, least: int) -> str:
    """Words of a block outside its covered runs; a run counts if it is the whole block or has ``least`` words."""
    edge = np.flatnonzero(np.diff(np.r_[False, covered, False]))
    gone = np.zeros(len(covered), bool)
    for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        gone[lo:hi] = hi - lo >= min(least, len(covered))
    return " ".join(w for w, g in zip(text.split(" "), gone.tolist(), strict=True) if not g)


def _squeeze(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def _grow(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def _ipc(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as f:
        for b in batches:
            f.write_batch(b)
    return _squeeze(sink.getvalue().to_pybytes())


def _planes(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each value, compressed place by place."""
    return _squeeze(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes())


def _values(packed: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(_grow(packed), np.uint8).reshape(size, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :size] = raw.T
    return out.reshape(-1).view("<u8").astype(_U)


#: A chunk of pages: the input's columns besides html, and the streams of its pages.
PART = "chunk bigint, rest binary, own binary"


def _chunks(lists: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, rest, hosts, found, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array([at], pa.int64()), pa.array([_ipc(rest)], pa.binary()), pa.array([Streams(hosts, found).pack()], pa.binary())], names=["chunk", "rest", "own"])

        for b in batches:
            rest.append(pa.RecordBatch.from_arrays(b.columns[:-2], names=b.schema.names[:-2]))
            hosts += map(host_of, b.column(b.num_columns - 2).to_pylist())
            for page in b.column(b.num_columns - 1).to_pylist():
                found.append(blocks(page or "", lists))
                size += sum(len(t) for t, _ in found[-1])
            if size > CHUNK:
                yield flush()
                at, rest, hosts, found, size = at + 1, [], [], [], 0
        if rest:
            yield flush()

    return run


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> _U(32)) % _U(buckets)


#: What chunks and buckets tell each other: digests, and in the second round hosts, words and pages.
ASKED = "chunk bigint, bucket int, digests binary, hosts binary, words binary, owners binary"
_NAMES = ("chunk", "bucket", "digests", "hosts", "words", "owners")


def _asked(rows: list[tuple]) -> dict:
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
    return {name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(zip(_NAMES, kinds, strict=True))}


def _by_bucket(bucket: np.ndarray, order: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=_U))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        yield k, order[ends[k] : ends[k + 1]]


def _first(least: int, buckets: int):
    """24 bits of each distinct suffix's digest, by bucket; of one that two pages of the chunk have, twice."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, own in zip(b.column("chunk").to_pylist(), b.column("own").to_pylist(), strict=True):
                every = Streams.unpack(own).read(least).suffixes
                found = every.rows(np.ones(len(every.keys), bool))
                keys = np.r_[found["keys"], found["keys"][found["owners"] == 0]]
                bucket, low = _bucket(keys, buckets), keys & _U(0xFFFFFF)
                rows = [(chunk, k, _planes(low[at], 3), None, None, None) for k, at in _by_bucket(bucket, np.lexsort((low, bucket)), buckets)]
                yield pa.record_batch(_asked(rows))

    return run


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one bucket after another."""
    held: list[tuple] = []
    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in _NAMES), strict=True):
            if held and held[0][1] != r[1]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


@lean
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk's short digests those that are met twice in their bucket."""
    for rows in _runs_of(batches):
        own = [_values(r[2], 3) for r in rows]
        values, counts = np.unique(np.concatenate(own), return_counts=True)
        twice = values[counts > 1]
        hits = [np.unique(keys[_among(keys, twice)]) for keys in own]
        yield pa.record_batch(_asked([(r[0], r[1], _planes(hit, 3), None, None, None) for r, hit in zip(rows, hits, strict=True) if len(hit)]))


def _second(least: int, buckets: int):
    """Host, words and page of the suffixes that the first round has met twice."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        code = np.sort(np.concatenate([np.empty(0, _U), *(_values(r["digests"], 3) + (_U(r["bucket"]) << _U(24)) for r in right.to_pylist())]))
        for part in left.to_pylist():
            found = Streams.unpack(part["own"]).read(least).suspects(code, buckets)
            bucket = _bucket(found["keys"], buckets)
            for k, at in _by_bucket(bucket, np.lexsort((found["keys"], bucket)), buckets):
                rows.append((part["chunk"], k, found["keys"][at].tobytes(), _squeeze(found["hosts"][at].tobytes()), _squeeze(found["words"][at].tobytes()), _planes(found["owners"][at], 4)))
        trim()
        return pa.table(_asked(rows))

    return run


def repeats(hosts: np.ndarray, words: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Which suffixes two distinct pages share, by sorting them and comparing neighbours; owner 0 stands for two pages."""
    order = np.lexsort((owners, *words.T[::-1], hosts))
    hosts, words, owners = hosts[order], words[order], owners[order]
    common = np.cumprod(words[1:] == words[:-1], axis=1).sum(axis=1) if len(words) > 1 else np.empty(0, np.int64)  # words of the common prefix
    same = (common == words.shape[1]) & (hosts[1:] == hosts[:-1])
    run = np.cumsum(np.r_[True, ~same][: len(order)]) - 1
    many = np.zeros(int(run[-1]) + 1 if len(run) else 0, bool)
    many[run[owners == 0]] = True
    many[run[1:][same & (owners[1:] != owners[:-1])]] = True
    out = np.zeros(len(order), bool)
    out[order] = many[run]
    return out


def _compared(least: int):
    """Of each chunk's suffixes those that repeat."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs_of(batches):
            keys = [np.frombuffer(r[2], _U) for r in rows]
            hosts, words = (np.frombuffer(b"".join(_grow(r[k]) for r in rows), kind) for k, kind in ((3, _U), (4, np.uint32)))
            hit = repeats(hosts, words.reshape(-1, least), np.concatenate([_values(r[5], 4) for r in rows]))
            ends = np.cumsum([len(k) for k in keys])
            yield pa.record_batch(_asked([(r[0], r[1], k[h].tobytes(), None, None, None) for r, k, h in zip(rows, keys, np.split(hit, ends[:-1]), strict=True) if h.any()]))

    return run


def main_texts(hosts: list[str], pages: list[str], least: int = 8, lists: bool = True) -> list[str]:
    """The texts of a few pages, in this process: repeats are those among them."""
    streams = Streams(hosts, [blocks(p, lists) for p in pages]).read(least)
    found = streams.suffixes.rows(np.ones(len(streams.suffixes.keys), bool))
    return streams.texts(np.sort(found["keys"][repeats(found["hosts"], found["words"], found["owners"])]), least)


def _finish(least: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (part,) = left.to_pylist()
        repeated = np.sort(np.concatenate([np.empty(0, _U), *(np.frombuffer(r["digests"], _U) for r in right.to_pylist())]))
        texts = Streams.unpack(part["own"]).read(least).texts(repeated, least)
        with pa.ipc.open_stream(_grow(part["rest"])) as f:
            rest = f.read_all()
        trim()
        return rest.append_column("text", pa.array(texts, pa.string()))

    return run


def extract(pages: DataFrame, least: int = 8, lists: bool = True) -> DataFrame:
    """``pages(url, html, ...)`` with the main ``text`` of each whole page in place of html.

    A null html is empty and gives an empty text; null urls are one host, the nameless one.  Pages
    of a host with equal words, repeated rows among them, count as one.  A page of any length is
    one row of its chunk.  An empty table gives an empty table.  A column text of the input is
    replaced; other names may be any.
    """
    pages = bounded_batches(pages).drop("text")
    rest = [f for f in pages.schema if f.name != "html"]
    names = [f"`{f.name}`" for f in rest]
    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rest, strict=True)] + ["text string"])
    shuffled = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(60_000, 2 * shuffled)
    taken = "_" * max(map(len, pages.columns))  # longer than any name of the input once a letter follows
    last = [F.col(c).alias(f"{taken}{c}") for c in ("url", "html")]
    parts = materialise_by(pages.select(*names, *last).mapInArrow(_chunks(lists), PART), "chunk", shuffled)
    own = parts.select("chunk", "own")
    met = lambda asked, compare: asked.repartition(shuffled, "bucket").sortWithinPartitions("bucket").mapInArrow(compare, ASKED).withColumnRenamed("chunk", "of")
    maybe = met(own.mapInArrow(_first(least, buckets), ASKED), _met)
    again = own.groupBy("chunk").cogroup(maybe.groupBy("of")).applyInArrow(_second(least, buckets), ASKED)
    return parts.groupBy("chunk").cogroup(met(again, _compared(least)).groupBy("of")).applyInArrow(_finish(least), schema)
