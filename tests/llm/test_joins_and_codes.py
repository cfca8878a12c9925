"""N-gram join, vector codes and source audit against brute force, with every awkward case."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import near_by_force

from spectral_lake.llm import minhash, ngram_join, queries, source_divergence, vector_codes

DOCS = "doc_id bigint, text string, lang string, source string, n string, value string, rk string"


@pytest.fixture(scope="module")
def near_rows():
    """Copies, near copies around the threshold, a shared passage, short and long texts, nulls, ties."""
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(60))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \n\t", "one", "ONE", "two words", "two  words", "a b c", "a b c d", "a b c d e", "long " * 30_000, "x" * 100_000]
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(20, 200))]
        texts.append(" ".join(base))
        for k in range(rng.randrange(4)):
            changed = list(base)
            for _ in range(rng.randrange(1, 2 + len(base) // 60)):
                changed[rng.randrange(len(base))] = word()
            texts += [" ".join(changed), "\n".join(changed).upper()][: 1 + k % 2]
        texts.append(" ".join(base[: len(base) // 2]) + " " + passage + " " + " ".join(word() for _ in range(50)))
    rows = [(i, t, "l", "s", "n", "v", "r") for i, t in enumerate(texts)]
    return [*rows, (None, texts[12], "l", "s", "n", "v", "r"), (4, texts[13], None, None, None, None, None), rows[20], rows[20]]


def test_ngram_join(spark, near_rows):
    got = [tuple(r) for r in ngram_join.linked(spark.createDataFrame(near_rows, DOCS).repartition(5)).collect()]
    assert collections.Counter(got) == collections.Counter(r[:3] for r in near_by_force(near_rows, words=4).elements())
    assert len({c for _, n, c in got if n}) < len([1 for _, n, _ in got if n])


def test_ngram_join_of_one_large_group(spark):
    """Near copies of one text, more than a block holds, and texts that share its passage only."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(700):
        t = list(base)
        t[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(base[:40] + [f"y{i}_{k}" for k in range(60)])) for i in range(300)]
    out = {r[0]: r[2] for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id bigint, text string"), cap=64, set_cap=64 * 1077).collect()}
    assert {out[i] for i in range(700)} == {0} and all(out[1000 + i] == 1000 + i for i in range(300))


def test_empty_tables(spark):
    assert ngram_join.linked(spark.createDataFrame([], DOCS)).collect() == []
    assert source_divergence.divergence(spark.createDataFrame([], DOCS)).collect() == []
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert vector_codes.train(none) is None and vector_codes.with_label_error(vector_codes.encode(none, None)).collect() == []


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_trees_leave_every_pair(percent):
    """The traversal keeps each true pair, and drops pairs that only share a passage."""
    rng = np.random.default_rng(percent)
    shared = rng.integers(1, 1 << 62, 40, dtype=np.uint64)
    sets = []
    for _ in range(150):
        own = np.unique(np.concatenate([shared, rng.integers(1, 1 << 62, int(rng.integers(5, 300)), dtype=np.uint64)]))
        sets += [own, np.unique(np.concatenate([own[: int(len(own) * rng.uniform(0.7, 1))], rng.integers(1, 1 << 62, 3, dtype=np.uint64)]))]
    tree = ngram_join.SignatureTree(ngram_join.bitmaps(sets, 1024), np.array([len(s) for s in sets]))
    near = tree.matrix(percent)
    true = np.array([[100 * (k := len(np.intersect1d(a, b, True))) >= percent * (len(a) + len(b) - k) for b in sets] for a in sets])
    assert (near | ~true).all() and near.sum() < 0.4 * near.size
    for step in (1, 7):  # however few node pairs are looked at together
        found = [p for i, j in tree.pairs(percent, step) for p in zip(i.tolist(), j.tolist())]
        assert len(found) == len(set(found)) and {(i, j) for i, j in found} | {(j, i) for i, j in found} == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))


def test_linked_sets_share_a_prefix(spark):
    """Whatever is known to be frequent, sets at the threshold share one of their first items."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(1, 1 << 62, int(rng.integers(1, 200)), dtype=np.uint64))
        b = a[rng.random(len(a)) > 0.08] if len(a) > 12 else a
        k = len(b)
        if 100 * k < 85 * len(a):
            continue
        known = np.unique(rng.choice(a, int(rng.integers(0, len(a) + 1)), replace=False))
        firsts = [ngram_join.prefix(s, 85, (known, np.arange(len(known)) % 3 + 1)) for s in (a, b)]
        assert len(np.intersect1d(*firsts))
        assert len(firsts[0]) == len(a) - -(-85 * len(a) // 100) + 1


def codes_by_force(vectors, parts=4, entries=256, rounds=4):
    """Plain loops over Python's integers."""
    good = sorted(((i is None, i or 0, tuple(v)), i, v, label) for i, v, label in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v))
    width = len(good[0][2])
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v], label) for _, i, v, label in good if len(v) == width]
    w = width // parts
    cut = [[tuple(v[p * w : p * w + w]) for p in range(parts)] for _, v, _ in good]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]

    def place(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = collections.defaultdict(list)
            for x in cut:
                members[place(x[p], books[p])[1]].append(x[p])
            books[p] = [tuple(sum(c) // len(members[k]) for c in zip(*members[k])) if k in members else e for k, e in enumerate(books[p])]
    found = [[place(x[p], books[p]) for p in range(parts)] for x in cut]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), str(label), "".join(f"{k:02x}" for _, k in f), min(sum(d for d, _ in f), vector_codes.LARGEST)) for (i, _, label), f in zip(good, found)), digest


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_vector_codes(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=8) * scale], int(i % 3) if i % 5 else None) for i in rng.permutation(400)]
    rows += [(5000, None, 1), (5001, [1.0] * 7 + [None], 1), (5002, [1.0] * 7 + [float("nan")], 1), (-5, [1.0] * 7 + [float("-inf")], 1), (5003, [1.0] * 4, 2), (5004, [], 2), (None, [0.5] * 8, 0)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], 0)]  # repeated rows, and one id with two vectors
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({"code": F.lit("x"), "error": F.lit(1), "same": F.lit(2)})
    books = vector_codes.train(df.repartition(7), entries=32)
    got = vector_codes.encode(df.repartition(3), books).collect()
    want, digest = codes_by_force(rows, entries=32)
    assert books.sha256() == digest
    assert sorted((str(r["vec_id"]), str(r["label"]), r["code"], r["error"]) for r in got) == want
    summed = vector_codes.with_label_error(vector_codes.encode(df, books)).collect()
    total = collections.Counter()
    for _, label, _, e in want:
        total[label] += e
    assert {str(r["label"]): r["label_error"] for r in summed} == {k: min(n, vector_codes.LARGEST) for k, n in total.items()}
    one = next(r for r in vector_codes.decode(vector_codes.encode(df, books), books).collect() if r["vec_id"] == rows[0][0])
    assert min(sum((int(np.floor(1024 * x)) - d) ** 2 for x, d in zip(rows[0][1], one["decoded"])), vector_codes.LARGEST) == one["error"]


@pytest.mark.parametrize("few", [10, 40, 5000])
def test_the_least_ids_are_found_by_bounds(spark, few):
    rng = np.random.default_rng(8)
    ids = [int(i) for i in rng.integers(-5000, 5000, 3000)] + [None] * 50
    df = spark.createDataFrame([(i, [1.0]) for i in ids], "vec_id bigint, embedding array<float>").repartition(5)
    got = sorted(r["vec_id"] for r in vector_codes._least(df, 20, few).collect() if r["vec_id"] is not None)
    assert got[:20] == sorted(i for i in ids if i is not None)[:20] and len(got) >= 20
    same = spark.createDataFrame([(7, [1.0])] * 100, "vec_id bigint, embedding array<float>")
    assert vector_codes._least(same, 20, 10).count() == 100


def test_frequent_shingles_are_bounded(spark, monkeypatch):
    rows = [(i, "one two three four five " + ("six seven eight " if i % 2 else "") + f"own{i} a b c") for i in range(64)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).select("text")
    items, n = ngram_join.frequent(texts, 4)
    assert len(items) == len(n) and (np.diff(items.astype(object)) > 0).all() and len(items) >= 2 and set(n.tolist()) == {21, 25}
    assert len(ngram_join.frequent(texts, 4, told=2)[0]) <= 2 and len(ngram_join.frequent(texts, 4, told=0)[0]) == 0


def test_vectors_of_odd_lengths(spark):
    """A length that the parts do not divide is padded; vectors without components have one code; huge ones saturate."""
    df = spark.createDataFrame([(i, [float(i), 1.0, -1.0, 0.5, 2.0 * i], 0) for i in range(9)], "vec_id bigint, embedding array<float>, label int")
    books = vector_codes.train(df)
    assert books.width == 5 and len(books.books[0][0]) == 2 and {r["error"] for r in vector_codes.encode(df, books).collect()} == {0}
    none = spark.createDataFrame([(1, [], None), (2, [], None)], "vec_id bigint, embedding array<float>, label int")
    assert {(r["code"], r["error"]) for r in vector_codes.encode(none, vector_codes.train(none)).collect()} == {("00000000", 0)}
    huge = spark.createDataFrame([(1, [3e38] * 4, 1), (2, [-3e38] * 4, 1), (3, [3e38] * 4, 1)], "vec_id bigint, embedding array<float>, label int")
    books = vector_codes.train(huge, entries=1, rounds=1)
    assert all(r["error"] == vector_codes.LARGEST for r in vector_codes.with_label_error(vector_codes.encode(huge, books)).collect() if r["vec_id"] == 2)


def test_only_the_annulus_can_hold_the_nearest():
    rng = np.random.default_rng(2)
    book = tuple(tuple(int(v) for v in e) for e in (rng.normal(size=(256, 16)) * 100).astype(int).tolist() + [[7] * 16] * 2)
    x = np.concatenate([(rng.normal(size=(2000, 16)) * 120).astype(np.int64), np.array(book[:50], np.int64), np.full((3, 16), 7)])
    best, dist = vector_codes.NormIndex(book).nearest(x)
    d = ((x[:, None, :] - np.array(book)[None]) ** 2).sum(axis=2)
    assert (dist == d.min(axis=1)).all() and (best == d.argmin(axis=1)).all()


def audit_by_force(rows, least, top):
    import re

    docs = [((r[2] or ""), (r[3] or ""), [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", r[1] or "")]) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= least]
        sources = {d[1] for d in own}
        count = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if seen[t] >= least) for s in sources}
        every = collections.Counter(t for d in own for t in d[2] if seen[t] >= least)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        share, q = {s: p(count[s]) for s in sources}, p(every)
        for s in sources:
            pairs = sorted((-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode()) for o in sources - {s})
            terms = sorted((q[t] - share[s][t], t.encode()) for t in kept if count[s][t] and share[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found)]
    return sorted(out)


def test_source_divergence(spark):
    rng = random.Random(9)
    words = "Lake river STONE straße über naïve 漢字 a-b c3d I_x".split()
    rows = []
    for i in range(120):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", "Z", None])
        rows.append((i, " ".join(rng.choice(words + [f"only{source or ''}"]) for _ in range(rng.randrange(30))), lang, source, "n", "v", "r"))
    rows += [(1, None, "en", "s1", None, None, None), (2, "", "fr", "s1", "", "", ""), (3, "alone", "fr", "s2", "", "", ""), (4, "one source", "it", "s", "", "", ""), (None, "lake\x00river " * 40_000, "en", "s2", "", "", "")]
    rows += [rows[7]] * 5
    for least, top in ((5, 3), (30, 50), (1, 50)):
        got = source_divergence.divergence(spark.createDataFrame(rows, DOCS).repartition(6), least, top)
        assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
        assert sorted(map(tuple, got.collect())) == audit_by_force(rows, least, top)


def test_counts_do_not_depend_on_what_a_task_holds(spark, monkeypatch):
    rows = [(i, f"word{'x' * (i % 7)} other", "en", f"s{i % 2}", "", "", "") for i in range(60)]
    df = spark.createDataFrame(rows, DOCS).coalesce(1)
    before = sorted(map(tuple, source_divergence.term_counts(df).collect()), key=str)
    batch = next(iter(df.select("text", "lang", "source").toArrow().to_batches()))
    monkeypatch.setattr(source_divergence, "_HELD", 3)
    held = collections.Counter()
    for b in source_divergence._count(iter([batch.slice(i, 10) for i in range(0, batch.num_rows, 10)])):
        for r in b.to_pylist():
            held[r["lang"], r["source"], r["term"], "n"] += r["n"]
            held[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
    assert all(held[r[0], r[1], r[2], "n"] == r[3] and held[r[0], r[1], r[2], "docs"] == r[4] for r in before)


def test_short_texts_are_one_shingle():
    assert len(minhash.shingle_set(b"a b c", 4)) == 1 and len(minhash.shingle_set(b"a b c d e", 4)) == 2


@pytest.mark.parametrize("name", ["op5_minhash_dedup", "op11_ngram_join", "op12_vector_codes", "op13_source_divergence"])
def test_same_rows_as_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    rows = collections.Counter(tuple(r[[d[0] for d in want.description].index(c)] for c in columns) for r in want.fetchall())
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    assert collections.Counter(map(tuple, got.select(*columns).collect())) == rows and rows
