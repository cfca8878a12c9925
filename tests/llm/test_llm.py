"""The text operators against brute force, on small tables with every awkward case."""

import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectral_lake.llm import bpe, common, edit_fingerprint, html_extract, language_mixture, license_scan, license_signatures, minhash, mixing, quality_rules, queries, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of lake and stone river to a light moss in wander quiet is fjord amber that lantern".split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "er", "ing"]) for _ in range(n))
    base = prose(120)
    near = base.split()
    near[100] = "changed"
    texts = [None, "", " \n\t ", "one", "two words", base, base, " ".join(near), base.upper(), prose(3000), "line of text here\n" * 40, prose(60) + " ## $$ !!" * 30, "ééé ünï £ 漢字  x", prose(80) + "\nReleased under the MIT License.\n" + prose(30), "x" * 3000, prose(90)]
    out = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*out, (None, base, "en", "s0", 1), (5, base, "en", "s1", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def bag(df):
    return collections.Counter(map(tuple, df.collect()))


def split(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def test_quality_counts(docs, rows):
    def count(d, t):
        t = t or ""
        w, lines = split(t), [x for x in t.split("\n") if split(x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        return d, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered), failed

    out = quality_rules.apply_rules(docs.withColumn("n_words", F.lit(-1)))
    assert bag(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == collections.Counter(count(r[0], r[1]) for r in rows)
    kept = {r["doc_id"]: r["failed_rules"] for r in out.where("kept").collect()}
    assert 15 in kept and 11 not in kept


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 980)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes, 3.0).collect()}
    assert got["b"] == got["c"] == 30.0 and got["a"] == pytest.approx(970) and got[None] == pytest.approx(970)


def test_mixing(docs, rows):
    out = mixing.mix_sources(docs).toPandas()
    assert len(out) == len(rows)
    assert sorted(out["size"]) == sorted(len(split(r[1])) for r in rows)
    assert (out["taken"] <= 3 * out["size"]).all() and out.groupby("source", dropna=False)["target"].first().sum() == pytest.approx(out["size"].sum())
    again = mixing.mix_sources(docs.repartition(5)).toPandas()
    assert sorted(zip(out["h"], out["taken"])) == sorted(zip(again["h"], again["taken"]))


def test_rates_solve_the_dual(spark):
    """Rates against a bisection of each source's dual in numpy; copies are these rates, rounded."""
    sf = SF.replace("0.001", "0.01")
    out = mixing.mix_sources(common.table(spark, sf, "documents")).toPandas()
    sizes = out.groupby("source")["size"].sum().sort_index()
    weight = np.arange(len(sizes)) % 3 + 1.0
    most, share = 3.0 * sizes.to_numpy(), None
    capped = np.zeros(len(sizes), bool)
    while share is None or ((share > most) & ~capped).any():
        capped |= False if share is None else share > most
        share = np.where(capped, most, weight * (sizes.sum() - most[capped].sum()) / weight[~capped].sum())
    for (source, g), target in zip(out.groupby("source"), share):
        assert g["target"].iloc[0] == pytest.approx(target)
        z = g["size"] / g["size"].mean()
        lo, hi = -200.0, 200.0
        for _ in range(200):
            lam = (lo + hi) / 2
            over = (g["size"] * np.minimum(3.0, np.exp(np.minimum(lam * z, 50)))).sum() > target
            lo, hi = (lo, lam) if over else (lam, hi)
        want = np.minimum(3.0, np.exp(np.minimum(lam * z, 50)))
        assert np.allclose(g["rate"], np.where(g["size"] > 0, want, 0.0), rtol=1e-5)
        assert (g["copies"] - g["rate"]).abs().max() <= 2 and abs((g["copies"] * g["size"]).sum() - target) <= 0.01 * target


def test_mixing_comes_near_its_targets(spark):
    g = mixing.mix_sources(common.table(spark, SF.replace("0.001", "0.01"), "documents")).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).toPandas()
    assert (abs(g["k"] - g["t"]) / g["t"]).max() < 0.01


def near_by_force(rows, words=5, percent=85):
    sets, up = [], list(range(len(rows)))
    for r in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in split(r[1])]
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), 1 << 60), r[0])
    return collections.Counter((r[0], len(sets[i]), least.get(root(i), r[0]), r[0] == least.get(root(i), r[0])) for i, r in enumerate(rows))


@pytest.mark.parametrize("caps", [{}, {"cap": 2, "set_cap": 150}])
def test_near_duplicates(spark, docs, rows, caps):
    assert bag(minhash.near_duplicates(docs, **caps)) == near_by_force(rows)
    rng = random.Random(3)
    base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(150)]
    chain = [(i, " ".join(f"w{k}" if k < 3 * (i % 9) else x for k, x in enumerate(base)), None, None, 0) for i in range(40)]
    chain = [(i, t + f" end{i}", *rest) for i, t, *rest in chain]
    assert bag(minhash.near_duplicates(spark.createDataFrame(chain, SCHEMA), **caps)) == near_by_force(chain)


def test_one_row_of_each_group_stays(spark):
    base, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, base), (None, base + " end"), (1, base), (1, other), (None, other + " end"), (None, "a b"), (None, "a b"), (None, "c d"), (None, None), (2, ""), (2, "")]
    docs = spark.createDataFrame([(i, t, None, "s", 0, 7) for i, t in rows], SCHEMA + ", rk int")
    got = collections.Counter((r["doc_id"], r["text"]) for r in minhash.one_of_each(docs).collect())
    assert got == collections.Counter([(1, base), (1, other), (None, "a b"), (None, "c d"), (None, None), (2, "")])
    assert minhash.one_of_each(docs.limit(0)).count() == 0


def test_pipeline_drops_copies_at_four_fifths(spark):
    import corpus_pipeline as p

    words = [f"w{i}" for i in range(104)]
    near = [x if i != 50 and i != 70 else x + "x" for i, x in enumerate(words)]  # 90 of 110 shingles: 0.818
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near))], "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    assert [r["doc_id"] for r in p.near_dedup(spark, docs, SF).collect()] == [1]
    assert {r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {1, 2}


def test_no_pair_under_the_distance_lacks_a_key():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, 40).astype(np.uint16)
        b = a.copy()
        b[rng.choice(40, 15, replace=False)] += 1
        ka, kb = minhash.chunk_keys(np.stack([a, b]), 8, 5, 1)
        assert set(ka.tolist()) & set(kb.tolist())


def repeats_by_force(rows, length):
    c = collections.Counter((r[1] or "").encode()[i : i + length] for r in rows for i in range(len((r[1] or "").encode()) - length + 1))
    out = []
    for r in rows:
        t = (r[1] or "").encode()
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        kept = bytes(x for x, g in zip(t, gone[1:]) if not g)
        out.append((r[0], len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), kept))
    return collections.Counter(out)


@pytest.mark.parametrize("length,gram,hot", [(400, 64, 4096), (60, 16, 4096), (60, 16, 1)])
def test_repeats(docs, rows, length, gram, hot):
    out = suffix_dedup.remove_repeats(docs.withColumn("rk", F.lit(1)), length, gram, hot)
    assert bag(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept_bytes"))) == repeats_by_force(rows, length)
    text = suffix_dedup.remove_repeats(docs, length, gram, hot, text=True)
    assert bag(text.select("doc_id", "kept_text")) == collections.Counter((k[0], k[4].decode(errors="ignore")) for k in repeats_by_force(rows, length).elements())


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats_and_passages(spark, hot):
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    long_one, short = prose(40), prose(12)
    texts = [f"{prose(rng.randrange(30))} {rng.choice([long_one, short, long_one[20:150], ''])} {prose(rng.randrange(30))}\u00e9" for _ in range(60)]
    rows = [(i // 2 if i < 6 else i, t) for i, t in enumerate([*texts, texts[0], texts[0], None, "", "\ufffd" + long_one])] + [(None, texts[3]), (None, texts[3])]
    out = suffix_dedup.repeats_and_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 120, 60, 16, hot)
    assert bag(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes")) == repeats_by_force(rows, 120)
    want = collections.Counter((k[0], k[2], k[3], k[4].decode(errors="ignore")) for k in repeats_by_force(rows, 60).elements())
    assert bag(out.select("doc_id", "n_passage_bytes", "n_passages", "passage_free_text")) == want


def test_multikey_sort():
    rng = np.random.default_rng(2)
    rows, group = rng.integers(0, 2, (200, 16)).astype(np.uint8), rng.integers(0, 5, 200)
    order, lcp = suffix_dedup.multikey_sort(group, rows)
    keys = [(int(g), r.tobytes()) for g, r in zip(group[order], rows[order])]
    assert keys == sorted(keys)
    for i in range(1, 200):
        same = keys[i][0] == keys[i - 1][0]
        assert lcp[i] == (next((k for k in range(16) if keys[i][1][k] != keys[i - 1][1][k]), 16) if same else -1)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First <b>bold<br>text.<p>Second&nbsp;one &#233;<script>x = "</p>";</script></p><aside>More</aside><form>Join</form>
<section id="comments"><p>A reader</p></section></article><footer>&copy; all</footer></body></html>"""


def texts_by_force(pages, least=8, lists=True):
    """Main texts by comparing word tuples of all pages of a host, outside their articles."""
    parsed = [(html_extract.host_of(u), html_extract.blocks(h or "", lists)) for _, u, h in pages]
    seen, streams = collections.defaultdict(set), []
    for host, found in parsed:
        words = [w for t, flags in found if flags != 1 for w in t.split(" ")]
        streams.append(words)
        page = " ".join(t for t, _ in found)
        for i in range(len(words) - least + 1):
            seen[host, tuple(words[i : i + least])].add(page)
    out = {}
    for (page_id, _, _), (host, found), words in zip(pages, parsed, streams):
        covered = [False] * len(words)
        for i in range(len(words) - least + 1):
            if len(seen[host, tuple(words[i : i + least])]) > 1:
                covered[i : i + least] = [True] * least
        at, texts = 0, []
        for t, flags in found:
            w, own = t.split(" "), []
            if flags == 1:
                texts.append(t)
                continue
            c = covered[at : at + len(w)]
            at += len(w)
            for gone, run in itertools.groupby(zip(w, c), key=lambda x: x[1]):
                part = [x for x, _ in run]
                if not gone or len(part) < min(least, len(w)):
                    own += part
            if own and not flags & 2:
                texts.append(" ".join(own))
        out[page_id] = "\n\n".join(texts)
    return out


PAGES = "page_id bigint, url string, html string"


def test_html_article():
    assert html_extract.main_texts(["h"], [PAGE]) == ["Head & line\n\nFirst bold text.\n\nSecond one é"]


def test_html_against_force(spark):
    """Half of the pages have no landmark; hosts share lines, near copies and mirrors."""
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))
    lines, pages = [prose(rng.randrange(6, 24)) for _ in range(8)], []
    for i in range(300):
        story = [prose(rng.randrange(3, 60)) for _ in range(rng.randrange(1, 6))]
        if i % 9 == 0 and pages:
            story[0] = lines[0] + " " + story[0]
        parts = [f"<{rng.choice(['p', 'div'])}>{x}" for x in [*story, rng.choice(lines)]]
        rng.shuffle(parts)
        tag = ["article", "div", "main", "section"][i % 4]
        pages.append((i, f"https://www.h{rng.randrange(7)}.example/{i}", f"<body><nav>{rng.choice(lines)}</nav><div>{rng.choice(lines)}</div><{tag}>{' '.join(parts)}</{tag}><footer>{rng.choice(lines)}</footer>"))
    for i in range(300, 340):  # near copies and mirrors of pages on the same host
        of = pages[rng.randrange(300)]
        pages.append((i, of[1] + "?again", of[2] if i % 2 else of[2].replace("</body>", "") + f"<p>{prose(20)}"))
    pages += [(400, None, None), (401, None, ""), (402, "x", "<p>bro<ken &amp"), (403, "y", PAGE * 3), (404, None, "<p>" + prose(200_000) + "</p>")]
    df = spark.createDataFrame(pages, PAGES).repartition(3)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df.selectExpr("*", "1 AS chunk", "2 AS own", "3 AS text", "4 AS _url", "5 AS _html")).collect()}
    want = texts_by_force(pages)
    assert got == want
    alone = {p[0]: html_extract.main_texts([""], [p[2] or ""])[0] for p in pages}
    assert sum(alone[i] != want[i] for i in alone) > 150  # repeats decide, with landmarks and without
    assert sum(alone[i] != want[i] for i in range(300) if i % 2 == 0) > 20
    assert html_extract.extract(df.limit(0)).count() == 0
    bare = {r["page_id"]: r["text"] for r in html_extract.extract(df, lists=False).collect()}
    assert bare == texts_by_force(pages, lists=False)


def test_no_story_loses_words(spark):
    """Every block of every article of the pages, and by repeats alone two thirds of the words outside."""
    pages = [tuple(r) for r in common.table(spark, SF.replace("0.001", "0.1"), "pages").select("page_id", "url", "html").collect()]
    parsed = {i: html_extract.blocks(h or "") for i, _, h in pages}
    stories = {i: [t for t, flags in found if flags == 1] for i, found in parsed.items()}
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, PAGES).repartition(8)).collect()}
    assert all(got[i] == "\n\n".join(stories[i]) for i in stories)
    bare = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, PAGES).repartition(8), lists=False).collect()}
    size = lambda x: sum(len(t.split()) for t in x)
    own, every = size(t for x in stories.values() for t in x), size(t for _, _, h in pages for t, _ in html_extract.blocks(h or "", False))
    assert size(bare.values()) - own < 0.36 * (every - own)
    assert all(t in bare[i] for i, x in stories.items() for t in x)


def test_a_story_quoted_elsewhere_stays(spark):
    own, share = lambda i: " ".join(f"word{i}x{k}" for k in range(90)), "<p>Share this story with all your friends and join our list today</p>"
    page = lambda i, quoted: f"<body><p>Note {i} stands outside of it</p><div>{own(quoted)}</div><article><h1>Head of {i} in eight words or more it is</h1><p>{own(i)}</p></article>{share}</body>"
    pages = [(i, "http://h.example/", page(i, 1)) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, PAGES)).collect()}
    assert all(got[i] == f"Note {i} stands outside of it\n\nHead of {i} in eight words or more it is\n\n{own(i)}" for i in range(4))


def test_hostile_pages_take_linear_time():
    n = 40_000
    began = time.time()
    for page in ("<div>" * n + "</p>" * n, "<b><nav>" + "<div>" * n + "</b>" * n, "<a " * n, "<!x " * n + "<p>a", "<a href=\"x' >" * n, "<!--" * n + "<p>a</p>", "<script>" * n, "&#" * n, "<p><i>" * n + "</p>" * n):
        html_extract.blocks(page)
    assert time.time() - began < 20
    assert html_extract.blocks("<p>a<b") == [("a<b", 0)] and html_extract.blocks("x <!-- never ends") == [("x", 0)]
    assert html_extract.blocks("<main><div>in</div></p></main>out") == [("in", 1), ("out", 0)]


def test_bpe_is_tiktoken(docs, rows):
    import tiktoken

    public = queries.public_tokenizers()
    ranks = public.path(queries.RANKS)
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.load_ranks(ranks), special_tokens={})
    want = collections.Counter((r[0], np.array(own.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows)
    assert bag(bpe.decode(bpe.encode(docs, ranks, public.PATTERN), ranks).select("doc_id", "ids", "decoded")) == want
    assert bpe.encode(docs.limit(0), ranks, public.PATTERN).count() == 0


def test_merging_is_tiktoken():
    import tiktoken

    public = queries.public_tokenizers()
    ranks = bpe.load_ranks(public.path(queries.RANKS))
    own = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    words = ["".join(rng.choice("aebcdthé漢 .\n0") for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + ["a" * 3001, "x" * 257, "thethethe" * 500, "\u00e9" * 999]
    assert all(bpe.merge_word(w.encode(), ranks) == own.encode_ordinary(w) for w in words)
    long_one = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    assert bpe.merge_word(long_one.encode(), ranks) == own.encode_ordinary(long_one)


@pytest.mark.parametrize("buckets,step", [(1, 10**6), (4, 500)])
def test_edited_texts(docs, rows, buckets, step):
    out = edit_fingerprint.edited_fingerprints(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), buckets, step).toPandas().sort_values("doc_id")
    texts = [r[1] or "" for r in rows[:16]]
    want = []
    for a, b in zip(texts, [*texts[1:], texts[0]]):
        k = len(a) // 4
        want.append(hashlib.sha256((a[: len(a) - k] + b[:k]).encode()).hexdigest())
    assert out["edited_sha256"].tolist() == want and out["n_chars"].tolist() == [len(t) for t in texts]
    prints = dict(zip(out["doc_id"], out["fingerprint"]))
    assert prints[5] == prints[6] != prints[7]
    assert edit_fingerprint.edited_fingerprints(docs, buckets, step).count() == len(rows)


@pytest.mark.parametrize("n", [1, 3])
def test_edited_texts_without_ids(spark, n):
    d = spark.createDataFrame([(None, f"text number {i}") for i in range(n)], "doc_id bigint, text string").repartition(2)
    assert edit_fingerprint.edited_fingerprints(d).count() == n


def test_walk_against_a_plain_loop():
    def plain(text):
        coins, written = edit_fingerprint.read(text)
        steps, at, stands = edit_fingerprint.steps_of(len(text)), 0, []
        for t in range(int(steps.max()) + 1):
            stands.append(at)
            at += int(edit_fingerprint._COINS[t % edit_fingerprint.PERIOD, coins[at]])
        return [written[stands[t]] for t in steps.tolist()]

    rng = random.Random(5)
    texts = ["", "a", "ab", "é" * 5000, "漢字 text"] + ["".join(rng.choice("abcdef ghi") for _ in range(rng.randrange(1, 9000))) for _ in range(12)]
    for x, y in zip(texts, [*texts[1:], texts[0]]):
        cut = len(x) // 4
        edited = x[: len(x) - cut] + y[:cut]
        walked = edit_fingerprint.Walked(x, len(edited))
        assert walked.print().tolist() == plain(x) == edit_fingerprint.fingerprint(x).tolist()
        assert walked.edited(edited, len(x) - cut).tolist() == plain(edited)


def test_near_and_far_texts():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    texts = [t for t in d["text"] if len(t) > 500][:60]
    a = [edit_fingerprint.fingerprint(t) for t in texts]
    few = [edit_fingerprint.likeness(x, edit_fingerprint.fingerprint(t[:100] + "zz" + t[100:200] + t[203:])) for x, t in zip(a, texts)]
    assert np.mean(few) > 0.8 and np.mean([edit_fingerprint.likeness(x, y) for x, y in zip(a, a[1:])]) < 0.1


def test_near_classes_find_what_all_pairs_find(spark):
    rng = random.Random(6)
    texts = [t for t in pd.read_parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")["text"]]
    for t in [t for t in texts if len(t) > 300][:400]:
        at = rng.randrange(len(t))
        texts.append(t[:at] + rng.choice(["z", "", "other words "]) + t[at + rng.randrange(3) :])
    prints = np.stack([edit_fingerprint.fingerprint(t) for t in texts])
    same = np.concatenate([(prints[i : i + 100, None, :] == prints[None]).sum(axis=2) for i in range(0, len(prints), 100)])
    linked = [(int(i), int(j)) for i, j in np.argwhere(np.triu((same / 128 - 1 / 16) * 16 / 15 >= 0.8, 1))]
    rows = [(i, edit_fingerprint.as_text(p)) for i, p in enumerate(prints)]
    d = spark.createDataFrame(rows, "doc_id bigint, fingerprint string").repartition(3)
    for cap in (256, 4):
        got = {r["fingerprint"]: r["near_class"] for r in edit_fingerprint.near_classes(d, cap=cap).collect()}
        assert set(got) == {p for _, p in rows}
        met = [got[rows[i][1]] == got[rows[j][1]] for i, j in linked]
        assert len(met) > 300 and np.mean(met) >= 0.98
        up = list(range(len(rows)))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, j in linked:
            up[root(i)] = root(j)
        least = {}
        for i in range(len(rows)):
            least[root(i)] = min(least.get(root(i), i), i)
        assert np.mean([got[p] == least[root(i)] for i, p in rows]) > 0.98 and all(root(got[p]) == root(i) for i, p in rows)
    assert edit_fingerprint.near_classes(d.limit(0)).count() == 0


def scan_by_force(text):
    t = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
    at = [(i, label) for p, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found = []
    for k, first in enumerate(w):
        rest = " ".join(w[k : k + 60])
        for i, prio, conf, label, words, rx in license_signatures.signature_rules():
            if first in words and (m := re.match(f"(?:{rx})(?= |$)", rest)):
                found.append((prio, i, conf, label, k, k + m[0].count(" ")))
    inside = lambda d, e: e[4] <= d[4] and e[5] >= d[5] and (e[0] < d[0] or (e[0] == d[0] and (e[5] - e[4], d[1]) > (d[5] - d[4], e[1])))
    left = [d for d in found if not any(inside(d, e) for e in found)]
    base = sorted({label for _, label in at})
    score = max([d[2] for d in left] + [0.6 * bool(base)])
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(base), ",".join(sorted({*base, *(d[3] for d in left)})), score


LICENSES = [
    ("MIT License mit license, MIT LICENSE", {"mit"}),
    ("Licensed under the Apache License, Version 2.0. and Apache License", {"apache", "apache-2.0"}),
    ("under CC-BY-NC-SA 4.0; SPDX-License-Identifier: GPL-3.0", {"cc-by", "cc-by-nc-sa", "gpl-3.0"}),
    ("SPDX-License-Identifier: MIT", {"mit"}),
    ("// SPDX-License-Identifier: Apache-2.0", {"apache-2.0"}),
    ("SPDX-License-Identifier: MPL-2.0", {"mpl-2.0"}),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", {"lgpl-2.1"}),
    ("Licensed under the GPLv3", {"gpl-3.0"}),
    ("licensed under the GNU GPL", {"gpl"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", {"mit"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", {"bsd"}),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of", {"gpl", "gpl-3.0+"}),
    ("GNU General Public License, version 3 all rights reserved", {"gpl", "gpl-3.0", "all-rights-reserved"}),
    ("Todos los derechos reservados", {"all-rights-reserved"}),
    ("cc bye and a mit of wool, licence to cook", set()),
]


def test_licenses(spark, rows):
    texts = [r[1] for r in rows] + [t for t, _ in LICENSES] + [" ".join(t for t, _ in LICENSES) * 3]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("words", F.lit("mine")).withColumn("own", F.lit(1)).withColumn("labels", F.lit(2))
    out = license_scan.scan(d)
    got = out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "words", "own")
    assert bag(got) == collections.Counter((i, *scan_by_force(t), "mine", 1) for i, t in enumerate(texts))
    labels = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in out.collect()}
    assert all(labels[len(rows) + k] == want for k, (_, want) in enumerate(LICENSES))
    assert license_scan.scan(d.limit(0)).count() == 0


def test_every_license_signature_is_gated_and_short():
    rules = license_signatures.signature_rules()
    assert len(rules) > 250 and len({r[5] for r in rules}) == len(rules)
    for r in rules:
        assert license_signatures.keyword_of(r[5]) and r[4]
        assert len(re.sub(r"[()?:|]", " ", r[5].replace("{1,12}", " x" * 12)).split()) <= license_signatures.SPAN


def test_many_licenses_in_one_text_take_time_in_proportion(spark):
    text = "Released under the MIT License. Apache License 2.0, see GPLv3; all rights reserved\n" * 12_000  # 1 MB
    began = time.time()
    (row,) = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).select("n_base", F.size("detections").alias("n")).collect()
    assert tuple(row) == (24_000, 48_000) and time.time() - began < 60


def test_language(spark, docs):
    out = queries.op4_language_id(spark, SF.replace("0.001", "0.01")).toPandas()
    truth = pd.read_parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    m = out.merge(truth, on="doc_id")
    assert (m["lang"] == m["lang_pred"])[m["held_out"]].mean() > 0.98 and out["score"].between(0, 1).all()
    model = language_mixture.train(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language_mixture.identify(docs, model).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[9] == "en"
    assert {r["lang_pred"] for r in language_mixture.identify(docs, language_mixture.train(docs.limit(0))).collect()} == {"und"}


def test_mixture_is_plain_em():
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(40), 3)
    n = rng.integers(0, 9, 40)
    w = [1 / 3] * 3
    for _ in range(15):
        new = [0.0] * 3
        for cell, count in enumerate(n.tolist()):
            total = sum(w[k] * p[k, cell] for k in range(3))
            for k in range(3):
                new[k] += count * w[k] * p[k, cell] / total
        w = [x / sum(new) for x in new]
    got, level = language_mixture.mixture(p, n)
    assert np.allclose(got, w) and level == pytest.approx(sum(c * np.log(sum(w[k] * p[k, i] for k in range(3))) for i, c in enumerate(n.tolist())))


def test_language_mixture_finds_both():
    rng = np.random.default_rng(4)
    p = np.stack([np.r_[np.full(50, 0.019), np.full(50, 0.001)], np.r_[np.full(50, 0.001), np.full(50, 0.019)], np.tile([0.019, 0.001], 50)])
    cells = np.r_[rng.integers(0, 50, 700), rng.integers(50, 100, 300)]
    share, main, score = language_mixture.infer(p / p.sum(axis=1, keepdims=True), cells)
    assert main == 0 and share[0] == pytest.approx(0.7, abs=0.08) and share[:2].sum() > 0.9 and 0 < score <= 1


def test_toxicity_on_labels_that_were_not_learned(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = common.table(spark, sf, "documents").select("doc_id", "text"), common.table(spark, sf, "labels")
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    out = toxicity.classify(docs.join(labels.where(held), "doc_id"), toxicity.train(docs, labels.where(~held))).toPandas()
    truth = common.table(spark, sf, "labels").where(held).toPandas().drop_duplicates("doc_id").set_index("doc_id")["toxic"]
    right, hit = truth.reindex(out["doc_id"]).to_numpy() == 1, out["toxic"].to_numpy()
    assert len(out) > 800 and right[hit].mean() > 0.9 and hit[right].mean() > 0.8


def test_chain_feeds_out_of_fold_probabilities():
    rng = np.random.default_rng(1)
    x, fold = rng.normal(size=(400, 3)), np.arange(400) % 4
    y = np.stack([x[:, 0] > 0, (x[:, 0] > 0) & (x[:, 1] > 0)], 1).astype(float)
    models, limit = toxicity.fit_chain(x, y, fold)
    out = np.zeros(400)
    for f in range(4):
        out[fold == f] = toxicity.score(x[fold == f], toxicity.logistic(x[fold != f], y[fold != f, 0]))
    assert np.allclose(models[1], toxicity.logistic(np.c_[x, out], y[:, 1])) and len(models[1]) == len(models[0]) + 1
    last = np.zeros(400)
    for f in range(4):
        last[fold == f] = toxicity.score(np.c_[x, out][fold == f], toxicity.logistic(np.c_[x, out][fold != f], y[fold != f, 1]))
    f1 = lambda k: 2 * ((last >= k) * y[:, 1]).sum() / ((last >= k).sum() + y[:, 1].sum())
    assert f1(limit) == max(f1(k / 20) for k in range(2, 19))


def test_toxicity_cases(spark, docs):
    empty = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    got = toxicity.classify(docs.withColumn("toxic", F.lit(1)).withColumn("p_toxic", F.lit("x")), empty).collect()
    assert len(got) == 18 and not any(r["toxic"] for r in got)
    assert toxicity.classify(docs.limit(0), empty).count() == 0
    bad, good = ["vile foul " + w for w in WORDS], ["calm kind " + w for w in WORDS]
    d = spark.createDataFrame([*enumerate([*bad, *good]), (0, "zz"), (None, bad[0])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i < len(bad))) for i in range(2 * len(WORDS))] + [(0, 1, 0), (1, None, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(d, labels, least_docs=2)
    assert model[0].keys() >= {b"vile", b"foul"} and np.array_equal(model[1][2], toxicity.train(d.repartition(5), labels.repartition(3), least_docs=2)[1][2])
    got = {r["text"]: r["toxic"] for r in toxicity.classify(d.withColumn("text", F.concat("text", F.repeat(F.lit(" of"), F.lit(400_000)))), model).join(d, "doc_id").collect()}
    assert got[bad[3]] and not got[good[3]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (103, 101), (200, 200)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys((100, 101, 103), 100)}


def test_empty_tables(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert quality_rules.apply_rules(d).count() == mixing.mix_sources(d).count() == minhash.near_duplicates(d).count() == 0
    assert suffix_dedup.remove_repeats(d).count() == license_scan.scan(d).count() == edit_fingerprint.edited_fingerprints(d).count() == 0


def test_names_that_clash(spark):
    """Columns of the input named as the operators' own do no harm."""
    names = ["_t", "_s", "_words", "_lines", "_in", "_m", "norm", "words", "starts", "base", "own", "h", "salt", "rank", "chunk", "bucket", "rest", "seq", "rk", "grp", "node", "of"]
    d = spark.createDataFrame([(1, "one text of words here", "en", "a"), (2, "another text of words there", "en", "b")], "doc_id bigint, text string, lang string, source string")
    d = d.withColumns({n: F.lit("mine") for n in names})
    for out in (quality_rules.apply_rules(d), license_scan.scan(d)):
        assert all(r[n] == "mine" for r in out.collect() for n in names if n in out.columns) and set(names) <= set(out.columns)
    ranks = queries.public_tokenizers()
    coded = bpe.decode(bpe.encode(d, ranks.path(queries.RANKS), ranks.PATTERN), ranks.path(queries.RANKS)).collect()
    assert {bytes(r["decoded"]).decode() for r in coded} == {"one text of words here", "another text of words there"} and all(r["chunk"] == "mine" for r in coded)
    assert mixing.mix_sources(d).count() == minhash.near_duplicates(d).count() == minhash.one_of_each(d).count() == suffix_dedup.remove_repeats(d).count() == edit_fingerprint.edited_fingerprints(d).count() == 2
    assert language_mixture.identify(d, language_mixture.train(d)).count() == 2


def test_a_text_of_a_megabyte(spark):
    rng = random.Random(12)
    text = " ".join(rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(130_000))
    d = spark.createDataFrame([(1, text, "en", "a", 0), (2, "small text", "en", "a", 0), (3, text + " end", "en", "b", 0)], SCHEMA)
    near = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(d).collect()}
    assert near == {1: 1, 2: 2, 3: 1}
    cut = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(d).collect()}
    assert cut == {1: (len(text), 1), 2: (0, 0), 3: (len(text), 1)}
    counts = {r["doc_id"]: r["n_words"] for r in quality_rules.apply_rules(d).collect()}
    assert counts == {1: 130_000, 2: 2, 3: 130_001}
    ranks = queries.public_tokenizers()
    whole = bpe.decode(bpe.encode(d, ranks.path(queries.RANKS), ranks.PATTERN), ranks.path(queries.RANKS)).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in whole}[3] == text + " end"
    prints = {r["doc_id"]: r["n_chars"] for r in edit_fingerprint.edited_fingerprints(d).collect()}
    assert prints == {1: len(text), 2: 10, 3: len(text) + 4}
    assert {r["lang_pred"] for r in language_mixture.identify(d, language_mixture.train(d)).collect()} == {"en"}
    assert sum(r["size"] for r in mixing.mix_sources(d).collect()) == 260_003


def test_pipeline_stages_on_an_empty_table(spark):
    import corpus_pipeline as p

    d = spark.createDataFrame([], SCHEMA)
    for _, stage in p.STAGES:
        assert stage(spark, d, SF).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = common.table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.collect()]
    kept = common.materialise(p.quality(spark, docs, SF))
    good = {r["doc_id"] for r in quality_rules.apply_rules(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good
    left = [r for r in rows if r[0] in good]
    one = common.materialise(p.near_dedup(spark, kept, SF))
    left = [r for r in left if any(k[0] == r[0] and k[3] for k in near_by_force(left, percent=80))]
    assert bag(one) == collections.Counter(left)
    cut = common.materialise(p.repeats(spark, one, SF))
    assert {(r["doc_id"], r["text"]) for r in cut.collect()} == {(k[0], k[4].decode(errors="ignore")) for k in repeats_by_force(left, p.PASSAGE)}
    mixed = common.materialise(p.mix(spark, cut, SF))
    assert set(mixed.columns) == set(p.COLUMNS) and collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({r["doc_id"]: r["copies"] for r in mixing.mix_sources(cut).collect() if r["copies"]})
    out = p.tokens(spark, mixed, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert len(out) == mixed.count() and all(hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() == r["decoded_sha256"] for r in out)
