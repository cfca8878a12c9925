"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another: ``degraded`` (labelled low in quality), ``severe``
(toxic and low in quality), ``toxic``.  Each category's logistic model sees the words' features
and the probabilities of the categories before it.  In training those are out-of-fold, so that
a later model learns from probabilities as good as those it will get.

Features are the presence of words that tell a category (chosen by likelihood ratio) and the
shares of symbols, capitals, digits and repeated lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean

CATEGORIES = ("degraded", "severe", "toxic")
_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MARKS, _CAPITALS, _DIGITS = b"#*$%&|<>!", bytes(range(65, 91)), b"0123456789"
SHARES = 4


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode().translate(_SPACES).split())


def shares_of(text: str | None) -> list[float]:
    raw = (text or "").encode()
    size = max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    part = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    return [part(_MARKS), part(_CAPITALS), part(_DIGITS), 1 - len(set(lines)) / len(lines) if lines else 0.0]


@lean
def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
            w = list(words_of(t))
            yield pa.record_batch([pa.array(w, pa.binary()), pa.array([y] * len(w), pa.list_(pa.int64()))], names=["word", "y"])


def features(texts: list[str | None], place: dict[bytes, int]) -> np.ndarray:
    """A row for each text: which of the chosen words it has, and its shares."""
    x = np.zeros((len(texts), len(place) + SHARES))
    found = [[place[w] for w in words_of(t) & place.keys()] for t in texts]
    x[np.repeat(np.arange(len(texts)), [len(f) for f in found]), np.array([k for f in found for k in f], np.int64)] = 1.0
    x[:, len(place) :] = [shares_of(t) for t in texts]
    return x


def _vectors(place: dict[bytes, int]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text").to_pylist(), place).tolist()
            yield pa.record_batch([b.column("h"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["h", "y", "x"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept, not penalised."""
    x = np.c_[x, np.ones(len(x))]
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pen[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which to predict, of 0.1 to 0.9: the greatest F1, the higher one of equals."""
    hits = [(p >= k / 20, k / 20) for k in range(2, 19)]
    return max((2 * (h * y).sum() / max(1.0, h.sum() + y.sum()), k) for h, k in hits)[1]


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], float]:
    """A model for each column of ``y``, earlier categories entering as out-of-fold probabilities; the last one's limit by these."""
    models, out = [], np.zeros(len(x))
    for k in range(y.shape[1]):
        models.append(logistic(x, y[:, k]))
        out = np.zeros(len(x))
        for f in np.unique(fold):
            inside = fold == f
            out[inside] = score(x[inside], logistic(x[~inside], y[~inside, k])) if (~inside).any() else y[:, k].mean()
        x = np.c_[x, out]
    return models, best_limit(out, y[:, -1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, words: int = 192, least_docs: int = 4, folds: int = 4) -> tuple[dict[bytes, int], list[np.ndarray], float]:
    """Feature places, the chain, and the limit of its last category, from ``labels(doc_id, quality, toxic)``.

    Fitted on at most about ``max_rows`` labelled rows, chosen by a digest of doc_id; null labels
    are left out.  Of several labels of a doc_id the worst counts (least quality, most toxic), of
    several texts the least.  Without labelled rows the chain is empty and every probability is 0.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    n = known.count()
    if not n:
        return {}, [], 0.5
    h = F.xxhash64("doc_id")
    picked = known.where(F.pmod(h, F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_rows / n)))
    y = F.array(F.col("quality") == 0, (F.col("quality") == 0) & (F.col("toxic") == 1), F.col("toxic") == 1).cast("array<bigint>")
    rows = docs.select("doc_id", "text").join(picked, "doc_id").groupBy(h.alias("h"), y.alias("y")).agg(F.min("text").alias("text"))
    stats = rows.mapInArrow(_vocabulary, "word binary, y array<bigint>").groupBy("word").agg(F.count("*").alias("df"), *[F.sum(F.col("y")[k]).alias(f"p{k}") for k in range(len(CATEGORIES))])
    total = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col("y")[k]), F.lit(0)).alias(f"p{k}") for k in range(len(CATEGORIES))]).first()
    if not total["n"]:
        return {}, [], 0.5
    top = None
    for k in (0, 2):
        # twice the log-likelihood ratio of "the word's documents have another rate than all"
        rate, m = max(total[f"p{k}"], 0.5) / (total["n"] + 1), F.col("df")
        hits = F.col(f"p{k}") + F.lit(rate)
        g = hits * F.log(hits / (m + 1) / rate) + (m + 1 - hits) * F.log((m + 1 - hits) / (m + 1) / (1 - rate))
        part = stats.where((m >= least_docs) & (hits / (m + 1) > rate)).orderBy(g.desc(), "word").limit(words // 2).select("word")
        top = part if top is None else top.union(part)
    place = {bytes(r["word"]): i for i, r in enumerate(top.distinct().orderBy("word").collect())}
    data = rows.mapInArrow(_vectors(place), "h bigint, y array<bigint>, x array<double>").orderBy("h").collect()
    x, ys = np.array([r["x"] for r in data]), np.array([r["y"] for r in data], float)
    return place, *fit_chain(x, ys, np.arange(len(x)) % folds)


def _apply(model):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, chain, _ = model.value
        for b in batches:
            texts, out = b.column("text").to_pylist(), [[] for _ in CATEGORIES]
            for i in range(0, len(texts), 512):
                part = texts[i : i + 512]
                x = features(part, place)
                for k in range(len(CATEGORIES)):
                    p = score(x, chain[k]) if chain else np.zeros(len(part))
                    out[k] += p.tolist()
                    x = np.c_[x, p]
            rest = [n for n in b.schema.names if n != "text"]
            yield pa.record_batch([*(b.column(n) for n in rest), *(pa.array(p, pa.float64()) for p in out)], names=[*rest, *(f"p_{c}" for c in CATEGORIES)])

    return run


def classify(docs: DataFrame, model: tuple[dict[bytes, int], list[np.ndarray], float], limit: float | None = None) -> DataFrame:
    """``docs(text, ...)`` with a probability of each category and toxic (p_toxic >= limit, the model's if not given) in place of text.

    Null and empty texts have no words and the probabilities of that; rows stay as they are,
    texts of any length are read whole, an empty table gives an empty table.  Columns of the input with a name of the result are replaced.
    """
    docs = bounded_batches(docs).drop("toxic", *(f"p_{c}" for c in CATEGORIES))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in docs.schema if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"p_{c} double" for c in CATEGORIES])
    return docs.select(*[f"`{f.name}`" for f in rest], "text").mapInArrow(_apply(shared), schema).withColumn("toxic", F.col("p_toxic") >= (model[2] if limit is None else limit))
