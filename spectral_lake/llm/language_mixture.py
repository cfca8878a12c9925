"""Language identification as mixture inference.

Each language is a distribution over character trigrams (letters in lower case, anything else
one space), counted over all training texts.  A document is a mixture of languages: expectation
maximisation finds the proportions that make its trigrams most likely.  How many languages
the mixture has is decided by penalised likelihood: a language is added while it raises the
log-likelihood by more than ``penalty * log(trigrams)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, mix

_U = np.uint64
CELLS = 1 << 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigrams(text: str | None) -> np.ndarray:
    """The cell of each trigram of a text, repeats included; none if it has no letter."""
    if not text:
        return np.empty(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, np.int64)
    c = np.where(letter, c, 32)
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
    c = np.concatenate([[32], c[1:] if c[0] == 32 else c, [] if c[-1] == 32 else [32]]).astype(_U)
    h = mix((c[:-2] << _U(42)) ^ (c[1:-1] << _U(21)) ^ c[2:])
    return (h >> _U(48)).astype(np.int64)


@lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            if lang not in total:
                total[lang] = np.zeros(CELLS, np.int64)
            total[lang] += np.bincount(trigrams(t), minlength=CELLS) if len(t) > 20_000 else 0
            if len(t) <= 20_000:
                np.add.at(total[lang], trigrams(t), 1)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "cell", "n"])


def train(labelled: DataFrame, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram distributions, from every row of ``labelled(text, lang)``.

    Counting is distributed; the driver gets a table of at most CELLS rows a language.
    """
    rows = bounded_batches(labelled).where("text is not null and lang is not null").select("text", "lang").mapInArrow(_count, "lang string, cell bigint, n bigint")
    counts = rows.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique().tolist())
    p = np.full((len(langs), CELLS), smooth)
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        p[i, own["cell"].to_numpy()] += own["n"].to_numpy()
    return langs, p / p.sum(axis=1, keepdims=True) if langs else p


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``p`` (trigram probabilities) given counts ``n``, and the log-likelihood."""
    w = np.full(len(p), 1 / len(p))
    for _ in range(rounds if len(p) > 1 else 0):
        r = p * w[:, None]
        w = (r * (n / r.sum(axis=0))).sum(axis=1)
        w /= w.sum()
    return w, float(n @ np.log(w @ p))


def infer(p: np.ndarray, cells: np.ndarray, penalty: float = 1.5) -> tuple[np.ndarray, int, float]:
    """(proportions over all languages, main language, score) of a text with these trigrams."""
    at, n = np.unique(cells, return_counts=True)
    q, total = p[:, at], len(cells)
    single = np.log(q) @ n
    best = int(single.argmax())
    sure = 1 / np.exp(np.clip(single - single[best], -700, 0)).sum()
    share = np.zeros(len(p))
    share[best] = 1.0
    if len(p) > 1:
        chosen, level = [best], single[best]
        order = [i for i in np.argsort(-mixture(q, n)[0], kind="stable").tolist() if i != best]
        for i in order:
            w, ll = mixture(q[[*chosen, i]], n)
            if ll - level <= penalty * np.log(total + 1):
                break
            chosen, level = [*chosen, i], ll
            share[:] = 0
            share[chosen] = w
    main = int(share.argmax())
    return share, main, float(share[main] * (sure if main == best else 1.0))


def _predict(model, penalty: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p = model.value
        for b in batches:
            main, score, sets = [], [], []
            for t in b.column("text").to_pylist():
                cells = trigrams(t)
                if not len(cells) or not langs:
                    main.append("und")
                    score.append(0.0)
                    sets.append("")
                    continue
                share, k, s = infer(p, cells, penalty)
                main.append(langs[k])
                score.append(min(1.0, s))
                sets.append(",".join(f"{langs[i]}:{share[i]:.3f}" for i in np.argsort(-share, kind="stable").tolist() if share[i] > 0))
            rest = [x for x in b.schema.names if x != "text"]
            yield pa.record_batch([*(b.column(x) for x in rest), pa.array(main, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], names=[*rest, "lang_pred", "score", "mixture"])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], penalty: float = 1.5) -> DataFrame:
    """``docs(text, ...)`` with lang_pred, score and mixture in place of text.

    A null text, or one without letters, is ``und`` with score 0, as is every text if nothing
    was learned.  Rows stay as they are, repeated ones included; texts of any length are read
    whole; an empty table gives an empty table; columns of the input with a
    name of the result are replaced.
    """
    docs = bounded_batches(docs).drop("lang_pred", "score", "mixture")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in docs.schema if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["lang_pred string", "score double", "mixture string"])
    return docs.select(*[f"`{f.name}`" for f in rest], "text").mapInArrow(_predict(shared, penalty), schema)
