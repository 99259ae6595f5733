"""Toxicity by classifier chains.

Categories are predicted one after another by logistic models over hashed words and beginnings of words, each
present once, twice or four times at least (inflected stems repeat where single forms do not). Each later
model also takes the probabilities of the earlier ones: out-of-fold predictions while it is fitted, so that it
learns from errors as they will be, and the fitted models' own when it scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.llm.labelled import labelled_sample, narrow
from landgrid.llm.tokens import LOWER, MARKS, U64, chunks, mix, raw, span_hashes, split_words

BUCKETS = 1 << 22
PREFIXES = (4, 5, 6, 7, 8)
LEVELS = (1, 2, 4)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every lower-case word and of the first bytes of longer ones."""
    data, offs = raw(texts)
    words = split_words(LOWER[data], offs, MARKS)
    owner, size = words.owner(), words.ends - words.starts
    docs, hashed = [owner], [words.hashes()]
    for k in PREFIXES:
        longer = size > k
        docs.append(owner[longer])
        hashed.append(mix(span_hashes(words.data, words.starts[longer], words.starts[longer] + k) + U64(k)))
    return np.concatenate(docs), (np.concatenate(hashed) % U64(BUCKETS)).astype(np.int64)


def levels(docs: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature): a feature is a bucket and how often it is met at least."""
    slot, count = np.unique(docs * BUCKETS + buckets, return_counts=True)
    parts = [(slot[count >= n] // BUCKETS, slot[count >= n] % BUCKETS * len(LEVELS) + k) for k, n in enumerate(LEVELS)]
    owner, feature = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(owner, kind="stable")
    return owner[order], feature[order]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Linear:
    """A logistic model: weights of chosen features (sorted), of the earlier probabilities, and an offset."""

    chosen: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    offset: float

    def predict(self, docs: np.ndarray, found: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        score = np.zeros(n)
        if len(self.chosen):
            at = np.minimum(np.searchsorted(self.chosen, found), len(self.chosen) - 1)
            score = np.bincount(docs, np.where(self.chosen[at] == found, self.weights[at], 0.0), n)
        return _sigmoid(score + earlier @ self.chain + self.offset)


def fit_linear(docs: np.ndarray, found: np.ndarray, labels: np.ndarray, earlier: np.ndarray, ridge: float = 0.02) -> Linear:
    """Newton steps over the features that tell most, by the size of their log-odds against its error: one for
    four documents."""
    n, positive = len(labels), labels.sum()
    most = max(16, n // 4)
    names, place = np.unique(found, return_inverse=True)
    chosen = np.zeros(0, np.int64)
    if 0 < positive < n:
        there, all_ = np.bincount(place, labels[docs]), np.bincount(place)
        a, b = there + 0.5, all_ - there + 0.5
        c, d = positive - there + 0.5, n - positive - (all_ - there) + 0.5
        strength = np.abs(np.log(a * d / (b * c))) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        strength[all_ < 3] = 0
        best = np.argsort(-strength, kind="stable")[:most]
        chosen = np.sort(best[strength[best] > 0])
    column = np.full(max(len(names), 1), -1)
    column[chosen] = np.arange(len(chosen))
    kept = column[place] >= 0
    rows, columns, m = docs[kept], column[place[kept]], len(chosen)
    dense = np.column_stack([earlier, np.ones(n)])
    penalty = np.full(m + dense.shape[1], ridge)
    penalty[-1] = 1e-3

    def times(w):
        return np.bincount(rows, w[columns], n) + dense @ w[m:]

    def back(r):
        return np.concatenate([np.bincount(columns, r[rows], m), dense.T @ r])

    w = np.zeros(len(penalty))
    for _ in range(25):
        p = _sigmoid(times(w))
        slope = back(labels - p) - penalty * w
        bend = p * (1 - p) + 1e-9
        step, rest = np.zeros(len(w)), slope.copy()
        way, size = rest.copy(), rest @ rest
        for _ in range(40):  # conjugate gradients for the Newton step
            if size < 1e-12:
                break
            turned = back(bend * times(way)) + penalty * way
            pace = size / (way @ turned)
            step += pace * way
            rest -= pace * turned
            size, old = rest @ rest, size
            way = rest + size / old * way
        w += step * min(1, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return Linear(names[chosen], w[:m], w[m:-1], float(w[-1]))


def fit_chain(docs: np.ndarray, found: np.ndarray, labels: np.ndarray, folds: int = 4) -> list[Linear]:
    """One model per column of ``labels``, in order."""
    n = len(labels)
    fold = np.arange(n) % folds
    earlier, chain = np.zeros((n, 0)), []
    for k in range(labels.shape[1]):
        chain.append(fit_linear(docs, found, labels[:, k], earlier))
        out = np.zeros(n)
        for f in range(folds if k + 1 < labels.shape[1] else 0):
            ids = np.cumsum(fold != f) - 1
            fits = fold[docs] != f
            model = fit_linear(ids[docs[fits]], found[fits], labels[fold != f, k], earlier[fold != f])
            out[fold == f] = model.predict(docs, found, n, earlier)[fold == f]
        earlier = np.column_stack([earlier, out])
    return chain


class ToxicityChain:
    """Chain over ``categories``, pairs of a name and an SQL expression of 0 or 1 over the label table.

    Fitted on at most ``sample`` labelled documents, the ids of least hash. Without labels all probabilities are
    0, and a category with one class only keeps its share. A null text counts as empty; every row is scored on
    its text alone; extra columns are ignored.
    """

    CATEGORIES = (("abusive", "toxic"), ("abusive_prose", "int(toxic = 1 and quality = 1)"),
                  ("abusive_junk", "int(toxic = 1 and quality = 0)"))

    def __init__(self, docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, str]] = CATEGORIES, sample: int = 6000):
        self.names = [n for n, _ in categories]
        rows = labelled_sample(docs, labels, dict(categories), sample)
        names = self.names

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                owner, found = levels(*features(batch.column("text")))
                cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                blobs = [found[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(n) for n in names), pa.array(blobs, pa.binary())],
                                                 ["doc_id", *names, "words"])

        schema = f"doc_id long, {', '.join(f'{n} int' for n in names)}, words binary"
        found = sorted(rows.mapInArrow(encode, schema).collect(), key=lambda r: r["doc_id"])  # bounded by the sample
        self.chain = []
        if found:
            words = [np.frombuffer(bytes(r["words"]), np.int32) for r in found]
            owner = np.repeat(np.arange(len(found)), [len(w) for w in words])
            met = np.concatenate(words)
            names_, count = np.unique(met, return_counts=True)
            often = np.isin(met, names_[count >= 3])
            self.chain = fit_chain(owner[often], met[often].astype(np.int64), np.array([[r[n] for n in names] for r in found], float))

    def scored(self, docs: DataFrame) -> DataFrame:
        """``docs`` with one probability per category."""
        chain, names = self.chain, self.names

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            used = np.zeros(BUCKETS, bool)
            for model in chain:
                used[model.chosen // len(LEVELS)] = True
            for batch in chunks(batches):
                n = batch.num_rows
                owner, buckets = features(batch.column("text"))
                told = used[buckets]
                owner, found = levels(owner[told], buckets[told])
                earlier = np.zeros((n, 0))
                for model in chain:
                    earlier = np.column_stack([earlier, model.predict(owner, found, n, earlier)])
                if not chain:
                    earlier = np.zeros((n, len(names)))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(earlier[:, k]) for k in range(len(names)))],
                                                 [*batch.schema.names, *names])

        kept = docs.drop(*names)
        return kept.mapInArrow(scan, T.StructType([*kept.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))

    def judge(self, docs: DataFrame) -> DataFrame:
        """(doc_id, toxic, score, one probability per category): toxic where the first category is likelier than not."""
        first = F.col(self.names[0])
        return self.scored(narrow(docs)).select("doc_id", (first >= 0.5).cast("int").alias("toxic"), first.alias("score"), *self.names)
