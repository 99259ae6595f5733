"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, all of its text. Every passage becomes a vector of
surface statistics (shapes of words, punctuation, repetition, hashed words) and, by a learned layer, a
representation h. Gated attention w . (tanh(V h) * sigmoid(U h)) weighs the passages of a document, and a
logistic unit scores their weighted sum. All layers are learned together from the labels of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.llm.labelled import labelled_sample, narrow
from landgrid.llm.tokens import U64, chunks, raw, split_words

PASSAGE = 64
HASHED = 64
KINDS = np.full(256, 3, np.int64)  # 0 capital, 1 digit, 2 punctuation, 3 other, 4 beyond ASCII
KINDS[65:91] = 0
KINDS[48:58] = 1
KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
KINDS[128:] = 4
MARK = np.full(256, -1, np.int64)
MARK[KINDS == 2] = np.arange((KINDS == 2).sum())
MARKS = int((KINDS == 2).sum())
WIDTH = 8 + MARKS + HASHED


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages and the number of passages of each text; an empty text has one of zeros."""
    data, offs = raw(texts)
    words = split_words(data, offs)
    counts = words.counts
    per_doc = np.maximum(1, -(-counts // PASSAGE))
    first_passage = np.cumsum(per_doc) - per_doc
    out = np.zeros((int(per_doc.sum()), WIDTH), np.float32)
    n = len(words.starts)
    if n:
        owner = words.owner()
        passage = first_passage[owner] + (np.arange(n) - words.first[owner]) // PASSAGE
        size = np.bincount(passage, minlength=len(out)).astype(float)
        some = np.maximum(size, 1)
        length = (words.ends - words.starts).astype(float)
        total = np.maximum(np.bincount(passage, length, len(out)), 1)
        kind = KINDS[data]
        for k, kinds in enumerate((0, 1, 2, 4)):
            sums = np.concatenate([[0], np.cumsum(kind == kinds)])
            out[:, k] = np.bincount(passage, sums[words.ends] - sums[words.starts], len(out)) / total
        hashed = words.hashes()
        again = np.zeros(n)
        again[1:] = (hashed[1:] == hashed[:-1]) & (passage[1:] == passage[:-1])
        sort = np.sort((passage.astype(U64) << U64(40)) | (hashed >> U64(24)))
        new = np.ones(n, bool)
        new[1:] = sort[1:] != sort[:-1]
        distinct = np.bincount((sort[new] >> U64(40)).astype(np.int64), minlength=len(out))
        out[:, 4] = np.bincount(passage, again, len(out)) / some
        out[:, 5] = np.where(size > 0, distinct / some, 0)
        out[:, 6] = np.minimum(total / some / 10, 5)
        out[:, 7] = np.log1p(size) / 4
        marks = np.flatnonzero(kind == 2)
        word = np.searchsorted(words.starts, marks, "right") - 1
        slot = passage[word] * MARKS + MARK[data[marks]]
        out[:, 8:8 + MARKS] = 10 * np.bincount(slot, minlength=len(out) * MARKS).reshape(-1, MARKS) / total[:, None]
        slot = passage * HASHED + (hashed % U64(HASHED)).astype(np.int64)
        out[:, 8 + MARKS:] = 4 * np.bincount(slot, minlength=len(out) * HASHED).reshape(-1, HASHED) / some[:, None]
    return out, per_doc


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class AttentionModel:
    """Weights of the encoder (e, f), the gated attention (v, u, w) and the output (c, d)."""

    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        at = np.cumsum(bags) - bags
        h = np.tanh(x @ p["e"] + p["f"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        a = np.clip((t * g) @ p["w"], -30, 30)
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, at), bags))
        a = a / np.repeat(np.add.reduceat(a, at), bags)
        z = np.add.reduceat(a[:, None] * h, at)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self.forward(x, bags)["y"] if len(bags) else np.zeros(0)

    def gradients(self, x: np.ndarray, bags: np.ndarray, labels: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p, r = self.weights, self.forward(x, bags)
        at = np.cumsum(bags) - bags
        dy = (r["y"] - labels) / len(labels)
        dz = np.repeat(dy[:, None] * p["c"], bags, axis=0)
        da = (dz * r["h"]).sum(axis=1)
        ds = r["a"] * (da - np.repeat(np.add.reduceat(r["a"] * da, at), bags))
        dt = ds[:, None] * p["w"] * r["g"] * (1 - r["t"] ** 2)
        dg = ds[:, None] * p["w"] * r["t"] * r["g"] * (1 - r["g"])
        dh = (r["a"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - r["h"] ** 2)
        out = {"e": x.T @ dh, "f": dh.sum(axis=0), "v": r["h"].T @ dt, "u": r["h"].T @ dg,
               "w": (r["t"] * r["g"]).T @ ds, "c": r["z"].T @ dy, "d": dy.sum()}
        return {k: v + decay * p[k] for k, v in out.items()}


def fit(x: np.ndarray, bags: np.ndarray, labels: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 30,
        batch: int = 128, rate: float = 0.005, decay: float = 1e-4, seed: int = 3) -> AttentionModel:
    """Adam on mini-batches of documents."""
    rng = np.random.default_rng(seed)
    shapes = {"e": (x.shape[1], hidden), "f": (hidden,), "v": (hidden, gate), "u": (hidden, gate), "w": (gate,), "c": (hidden,), "d": ()}
    model = AttentionModel({k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "wc" else np.zeros(s) for k, s in shapes.items()})
    share = np.clip(labels.mean(), 0.01, 0.99)
    model.weights["d"] = np.array(np.log(share / (1 - share)))
    first = np.cumsum(bags) - bags
    m = {k: np.zeros(s) for k, s in shapes.items()}
    v = {k: np.zeros(s) for k, s in shapes.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for some in np.array_split(order, max(1, len(order) // batch)):
            rows = np.concatenate([np.arange(first[i], first[i] + bags[i]) for i in some])
            grads = model.gradients(x[rows].astype(float), bags[some], labels[some], decay)
            step += 1
            pace = rate * (1 - 0.8 * epoch / epochs)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.weights[k] = model.weights[k] - pace * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


class QualityClassifier:
    """Fitted on at most ``sample`` labelled documents whose crc32(doc_id as text) mod 3 is not 1.

    Without labelled rows every score is 0.5, with one class only the share of label 1. A null text counts as
    empty. Every row of the input is scored on its text alone; rows that repeat score alike, extra columns are
    ignored.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, sample: int = 6000):
        rows = labelled_sample(docs, labels, {"label": "quality"}, sample, where=F.crc32(F.col("doc_id").cast("string")) % 3 != 1)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                x, bags = passages(batch.column("text"))
                ends = np.cumsum(bags)
                blobs = [x[b - n:b].tobytes() for b, n in zip(ends, bags)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(blobs, pa.binary())],
                                                 ["doc_id", "label", "x"])

        # Bounded by the sample; sorted, so that the fit is the same every time.
        found = sorted(rows.mapInArrow(encode, "doc_id long, label int, x binary").collect(), key=lambda r: r["doc_id"])
        labels_ = np.array([r["label"] for r in found], float)
        self.model, self.prior = None, float(labels_.mean()) if len(found) else 0.5
        if len(set(labels_)) > 1:
            bags = np.array([len(r["x"]) // (4 * WIDTH) for r in found])
            x = np.frombuffer(b"".join(bytes(r["x"]) for r in found), np.float32).reshape(-1, WIDTH)
            self.model = fit(x, bags, labels_)

    def scored(self, docs: DataFrame) -> DataFrame:
        """``docs`` with score, the probability of label 1."""
        model, prior = self.model, self.prior

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                if model is None:
                    score = np.full(batch.num_rows, prior)
                else:
                    score = model.score(*passages(batch.column("text")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

        kept = docs.drop("score")
        return kept.mapInArrow(scan, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))

    def judge(self, docs: DataFrame) -> DataFrame:
        """(doc_id, held_out, score, predicted) of every row."""
        return self.scored(narrow(docs)).select(
            "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score",
            (F.col("score") >= 0.5).cast("int").alias("predicted"))
