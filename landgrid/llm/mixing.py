"""Mixing documents to target weights of domains, by soft membership.

A classifier learned from a labelled table gives every document a posterior over domains. A document counts
towards a domain by its tokens times the posterior. Nonnegative rates of documents are fitted by projected
gradient steps on the squared gap between expected token totals and targets, each domain's step scaled by its
share of the curvature. All documents take the same small vector of steps, so a step is one scan that sums one number per
domain; rates are replayed from the steps and never stored between scans.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.llm.labelled import labelled_sample, narrow
from landgrid.llm.store import keep
from landgrid.llm.tokens import LOWER, MARKS, U64, chunks, mix, raw, span_hashes, split_words

HASHED = 1024


def profile(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word endings of each text, scaled to length one, and its number of words."""
    data, offs = raw(texts)
    words = split_words(LOWER[data], offs, MARKS)
    owner = words.owner()
    tail = mix(span_hashes(words.data, np.maximum(words.starts, words.ends - 3), words.ends) + U64(3))
    slot = np.concatenate([words.hashes(), tail]) % U64(HASHED)
    out = np.bincount(np.tile(owner, 2) * HASHED + slot.astype(np.int64), minlength=len(words.counts) * HASHED)
    out = np.sqrt(out.reshape(-1, HASHED).astype(np.float32))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6), split_words(data, offs).counts


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_domains(x: np.ndarray, domain: np.ndarray, n: int, steps: int = 150, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of a softmax classifier, by accelerated gradient steps."""
    w, b = np.zeros((x.shape[1], n)), np.zeros(n)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    want = np.eye(n)[domain]
    for _ in range(steps):
        gap = (_softmax(x @ (w + 0.9 * vw) + b + 0.9 * vb) - want) / len(x)
        vw = 0.9 * vw - 4.0 * (x.T @ gap + ridge * w)
        vb = 0.9 * vb - 4.0 * gap.sum(axis=0)
        w, b = w + vw, b + vb
    return w, b


def replay(posterior: np.ndarray, steps: np.ndarray, least: float) -> np.ndarray:
    """Rates after the given steps, from 1 each."""
    rate = np.ones(len(posterior))
    for step in steps:
        rate = np.maximum(least, rate - posterior @ step)
    return rate


class SoftMixer:
    """Rates of ``docs`` so that expected tokens of each domain meet its target.

    ``domains`` is a labelled table (doc_id, domain), of which at most ``sample`` documents are learned from.
    ``weights`` gives the target share of domains (equal shares without it; a domain it does not name gets none).
    The total is the smallest at which no domain needs fewer tokens than it has, times ``room``. ``least`` bounds rates
    below: at 0 documents may go, at 1 they are only repeated. Null text is empty and has no tokens; such a document,
    and all of them without a labelled table, keep a posterior by the offsets alone or equal shares. Rows that repeat
    are rated alike; extra columns pass through.

    Steps end when totals are within ``close`` of the largest target, or when after 60 of them the last 20 have lowered
    the distance by less than a fiftieth, as when rates at their bound leave targets out of reach. ``gap`` is the distance
    left, as a share of the largest target; a warning tells of one above ``close``.
    """

    def __init__(self, docs: DataFrame, domains: DataFrame, weights: Mapping[str, float] | None = None, least: float = 0.0,
                 room: float = 1.0, sample: int = 4000, close: float = 1e-3):
        self.docs, self.least = docs, least
        named = domains.select("doc_id", "domain").where("domain is not null")
        # All of them, since the model has a column for each: labels are dozens or hundreds by nature.
        names = sorted(r["domain"] for r in named.select("domain").distinct().collect())
        self.names = names or ["all"]
        codes = docs.sparkSession.createDataFrame(
            list(zip(names, range(len(names)))), T.StructType([named.schema["domain"], T.StructField("code", T.IntegerType())]))
        code = named.join(F.broadcast(codes), "domain").select("doc_id", F.col("code").alias("domain"))
        rows = labelled_sample(docs, code, {"domain": "domain"}, sample)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                x, _ = profile(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("domain"), pa.array([r.tobytes() for r in x], pa.binary())],
                                                 ["doc_id", "domain", "x"])

        found = sorted(rows.mapInArrow(encode, "doc_id long, domain int, x binary").collect(), key=lambda r: r["doc_id"])  # bounded by the sample
        self.model = (np.zeros((HASHED, len(self.names))), np.zeros(len(self.names)))
        if found:
            x = np.frombuffer(b"".join(bytes(r["x"]) for r in found), np.float32).reshape(-1, HASHED).astype(float)
            self.model = fit_domains(x, np.array([r["domain"] for r in found]), len(self.names))
        self.member = keep(self.posteriors(narrow(docs)).drop("text"), "members")
        share = np.array([(weights or dict.fromkeys(self.names, 1.0)).get(n, 0.0) for n in self.names], float)
        self.share = share / max(share.sum(), 1e-12)
        self.steps = self._fit(room, close)

    def posteriors(self, docs: DataFrame) -> DataFrame:
        """``docs`` with n_tokens and posterior."""
        w, b = self.model

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                x, n = profile(batch.column("text"))
                p = _softmax(x @ w + b)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), flat], [*batch.schema.names, "n_tokens", "posterior"])

        kept = docs.drop("n_tokens", "posterior")
        return kept.mapInArrow(scan, T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType()),
                                                   T.StructField("posterior", T.ArrayType(T.DoubleType()))]))

    def _sums(self, steps: list[np.ndarray]) -> np.ndarray:
        """Expected tokens of each domain after the steps."""
        width, least, taken = len(self.names), self.least, np.array(steps).reshape(-1, len(self.names))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                if batch.num_rows:
                    p = batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    n = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
                    total += p.T @ (n * replay(p, taken, least))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total)], ["k", "v"])

        # One row per task and domain, summed in Spark.
        rows = self.member.select("n_tokens", "posterior").mapInArrow(scan, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(width)
        for r in rows:
            out[r["k"]] = r["v"]
        return out

    def _fit(self, room: float, close: float) -> list[np.ndarray]:
        have = self._sums([])
        wanted = self.share > 0
        self.reached, self.target, self.gap = have, np.zeros(len(have)), 0.0
        if not have.sum():
            return []
        self.target = room * self.share * float(np.max(have[wanted] / self.share[wanted]))
        # A row of sums of posterior products adds up to the tokens at rate 1, since posteriors add up to 1. The
        # diagonal of these bounds the curvature, so that each step lowers the squared gap.
        bend = np.maximum(have, 1e-9)
        steps: list[np.ndarray] = []
        left = [np.linalg.norm((have - self.target) / np.sqrt(bend))]
        while np.abs(have - self.target).max() > close * self.target.max() and (len(left) <= 60 or left[-1] < 0.98 * left[-21]):
            steps.append((have - self.target) / bend)
            have = self._sums(steps)
            left.append(np.linalg.norm((have - self.target) / np.sqrt(bend)))
        self.reached, self.gap = have, float(np.abs(have - self.target).max() / self.target.max())
        if self.gap > close:
            warnings.warn(f"domains miss their targets by up to {self.gap:.3g} of the largest one with rates of {self.least} at least")
        return steps

    def rated(self, seed: int = 5) -> DataFrame:
        """``docs`` with n_tokens, posterior, domain (the likeliest), rate, and copies: the rate rounded up or down by
        a hash of the id, so that copies meet rates on average."""
        steps, least, names = np.array(self.steps).reshape(-1, len(self.names)), self.least, self.names

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
                best = np.array(names, object)[p.argmax(axis=1)] if len(p) else np.zeros(0, object)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(replay(p, steps, least))],
                                                 [*batch.schema.names, "domain", "rate"])

        rows = self.posteriors(self.docs.drop("domain", "rate", "copies"))
        out = rows.mapInArrow(scan, T.StructType([*rows.schema.fields, T.StructField("domain", T.StringType()), T.StructField("rate", T.DoubleType())]))
        draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
        return out.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("long"))

    def mixed(self) -> DataFrame:
        """``docs`` with every row as often as its copies say."""
        return self.rated().withColumn("k", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(
            F.array().cast("array<bigint>")))).select(*self.docs.columns)
