"""Resampling of documents towards a target collection by the importance of hashed word n-grams.

A 256-byte table lower-cases A-Z and blanks every other ASCII byte than letters and digits; bytes of longer UTF-8
sequences stay. ``bytes.split`` yields the words, and the CRC of an n-gram is that of the shorter one extended by a
space and the next word. Counters of buckets, one per task, are added up by one aggregation; the gain of a bucket is
the scaled log ratio of its share in the target and in the documents. A document's weight is its mean gain; weights plus
Gumbel noise of its id draw documents without replacement.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.llm.labelled import narrow
from landgrid.llm.store import keep
from landgrid.llm.tokens import CHUNK_BYTES, LOWER, MARKS, chunks, segments
from landgrid.operators.ranking import exact_rank

#: Lower-case letters, digits and bytes from 128 on as they are, A-Z lower-cased, the rest blank.
TABLE = bytes(0x20 if MARKS[b] else int(LOWER[b]) for b in range(256))


def features(text: bytes, longest: int, part_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """(n, CRCs of runs of n words) of a text for n from 1 to ``longest``, part by part."""
    carried: list[bytes] = []
    for part in segments(text.translate(TABLE), part_bytes):
        words = carried + part.split()
        crcs: list[int] = []
        for n in range(1, min(longest, len(words)) + 1):
            crcs = list(map(zlib.crc32, words[n - 1:], map(zlib.crc32, repeat(b" "), crcs))) if crcs else list(map(zlib.crc32, words))
            fresh = max(len(carried) - n + 1, 0)  # earlier runs ended in the part before
            yield n, np.array(crcs[fresh:], np.uint32)
        carried = words[max(len(words) - longest + 1, 0):]


class ImportanceResampler:
    """Draws documents by ``hash of features`` importance towards ``target`` texts.

    ``docs`` needs doc_id and text, ``target`` a text. Runs of 1 to ``longest`` words, repeats counted, are the features; a
    feature's bucket is its CRC modulo ``buckets``. A bucket with s of S document features and t of T target
    features gains floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))). Of the documents with
    ``least_words`` words at least, ``percent`` per cent (rounded down) are drawn.

    Null and empty texts have no feature, weight 0, and are not drawn unless ``least_words`` is 0. Equal texts have equal
    weights; ties of score go to the smaller id. Rows that repeat an id are documents of their own with the same
    noise, and ties among them fall either way. The noise of a null id is that of an empty one, and null ids come first in ties. Empty
    tables on either side count as no feature. Other columns are ignored.

    The gains are ``buckets`` numbers whatever the size of the corpus, so they travel with the tasks. Texts are read twice
    and never shuffled; very long ones are worked in parts of a megabyte.
    """

    def __init__(self, docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 2, seed: int = 7,
                 least_words: int = 20, percent: int = 25):
        if buckets < 1 or buckets > 1 << 20 or longest < 1:
            raise ValueError("between 1 and 2^20 buckets and runs of one word at least")
        self.docs, self.target = narrow(docs), target.select(target["text"].cast("string").alias("text"))
        self.buckets, self.longest, self.seed, self.least_words, self.percent = buckets, longest, seed, least_words, percent

    def counts(self, texts: DataFrame) -> DataFrame:
        """(bucket, n): features in each bucket that has any."""
        buckets, longest = self.buckets, self.longest

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter[int] = Counter()
            for batch in chunks(batches):
                for text in batch.column("text").to_pylist():
                    for _, crcs in features((text or "").encode(), longest):
                        found.update((crcs % buckets).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], ["bucket", "n"])

        return texts.select("text").mapInArrow(scan, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))

    def gains(self) -> DataFrame:
        """(bucket, s, t, gain) of every bucket, also those without a feature."""
        every = self.docs.sparkSession.range(self.buckets).select(F.col("id").cast("int").alias("bucket"))
        both = self.counts(self.docs).withColumnRenamed("n", "s").join(
            self.counts(self.target).withColumnRenamed("n", "t"), "bucket", "full")
        held = keep(every.join(both, "bucket", "left").fillna(0, ["s", "t"]), "buckets")
        s_all, t_all = held.agg(F.sum("s"), F.sum("t")).first()
        top = (F.col("t") + 1).cast("double") * F.lit(float(s_all + self.buckets))
        low = (F.col("s") + 1).cast("double") * F.lit(float(t_all + self.buckets))
        return held.select("bucket", "s", "t", F.floor(1000 * F.ln(top / low)).alias("gain"))

    def scored(self) -> DataFrame:
        """(doc_id, n_words, n_features, weight, score) of every document."""
        buckets, longest = self.buckets, self.longest
        known = self.gains().select("bucket", "gain").toArrow()
        gain = np.zeros(buckets, np.int64)
        gain[known.column("bucket").to_numpy()] = known.column("gain").to_numpy()

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                words, sizes, weights = [], [], []
                for text in batch.column("text").to_pylist():
                    n_words = size = total = 0
                    for n, crcs in features((text or "").encode(), longest):
                        n_words += len(crcs) if n == 1 else 0
                        size += len(crcs)
                        total += int(gain[crcs % buckets].sum())
                    words.append(n_words)
                    sizes.append(size)
                    weights.append(total // size if size else 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in (words, sizes, weights))],
                                                 ["doc_id", "n_words", "n_features", "weight"])

        rows = self.docs.mapInArrow(scan, "doc_id long, n_words long, n_features long, weight long")
        drawn = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
        h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
        noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
        return rows.withColumn("score", F.col("weight") + noise)

    def drawn(self) -> DataFrame:
        """``scored`` rows with ``rank``: 1 for the first document drawn, null for those left."""
        rows = keep(self.scored(), "scored")
        able = rows.where(F.col("n_words") >= self.least_words).withColumn("tie_", F.monotonically_increasing_id())
        ranked = exact_rank(able, [], [F.desc("score"), F.asc("doc_id"), F.asc("tie_")])
        take = F.floor(F.lit(self.percent) * F.col("group_n") / 100)
        return ranked.select(*rows.columns, F.when(F.col("rk") <= take, F.col("rk")).alias("rank")).unionByName(
            rows.where(F.col("n_words") < self.least_words).withColumn("rank", F.lit(None).cast("long")))
