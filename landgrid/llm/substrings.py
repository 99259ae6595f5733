"""Substring dedup by de Bruijn compaction.

Token k-mers of ``window`` words are the edges of a graph, the k - 1 words between two of them its nodes. Only edges that occur in
two documents matter. They are found in two steps, so that the edges of unrepeated text are never shuffled:
every window is represented by its least ``seed``-word hash (neighbours mostly share it), seeds that two
documents hold mark the windows worth emitting, and those become edges. A node is nonbranching when all
occurrences of the edge before it go on with one word and all of the edge after it come from one word; the
occurrences of such edges move in step. Edges are laid along the coordinates of their first occurrence, cut
at branching nodes into paths, and the paths joined back to the occurrences of their first edge: a few
spans per document instead of a row per window. The spans are then checked word by word: all occurrences of a
path must have the same 128-bit digest of their bytes; paths that fail, by a collision of hashes, are taken
apart into windows that are compared by digest.

Documents of equal word sequences enter the graph once, by their smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgrid.llm.runs import shared_runs
from landgrid.llm.store import keep, packed, unpacked
from landgrid.llm.tokens import U64, Words, chunks, longs, mix, ngrams, raw, split_words, window_starts

SPAN = "array<struct<start:int,size:int,path:long,same:boolean>>"


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def _words(batch: pa.RecordBatch) -> Words:
    return split_words(*raw(batch.column("text")))


def _sequence_names(words: Words, hashed: np.ndarray) -> np.ndarray:
    """128 bits per document that name its word sequence."""
    place = (np.arange(len(hashed)) - np.repeat(words.first[:-1], words.counts)).astype(U64)
    out = np.zeros((len(words.counts), 2), U64)
    for k, salt in enumerate((U64(0x2545F4914F6CDD1D), U64(0x9FB21C651E98DF25))):
        total = np.zeros(len(hashed) + 1, U64)
        np.cumsum(mix(hashed ^ mix(place * salt + U64(k + 1))), out=total[1:])
        out[:, k] = total[words.first[1:]] - total[words.first[:-1]]
    return out


def least_seeds(hashed: np.ndarray, words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (first word), the place of each one's least seed, and the seed's hash at every place."""
    grams = ngrams(hashed, seed)
    at = window_starts(words.first, window)
    least, place = grams[at], at.copy()
    for k in range(1, window - seed + 1):
        here = grams[at + k]
        less = here < least
        least = np.where(less, here, least)
        place = np.where(less, at + k, place)
    return at, place, grams


class SubstringDedup:
    """Spans of ``window`` or more words that a document shares with one of smaller id.

    Words are kept as they are. A null or empty text has no words; documents of fewer words than a window
    hold none. Rows with null doc_id take part in nothing and keep all their words; rows that repeat a
    doc_id are one document (the smallest text); extra columns are ignored.
    """

    def __init__(self, docs: DataFrame, window: int = 13, seed: int = 5):
        self.window, self.seed = window, seed
        self.docs = _narrow(docs)
        self.names = keep(self._names(), "names")
        twice = self.names.groupBy("doc_id").count().where("count > 1").select("doc_id")
        if not twice.isEmpty():
            one = self.docs.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
            self.docs = self.docs.join(twice, "doc_id", "left_anti").unionByName(one)
            self.names = keep(self._names(), "names")

    def _names(self) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                words = _words(batch)
                name = _sequence_names(words, words.hashes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(words.counts), longs(name[:, 0]), longs(name[:, 1])],
                    ["doc_id", "n_words", "seq_a", "seq_b"])

        return self.docs.where("doc_id is not null").mapInArrow(scan, "doc_id long, n_words long, seq_a long, seq_b long")

    def first_copies(self) -> DataFrame:
        """(doc_id, rep): the smallest document of equal words, for documents of a window or more."""
        long = self.names.where(F.col("n_words") >= self.window)
        rep = long.groupBy("seq_a", "seq_b", "n_words").agg(F.min("doc_id").alias("rep"))
        return long.join(rep, ["seq_a", "seq_b", "n_words"]).select("doc_id", "rep").distinct()

    def _seeds(self) -> DataFrame:
        window, seed = self.window, self.seed

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for batch in chunks(batches):
                words = _words(batch)
                hashed = words.hashes()
                names = list(map(tuple, _sequence_names(words, hashed).tolist()))
                fresh = np.array([not (n in seen or seen.add(n)) for n in names], bool)
                at, place, grams = least_seeds(hashed, words, window, seed)
                if not len(at):
                    continue
                owner = np.searchsorted(words.first, at, "right") - 1
                new = np.ones(len(at), bool)
                new[1:] = place[1:] != place[:-1]
                new &= fresh[owner]
                owner, seeds = owner[new], mix(grams[place[new]])
                once = np.unique(np.stack([owner.astype(U64), seeds]), axis=1) if len(seeds) else np.zeros((2, 0), U64)
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([longs(once[1]), pa.array(ids[once[0].astype(np.int64)])], ["seed", "doc"])

        return self.docs.where("doc_id is not null").mapInArrow(scan, "seed long, doc long")

    def marks(self, copies: DataFrame) -> DataFrame:
        """(doc_id, marks): seeds that another document holds too, by first copies."""

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in shared_runs(batches, "seed", "doc"):
                yield batch.select(["doc", "seed"])

        hits = self._seeds().repartition("seed").sortWithinPartitions("seed", "doc").mapInArrow(scan, "doc long, seed long")
        return hits.join(copies.withColumnRenamed("doc_id", "doc"), "doc").groupBy(F.col("rep").alias("doc_id")).agg(
            F.collect_set("seed").alias("marks"))

    def edges(self, marks: DataFrame) -> DataFrame:
        """(edge, doc, pos, before, after) of the windows whose seed is marked; before and after are the words
        around, 0 at the ends of a text."""
        window, seed = self.window, self.seed

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in unpacked(batches):
                words = _words(batch)
                hashed = words.hashes()
                at, place, grams = least_seeds(hashed, words, window, seed)
                if not len(at):
                    continue
                column = batch.column("marks")
                sizes = column.value_lengths().to_numpy(zero_copy_only=False)
                own = mix(np.arange(batch.num_rows).astype(U64) + U64(1))
                marks_ = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).view(U64) ^ np.repeat(own, sizes)
                owner = np.searchsorted(words.first, at, "right") - 1
                at = at[np.isin(mix(grams[place]) ^ own[owner], marks_)]
                owner = np.searchsorted(words.first, at, "right") - 1
                around = np.concatenate([[U64(0)], hashed | U64(1), [U64(0)]])
                # 31 bits of a neighbour, the lowest one always set; 0 where the text ends.
                before = np.where(at == words.first[owner], U64(0), around[at] & U64(0x7FFFFFFF)).astype(np.int32)
                after = np.where(at + window == words.first[owner + 1], U64(0), around[at + window + 1] & U64(0x7FFFFFFF)).astype(np.int32)
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                keys = longs(ngrams(hashed, window)[at])
                for a in range(0, len(at), 1 << 17):
                    cut = slice(a, a + (1 << 17))
                    yield pa.RecordBatch.from_arrays(
                        [keys[cut], pa.array(ids[owner[cut]]), pa.array((at[cut] - words.first[owner[cut]]).astype(np.int32)),
                         pa.array(before[cut]), pa.array(after[cut])], ["edge", "doc", "pos", "before", "after"])

        return packed(self.docs).join(marks, "doc_id").mapInArrow(scan, "edge long, doc long, pos int, before int, after int")

    @staticmethod
    def repeated(edges: DataFrame) -> DataFrame:
        """Edges of two documents or more, with the coordinates of their first occurrence."""

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in shared_runs(batches, "edge", "doc"):
                yield batch.select(["edge", "doc", "pos", "before", "after", "head_doc", "head_pos"])

        return edges.repartition("edge").sortWithinPartitions("edge", "doc", "pos").mapInArrow(
            scan, "edge long, doc long, pos int, before int, after int, head_doc long, head_pos int")

    @staticmethod
    def paths(repeated: DataFrame) -> DataFrame:
        """(path, head_doc, head_pos, size): maximal nonbranching paths, named by their first edge; size in edges."""
        nodes = repeated.groupBy("edge", "head_doc", "head_pos").agg(
            F.count("*").alias("n"), F.min("before").alias("b0"), F.max("before").alias("b1"),
            F.min("after").alias("a0"), F.max("after").alias("a1"))
        along = Window.partitionBy("head_doc").orderBy("head_pos")
        step = nodes.withColumns({"one_in": F.expr("b0 = b1 and b0 <> 0"), "one_out": F.expr("a0 = a1 and a0 <> 0")})
        joined = ((F.lag("head_pos").over(along) == F.col("head_pos") - 1) & F.lag("one_out").over(along)
                  & F.col("one_in") & (F.lag("n").over(along) == F.col("n")))
        cut = step.select("edge", "head_doc", "head_pos", F.when(joined, 0).otherwise(1).alias("first"))
        runs = cut.withColumn("k", F.sum("first").over(along))
        return runs.groupBy("head_doc", "k").agg(
            F.max(F.when(F.col("first") == 1, F.col("edge"))).alias("path"), F.min("head_pos").alias("head_pos"),
            F.count("*").cast("int").alias("size")).select("path", "head_doc", "head_pos", "size")

    @staticmethod
    def spans(repeated: DataFrame, paths: DataFrame) -> DataFrame:
        """(doc, start, size, path, same): occurrences of paths; ``same`` in the document of the first one."""
        starts = repeated.select(F.col("edge").alias("path"), "doc", "pos")
        return starts.join(paths.select("path", "head_doc", "size"), "path").select(
            "doc", F.col("pos").alias("start"), "size", "path", (F.col("doc") == F.col("head_doc")).alias("same"))

    def _cut(self, docs: DataFrame, spans: DataFrame, copies: DataFrame) -> DataFrame:
        """Documents without the words that their spans cover, and the digest of every span."""
        window = self.window
        lists = spans.groupBy(F.col("doc").alias("doc_id")).agg(
            F.collect_list(F.struct("start", "size", "path", "same")).alias("spans"))
        copy = copies.where("doc_id <> rep").select("doc_id", F.lit(True).alias("copy"))
        # Null ids meet nothing.
        rows = packed(docs).join(lists.join(copy, "doc_id", "full"), "doc_id", "left").select("doc_id", "size", "packed", "copy", F.col("spans").cast(SPAN))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in unpacked(batches):
                n, gone, sha, found = [], [], [], []
                texts = batch.column("text").to_pylist()
                for text, copy, spans in zip(texts, batch.column("copy").to_pylist(), batch.column("spans").to_pylist()):
                    words = text.split()
                    cover = np.zeros(len(words) + 1, np.int32)
                    seen = []
                    for s in spans or ():
                        a, b = s["start"], min(len(words), s["start"] + s["size"] + window - 1)
                        digest = hashlib.blake2b(b" ".join(words[a:b]), digest_size=16).digest()
                        seen.append({"path": s["path"], "digest": digest})
                        if not s["same"]:
                            cover[a] += 1
                            cover[b] -= 1
                    away = np.cumsum(cover[:-1]) > 0
                    if copy:
                        away[:] = True
                    kept = words if not away.any() else [w for w, x in zip(words, away.tolist()) if not x]
                    n.append(len(words))
                    gone.append(len(words) - len(kept))
                    sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    found.append(seen)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()),
                     pa.array(found, pa.list_(pa.struct([("path", pa.int64()), ("digest", pa.binary())])))],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "digests"])

        return rows.mapInArrow(scan, "doc_id long, n_words long, n_removed long, kept_sha256 string, "
                                     "digests array<struct<path:long,digest:binary>>")

    def _apart(self, docs: DataFrame, spans: DataFrame) -> DataFrame:
        """Spans of one window each, compared by digest of their words, for paths whose occurrences differ."""
        window = self.window

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                ids, pos, names = [], [], []
                for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                    words = (text or "").encode().split()
                    for i in sorted({i for s in spans for i in range(s["start"], s["start"] + s["size"]) if i + window <= len(words)}):
                        ids.append(doc)
                        pos.append(i)
                        names.append(hashlib.blake2b(b" ".join(words[i:i + window]), digest_size=16).digest())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(names, pa.binary())],
                                                 ["doc", "start", "digest"])

        lists = spans.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "size")).alias("spans"))
        windows = docs.join(lists, "doc_id").mapInArrow(scan, "doc long, start int, digest binary")
        first = windows.groupBy("digest").agg(F.min("doc").alias("head_doc"))
        return windows.join(first, "digest").select(
            "doc", "start", F.lit(1).alias("size"), F.xxhash64("digest").alias("path"), (F.col("doc") == F.col("head_doc")).alias("same"))

    def run(self) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_sha256) of every document."""
        copies = keep(self.first_copies(), "copies")
        marks = keep(self.marks(copies), "marks")
        repeated = keep(self.repeated(self.edges(marks)), "edges")
        paths = self.paths(repeated)
        spans = keep(self.spans(repeated, paths), "spans")
        docs = self.docs
        out = keep(self._cut(docs, spans, copies), "cut")
        seen = out.select("doc_id", F.explode("digests").alias("d")).select("doc_id", "d.path", "d.digest")
        odd = seen.groupBy("path").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("path")
        if not odd.isEmpty():
            wrong = keep(spans.join(odd, "path", "left_semi"), "wrong")
            ids = wrong.select(F.col("doc").alias("doc_id")).distinct()
            hit = docs.join(ids, "doc_id", "left_semi")
            right = spans.join(odd, "path", "left_anti").join(ids.withColumnRenamed("doc_id", "doc"), "doc", "left_semi")
            again = self._cut(hit, right.unionByName(self._apart(hit, wrong)), copies)
            out = out.join(ids, "doc_id", "left_anti").unionByName(again)
        return out.select("doc_id", "n_words", "n_removed", "kept_sha256")
