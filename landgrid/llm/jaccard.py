"""N-gram Jaccard join by universe partition and pigeonhole.

Sets of word shingles fall into size bands a factor of 100/percent apart. A band cuts the universe of
shingles into m segments by hash, so a set of the band is m *segment subsets*. Sets x and y with
100 * |x & y| >= percent * |x | y| differ in at most D = (|x| + |y|)(100 - percent)/(100 + percent)
shingles. Give each segment i a tolerance v_i of -1 (unused), 0 (equal) or 1 (at most one shingle apart):
when the v_i + 1 sum to D + 1, at least one segment stays within its tolerance. Every set is indexed in its
own band under all its subsets, and under the one-deletion neighbours of a few designated segments. It
probes its own band and the next larger one, choosing tolerances by cost: the fullest subsets (the rarest
keys) first, subsets that are empty never unless nothing else is left, designated segments raised to 1
where full subsets run short.

Rows of the index are shuffled and sorted by key once and read as a stream of runs, so no key is ever held
in memory. Each run proposes its head to all other members; after these are verified and joined by
union-find, members of one run that are still apart are compared, in blocks of bounded size, by the parity
bits of their sets (every differing shingle flips one bit at most, so more differing bits than differing
shingles allowed rule a pair out), and what passes is verified. Verification takes the whole texts, so hash
collisions of the index cost time only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.llm.graph import components
from landgrid.llm.runs import head_of_runs
from landgrid.llm.store import keep
from landgrid.llm.tokens import U64, chunks, longs, mix, shingle_sets

TOP = 1 << 40
PARITY = 2048


def band_starts(percent: int) -> np.ndarray:
    """Smallest set size of each band; a set and any partner at least as large lie at most one band apart."""
    starts = [1]
    while starts[-1] < TOP:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.array(starts, np.int64)


def tolerated(total: np.ndarray, percent: int) -> np.ndarray:
    """Largest number of differing shingles of two sets that link, by the sum of their sizes."""
    return total * (100 - percent) // (100 + percent)


def segment_counts(starts: np.ndarray, percent: int) -> np.ndarray:
    """Segments of each band: one more than may differ, and a sixteenth to leave costly ones out."""
    most = tolerated(2 * (starts[1:] - 1), percent)
    return most + 1 + most // 16


def designated(m: np.ndarray) -> np.ndarray:
    """How many leading segments of a band are also indexed by one-deletion neighbours."""
    return np.minimum(m, np.maximum(2, -(-m // 8)))


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _keys_in_band(tokens, sizes, band, index, starts, ms, percent):
    """Keys (key, set, probes) of sets in the given band each; ``index``: also the keys that others probe."""
    m = ms[band]
    base = np.cumsum(m) - m
    owner = np.repeat(np.arange(len(sizes)), sizes)
    segment = (tokens % m[owner].astype(U64)).astype(np.int64)
    slot = base[owner] + segment
    total = int(m.sum())
    count = np.bincount(slot, minlength=total)
    low = np.bincount(slot, (tokens & U64(0xFFFFFFFF)).astype(float), total).astype(U64)
    high = np.bincount(slot, (tokens >> U64(32)).astype(float), total).astype(U64)
    subset = low + (high << U64(32))

    set_of = np.repeat(np.arange(len(sizes)), m)
    seg_of = _ranges(m)
    most = np.minimum(starts[band + 1] - 1, sizes * 100 // percent)
    units = tolerated(sizes + most, percent) + 1
    order = np.lexsort((-count, set_of))
    rank = np.empty(total, np.int64)
    rank[order] = _ranges(m)
    exact = (rank < units[set_of]) & (count > 0)
    short = units - np.bincount(set_of, exact, len(sizes)).astype(np.int64)
    # Raise designated segments, the smallest neighbourhoods first, where full subsets run short.
    open_ = exact & (seg_of < designated(m)[set_of])
    order = np.lexsort((count, ~open_, set_of))
    rank[order] = _ranges(m)
    raised = open_ & (rank < short[set_of])
    short -= np.bincount(set_of, raised, len(sizes)).astype(np.int64)
    # What is left falls to empty subsets, which always suffice.
    empty = count == 0
    order = np.lexsort((~empty, set_of))
    rank[order] = _ranges(m)
    exact |= empty & (rank < short[set_of])

    salt = mix((band[set_of].astype(U64) << U64(32)) + seg_of.astype(U64) + U64(1))
    full = np.ones(total, bool) if index else exact
    near = (seg_of < designated(m)[set_of]) if index else raised
    token = near[slot]
    keys = np.concatenate([mix(subset[full] ^ salt[full]), mix((subset[slot[token]] - tokens[token]) ^ salt[slot[token]])])
    owners = np.concatenate([set_of[full], owner[token]])
    probes = np.concatenate([exact[full], raised[slot[token]]])
    return keys, owners, probes


def set_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index and probe keys of sets of 64-bit shingles: (key, number of the set, whether it probes)."""
    kept = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(kept):
        return np.zeros(0, U64), kept, np.zeros(0, bool)
    starts = band_starts(percent)
    ms = segment_counts(starts, percent)
    tokens = mix(np.concatenate([sets[i] for i in kept]))
    sizes = np.array([len(sets[i]) for i in kept], np.int64)
    band = np.searchsorted(starts, sizes, "right") - 1
    own = _keys_in_band(tokens, sizes, band, True, starts, ms, percent)
    reach = sizes * 100 // percent >= starts[band + 1]
    wide = _keys_in_band(tokens[np.repeat(reach, sizes)], sizes[reach], band[reach] + 1, False, starts, ms, percent)
    keys = np.concatenate([own[0], wide[0]])
    owners = np.concatenate([kept[own[1]], kept[np.flatnonzero(reach)[wide[1]]]])
    return keys, owners, np.concatenate([own[2], wide[2]])


def _set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, whatever its order; 0 and 0 for the empty set."""
    return int(np.add.reduce(mix(s ^ U64(0x51ED270B27C8E1A5)))), int(np.add.reduce(mix(s * U64(0xC2B2AE3D27D4EB4F))))


def document_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b) of every document; equal pairs set_a, set_b mean equal sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = shingle_sets(batch.column("text"), words)
            names = np.array([_set_digest(s) for s in sets], U64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), longs(names[:, 0]), longs(names[:, 1])],
                ["doc_id", "n_shingles", "set_a", "set_b"])

    return _narrow(docs).mapInArrow(scan, "doc_id long, n_shingles long, set_a long, set_b long")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def index_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, doc, probes) of the pigeonhole index. A task skips a set it has already indexed."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in chunks(batches):
            sets = shingle_sets(batch.column("text"), words)
            for i, s in enumerate(sets):
                name = _set_digest(s)
                if name in seen:
                    sets[i] = s[:0]
                seen.add(name)
            keys, owners, probes = set_keys(sets, percent)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a in range(0, len(keys), 1 << 18):
                cut = slice(a, a + (1 << 18))
                yield pa.RecordBatch.from_arrays([longs(keys[cut]), pa.array(ids[owners[cut]]), pa.array(probes[cut])],
                                                 ["key", "doc", "probes"])

    return _narrow(docs.where(docs["doc_id"].isNotNull())).mapInArrow(scan, "key long, doc long, probes boolean")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of keys that a probing set shares with another, each with the head of its run."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, heads in head_of_runs(batches, "key", ["doc", "probes"]):
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            hit = heads["probes"].astype(bool) & (docs != heads["doc"])
            if hit.any():
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).filter(pa.array(hit)) for c in ("key", "doc", "probes")), pa.array(heads["doc"][hit])],
                    ["key", "doc", "probes", "head"])

    ordered = rows.repartition("key").sortWithinPartitions("key", F.desc("probes"), "doc")
    return ordered.mapInArrow(scan, "key long, doc long, probes boolean, head long")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose whole texts link, with shared, the size of the intersection."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text_a", 1 << 19):
            left = shingle_sets(batch.column("text_a"), words)
            right = shingle_sets(batch.column("text_b"), words)
            same = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)], np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(left, right)], np.int64) - same
            ok = pa.array((100 * same >= percent * union) & (union > 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array(same).filter(ok)], ["a", "b", "shared"])

    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(
        scan, "a long, b long, shared long")


def parity(s: np.ndarray) -> bytes:
    """Bits of which each element of a set flips one."""
    odd = np.bincount((mix(s) % U64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def signatures(texts: DataFrame, words: int) -> DataFrame:
    """(doc, size, bits): size and parity bits of each document's set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            bits, sizes = [], []
            for s in shingle_sets(batch.column("text"), words):
                bits.append(parity(s))
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())],
                                             ["doc", "size", "bits"])

    return texts.mapInArrow(scan, "doc long, size long, bits binary")


def paired(members: DataFrame, signed: DataFrame, percent: int, block: int = 4096) -> DataFrame:
    """Pairs (a, b), a > b, of members (key, doc, probes, part) that share a key of which one probes, belong to
    different parts, and may link by their sizes and parity bits. Keys of more members than ``block`` are
    dealt out as pairs of blocks."""
    names = ["key", "i", "j", "doc", "probes", "part", "size", "bits", "own"]

    def compare(rows: pa.Table) -> pa.RecordBatch:
        col = {n: rows.column(n).to_numpy() for n in names if n != "bits"}
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(len(rows), -1)
        begins = np.ones(len(rows), bool)
        begins[1:] = (col["key"][1:] != col["key"][:-1]) | (col["i"][1:] != col["i"][:-1]) | (col["j"][1:] != col["j"][:-1])
        group = np.cumsum(begins)
        ends = np.searchsorted(group, group, "right")
        at, found = np.arange(len(rows)), []
        for step in range(1, len(rows)):
            at = at[at + step < ends[at]]
            if not len(at):
                break
            to = at + step
            small, large = np.minimum(col["size"][at], col["size"][to]), np.maximum(col["size"][at], col["size"][to])
            ok = (col["part"][at] != col["part"][to]) & (col["probes"][at] | col["probes"][to]) & (100 * small >= percent * large)
            # Two members of one block meet where both indices are that block.
            ok &= (col["own"][at] != col["own"][to]) | (col["i"][at] == col["j"][at])
            x, y = at[ok], to[ok]
            gap = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            ok = gap <= tolerated(col["size"][x] + col["size"][y], percent)
            found.append(np.stack([col["doc"][x[ok]], col["doc"][y[ok]]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        pairs = np.unique(np.stack([pairs.max(axis=0), pairs.min(axis=0)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches(([held] if held is not None else []) + [batch]).combine_chunks()
            key = np.stack([held.column(n).to_numpy() for n in ("key", "i", "j")])
            last = int(np.flatnonzero((key != key[:, -1:]).any(axis=0)).max(initial=-1)) + 1
            if last:
                yield compare(held.slice(0, last))
            held = held.slice(last).combine_chunks().to_batches()[0]
        if held is not None:
            yield compare(pa.Table.from_batches([held]))

    blocks = members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = members.join(blocks, "key").withColumn("own", F.expr("cast(pmod(xxhash64(doc), blocks) as int)")).withColumn(
        "other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    rows = dealt.join(signed, "doc").select(*names).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(scan, "a long, b long").distinct()


class JaccardJoin:
    """Exact join of documents whose sets of word shingles reach ``percent`` of Jaccard likeness.

    Words are lower-cased in A-Z. A document of fewer words than a shingle is one shingle; one without words,
    or with null text, has an empty set and links with nothing. Rows with null doc_id are counted but never
    linked, extra columns are ignored, and rows that repeat a doc_id belong to one component if their texts
    are equal (else the smallest text stands for the id).
    """

    def __init__(self, docs: DataFrame, words: int = 5, percent: int = 80):
        self.words, self.percent = words, percent
        self.docs = docs
        self.sets = keep(document_sets(docs, words), "sets")
        self.classes = self.sets.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(
            F.min("doc_id").alias("rep"))

    def _candidates(self) -> DataFrame:
        """Shared index rows with documents replaced by the first one of equal sets."""
        rep = self.sets.join(self.classes, ["set_a", "set_b"]).select(F.col("doc_id").alias("doc"), "rep").distinct()
        hits = _shared(index_rows(self.docs, self.words, self.percent))
        named = hits.join(rep, "doc").select("key", "head", "probes", F.col("rep").alias("doc")).join(
            rep.select(F.col("doc").alias("head"), F.col("rep").alias("top")), "head")
        return keep(named.where("doc <> top").select("key", "doc", "probes", F.col("top").alias("head")), "shared")

    def _texts(self, rows: DataFrame) -> DataFrame:
        wanted = rows.select(F.col("doc").alias("doc_id")).union(rows.select("head")).distinct()
        found = _narrow(self.docs).join(wanted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        return keep(found, "texts")

    @staticmethod
    def _members(rows: DataFrame) -> DataFrame:
        heads = rows.select("key", F.col("head").alias("doc"), F.lit(True).alias("probes"))
        return rows.select("key", "doc", "probes").unionByName(heads).groupBy("key", "doc").agg(F.max("probes").alias("probes"))

    def links(self) -> DataFrame:
        """(a, b, shared) of every linked pair of different sets, a > b, both the first of their class."""
        rows = self._candidates()
        texts = self._texts(rows)
        members = self._members(rows).withColumn("part", F.col("doc"))
        return verified(paired(members, signatures(texts, self.words), self.percent), texts, self.words, self.percent)

    def components(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, class_id): the smallest document within reach of links, itself
        included, and the first document of equal sets. Pairs that earlier links already connect are not
        verified again."""
        rows = self._candidates()
        texts = self._texts(rows)
        first = keep(rows.select(F.greatest("doc", "head").alias("a"), F.least("doc", "head").alias("b")).distinct(), "first")
        linked = keep(verified(first, texts, self.words, self.percent), "linked")
        label = keep(components(linked), "labels")
        members = self._members(rows).join(label.withColumnRenamed("node", "doc"), "doc", "left").select(
            "key", "doc", "probes", F.coalesce("component", "doc").alias("part"))
        members = keep(members, "members")
        mixed = members.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
        rest = paired(members.join(mixed, "key"), signatures(texts, self.words), self.percent).join(first, ["a", "b"], "left_anti")
        more = verified(keep(rest, "rest"), texts, self.words, self.percent)
        label = components(keep(linked.unionByName(more), "links"))
        reps = self.classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(
            "set_a", "set_b", "rep", F.coalesce("component", "rep").alias("component"))
        out = self.sets.join(reps, (self.sets["n_shingles"] > 0) & (self.sets["set_a"] == reps["set_a"])
                             & (self.sets["set_b"] == reps["set_b"]), "left")
        return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
                          F.coalesce("rep", "doc_id").alias("class_id"))
