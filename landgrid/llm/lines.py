"""Fuzzy line dedup by MinHash.

Every line is a set of character shingles. Lines get ``bands * rows`` minimum hashes; two lines that agree
on all rows of a band are proposed (at a likeness of 0.8 the fourteen bands of four rows miss one pair in a
thousand). Equal lines are one: a task proposes a line once, and the first place of equal lines stands for
all. In each band the first line is proposed to all others, the exact Jaccard likeness of whole lines decides,
and union-find joins the links. Lines of one band that are still apart are then compared too, and a task returns only links
that join what it has not joined yet: fewer than its lines. One line per component stays, the first by document and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.llm.graph import components
from landgrid.llm.jaccard import PARITY, tolerated
from landgrid.llm.labelled import narrow
from landgrid.llm.runs import head_of_runs
from landgrid.llm.store import keep, packed, unpacked
from landgrid.llm.tokens import LOWER, U64, chunks, distinct, longs, mix, powers, raw

U32 = np.uint32
BLANK = "".join(map(chr, range(33)))


def split_lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of all lines, as str.split("\\n") has them."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offs[1:], breaks]), kind="stable")
    owner = np.searchsorted(breaks, offs[1:], "left") - np.searchsorted(breaks, offs[:-1], "left") + 1
    return starts, ends, np.repeat(np.arange(len(offs) - 1), owner)


def shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit shingle hashes of each byte span and their counts; a span shorter than ``size`` is one shingle."""
    length = ends - starts
    counts = np.maximum(length - size + 1, 1)
    first = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) + np.repeat(starts - first, counts)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:len(data)], out=total[1:])
    end = np.minimum(at + size, np.repeat(ends, counts))
    return mix((total[end] - total[at]) * down[at]), counts


def line_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits per line that name its bytes."""
    up, down = powers(len(data) + 1)
    out = np.zeros((len(starts), 2), U64)
    for k, salt in enumerate((U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))):
        spread = mix(np.arange(256, dtype=U64) + salt)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(spread[data] * up[:len(data)], out=total[1:])
        out[:, k] = mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(U64) * salt)
    return out


def signatures(hashed: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(line, band) keys: hash of the minima of each band's rows."""
    rng = np.random.default_rng(97)
    odd = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64) | 1).astype(U32)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(U32)
    first = np.cumsum(counts) - counts
    low = (hashed >> U64(32)).astype(U32)
    turned = np.empty_like(low)
    keys = np.empty((len(counts), bands), U64)
    for b in range(bands):
        key = np.full(len(counts), b + 1, U64)
        for r in range(b * rows, (b + 1) * rows):
            np.multiply(low, odd[r], out=turned)
            turned += add[r]
            key = mix(key ^ np.minimum.reduceat(turned, first).astype(U64))
        keys[:, b] = key
    return keys


def likeness(a: pa.Array, b: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of the shingle sets of lines, pair by pair."""
    sets = []
    for lines in (a, b):
        data, offs = raw(lines)
        hashed, counts = shingles(data, offs[:-1], offs[1:], size)
        pair = np.repeat(np.arange(len(counts)), counts).astype(U64)
        sets.append(distinct((pair << U64(48)) | (hashed >> U64(16))))
    both = np.concatenate(sets)
    both.sort()
    same = np.bincount((both[1:][both[1:] == both[:-1]] >> U64(48)).astype(np.int64), minlength=len(a))
    whole = np.bincount((both >> U64(48)).astype(np.int64), minlength=len(a))
    return same, whole - same


def spanning(rows: pa.Table, size: int, percent: int, flush: int = 4096) -> pa.RecordBatch:
    """Links between rows of the same (key, i, j) that differ in part, as (a, b) with a > b: as many as join what is linked.

    Rows are compared by sizes and parity bits at growing distance. What passes is decided on whole lines, the nearest first
    and only where both sides are still apart, and rows that have been joined are not compared again."""
    col = {n: rows.column(n).to_numpy() for n in ("key", "i", "j", "doc", "part", "size", "own")}
    lines = rows.column("line").combine_chunks()
    bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(len(rows), -1)
    begins = np.ones(len(rows), bool)
    begins[1:] = (col["key"][1:] != col["key"][:-1]) | (col["i"][1:] != col["i"][:-1]) | (col["j"][1:] != col["j"][:-1])
    group = np.cumsum(begins)
    ends = np.searchsorted(group, group, "right")
    # Rows of one group and part are joined from the start.
    order = np.lexsort((col["part"], group))
    turn = np.ones(len(rows), bool)
    turn[1:] = (group[order][1:] != group[order][:-1]) | (col["part"][order][1:] != col["part"][order][:-1])
    joint = np.empty(len(rows), np.int64)
    joint[order] = np.cumsum(turn) - 1
    top = list(range(int(joint.max(initial=-1)) + 1))
    found, waiting, waits = [], [], 0

    def find(x: int, over: list[int] = top) -> int:
        while over[x] != x:
            over[x] = over[over[x]]
            x = over[x]
        return x

    def decide(x: np.ndarray, y: np.ndarray, gap: np.ndarray) -> None:
        order = np.argsort(gap, kind="stable")
        x, y = x[order], y[order]
        while len(x):
            trial, now = list(top), []
            for k, (p, q) in enumerate(zip(joint[x].tolist(), joint[y].tolist())):
                p, q = find(p, trial), find(q, trial)
                if p != q:
                    trial[max(p, q)] = min(p, q)
                    now.append(k)
            for at in range(0, len(now), 512):
                part = np.array(now[at:at + 512])
                same, union = likeness(lines.take(pa.array(x[part])), lines.take(pa.array(y[part])), size)
                for k in part[100 * same >= percent * union].tolist():
                    p, q = find(int(joint[x[k]])), find(int(joint[y[k]]))
                    top[max(p, q)] = min(p, q)
                    found.append((x[k], y[k]))
            flat = np.array([find(k) for k in range(len(top))], np.int64)
            tested = np.zeros(len(x), bool)
            tested[now] = True
            left = ~tested & (flat[joint[x]] != flat[joint[y]])
            x, y = x[left], y[left]

    at = np.arange(len(rows))
    label = joint.copy()
    for step in range(1, len(rows)):
        at = at[at + step < ends[at]]
        if not len(at):
            break
        to = at + step
        small, large = np.minimum(col["size"][at], col["size"][to]), np.maximum(col["size"][at], col["size"][to])
        # Two members of one block meet where both indices are that block.
        ok = (label[at] != label[to]) & (100 * small >= percent * large) & (
            (col["own"][at] != col["own"][to]) | (col["i"][at] == col["j"][at]))
        x, y = at[ok], to[ok]
        gap = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
        ok = gap <= tolerated(col["size"][x] + col["size"][y], percent)
        waiting.append((x[ok], y[ok], gap[ok]))
        waits += int(ok.sum())
        if waits >= flush:
            decide(*map(np.concatenate, zip(*waiting)))
            label = np.array([find(k) for k in range(len(top))], np.int64)[joint]
            waiting, waits = [], 0
    if waits:
        decide(*map(np.concatenate, zip(*waiting)))
    x, y = np.array(found, np.int64).reshape(-1, 2).T
    a, b = col["doc"][x], col["doc"][y]
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def inked_lines(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends, document and place of the lines that are not blank."""
    data, offs = raw(batch.column("text"))
    data = LOWER[data]
    starts, ends, owner = split_lines(data, offs)
    place = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
    ink = np.concatenate([[0], np.cumsum(data > 32)])
    full = ink[ends] > ink[starts]
    return data, starts[full], ends[full], owner[full], place[full]


class LineDedup:
    """Lines whose sets of ``size`` bytes, A-Z lower-cased, reach ``percent`` of Jaccard likeness to another are one.

    Lines are what lies between line feeds; lines of white space alone are never touched. A line shorter than a
    shingle is one shingle. Null text has no lines. Rows with null doc_id keep all their lines; rows that repeat a
    doc_id are told apart by nothing, so they lose the same places; extra columns are passed through.
    """

    def __init__(self, docs: DataFrame, size: int = 8, percent: int = 80, bands: int = 14, rows: int = 4):
        self.size, self.percent, self.bands, self.rows = size, percent, bands, rows
        self.docs = docs
        self.narrow = narrow(docs)

    def names(self) -> DataFrame:
        """(name_a, name_b, doc, place) of every line that is not blank."""
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                data, starts, ends, owner, place = inked_lines(batch)
                name = line_names(data, starts, ends)
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [longs(name[:, 0]), longs(name[:, 1]), pa.array(ids[owner]), pa.array(place.astype(np.int32))],
                    ["name_a", "name_b", "doc", "place"])

        return self.narrow.where("doc_id is not null").mapInArrow(scan, "name_a long, name_b long, doc long, place int")

    def band_rows(self) -> DataFrame:
        """(key, name): every distinct line of a task in its bands, under the first half of its name."""
        size, bands, rows = self.size, self.bands, self.rows

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in chunks(batches, limit=1 << 18):
                data, starts, ends, _, _ = inked_lines(batch)
                name = line_names(data, starts, ends)[:, 0]
                fresh = np.array([not (n in seen or seen.add(n)) for n in name.tolist()], bool)
                if not fresh.any():
                    continue
                keys = signatures(*shingles(data, starts[fresh], ends[fresh], size), bands, rows)
                yield pa.RecordBatch.from_arrays([longs(keys.ravel()), longs(np.repeat(name[fresh], bands))], ["key", "name"])

        return self.narrow.where("doc_id is not null").mapInArrow(scan, "key long, name long")

    def candidates(self) -> DataFrame:
        """(key, doc, head): names of lines that share a band with its first line."""
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, _, heads in head_of_runs(batches, "key", ["name"]):
                name = batch.column("name").to_numpy(zero_copy_only=False)
                apart = name != heads["name"]
                if apart.any():
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").filter(pa.array(apart)), pa.array(name[apart]), pa.array(heads["name"][apart])],
                        ["key", "doc", "head"])

        return self.band_rows().repartition("key").sortWithinPartitions("key", "name").mapInArrow(
            scan, "key long, doc long, head long").distinct()

    def texts(self, wanted: DataFrame) -> DataFrame:
        """(name, line): bytes of the lines at (name, doc, place)."""
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in unpacked(batches):
                data, offs = raw(batch.column("text"))
                starts, ends, owner = split_lines(LOWER[data], offs)
                first = np.searchsorted(owner, np.arange(batch.num_rows))
                whole, names, lines = LOWER[data].tobytes(), [], []
                for i, places in enumerate(batch.column("places").to_pylist()):
                    for p in places:
                        names.append(p["name"])
                        k = first[i] + p["place"]
                        lines.append(whole[starts[k]:ends[k]])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(lines, pa.binary())], ["name", "line"])

        lists = wanted.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("name", "place")).alias("places"))
        return packed(self.narrow).join(lists, "doc_id").mapInArrow(scan, "name long, line binary")

    def _signed(self, lines: DataFrame) -> DataFrame:
        """(doc, size, bits, line): lines with size and parity bits of their sets, as ``likeness`` has them."""
        size = self.size

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "line"):
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    data, offs = raw(part.column("line"))
                    hashed, counts = shingles(data, offs[:-1], offs[1:], size)
                    owner = np.repeat(np.arange(len(counts)), counts).astype(U64)
                    sets = distinct((owner << U64(48)) | (hashed >> U64(16)))
                    owner = (sets >> U64(48)).astype(np.int64)
                    place = owner * PARITY + (mix(sets & U64((1 << 48) - 1)) % U64(PARITY)).astype(np.int64)
                    odd = np.bincount(place, minlength=len(counts) * PARITY).astype(np.uint8) & 1
                    bits = np.packbits(odd.reshape(len(counts), PARITY), axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("name"), pa.array(np.bincount(owner, minlength=len(counts))),
                         pa.array([row.tobytes() for row in bits], pa.binary()), part.column("line")], ["doc", "size", "bits", "line"])

        return lines.mapInArrow(scan, "doc long, size long, bits binary, line binary")

    def verified(self, pairs: DataFrame, lines: DataFrame) -> DataFrame:
        """Of pairs (a, b) those whose whole lines are alike."""
        size, percent = self.size, self.percent

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "x", 1 << 18):
                same, union = likeness(batch.column("x"), batch.column("y"), size)
                yield batch.select(["a", "b"]).filter(pa.array(100 * same >= percent * union))

        a = lines.select(F.col("name").alias("a"), F.col("line").alias("x"))
        b = lines.select(F.col("name").alias("b"), F.col("line").alias("y"))
        return pairs.join(b, "b").join(a, "a").select("a", "b", "x", "y").mapInArrow(scan, "a long, b long")

    def bridges(self, members: DataFrame, lines: DataFrame, block: int = 4096, block_bytes: int = 8 << 20) -> DataFrame:
        """(a, b): links between members (key, doc, part) of one key and different parts. Of all links in a block of a key
        only those are returned that join what others have not joined yet, so their number is below that of the members; each is
        decided on whole lines. Keys of many members or bytes are dealt out as pairs of blocks."""
        size, percent = self.size, self.percent
        names = ["key", "i", "j", "doc", "part", "size", "bits", "own", "line"]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                held = pa.Table.from_batches(([held] if held is not None else []) + [batch]).combine_chunks()
                key = np.stack([held.column(n).to_numpy() for n in ("key", "i", "j")])
                begins = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
                last = int(begins.max(initial=0))
                if last:
                    yield spanning(held.slice(0, last), size, percent)
                held = held.slice(last).combine_chunks().to_batches()[0]
            if held is not None:
                yield spanning(pa.Table.from_batches([held]), size, percent)

        weight = lines.select(F.col("name").alias("doc"), F.length("line").alias("n_bytes"))
        blocks = members.join(weight, "doc").groupBy("key").agg(F.greatest(
            F.ceil(F.count("*") / block), F.ceil(F.sum("n_bytes") / block_bytes), F.lit(1)).cast("int").alias("blocks"))
        dealt = members.join(blocks, "key").withColumn("own", F.expr("cast(pmod(xxhash64(doc), blocks) as int)")).withColumn(
            "other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        rows = dealt.join(self._signed(lines), "doc").select(*names).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return rows.mapInArrow(scan, "a long, b long").distinct()

    def removed(self) -> DataFrame:
        """(doc, place) of all lines but the first of each component."""
        names = keep(self.names(), "lines")
        rows = keep(self.candidates(), "shared")
        pairs = keep(rows.select(F.greatest("doc", "head").alias("a"), F.least("doc", "head").alias("b")).distinct(), "pairs")
        nodes = pairs.select(F.col("a").alias("name_a")).union(pairs.select("b")).distinct()
        # One place for each proposed line, to read it from; half names that collide are read once.
        spot = names.join(nodes, "name_a", "left_semi").groupBy("name_a").agg(F.min(F.struct("doc", "place", "name_b")).alias("at"))
        spot = keep(spot.select(F.col("name_a").alias("name"), "at.name_b", "at.doc", "at.place"), "spots")
        lines = keep(self.texts(spot.select("name", "doc", "place")), "texts")
        linked = keep(self.verified(pairs, lines), "linked")
        # Lines of one band that the links through its first line have left apart.
        part = keep(components(linked), "parts")
        members = rows.select("key", "doc").union(rows.select("key", "head")).distinct().join(
            part.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("part"))
        members = keep(members, "members")
        mixed = members.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
        rest = self.bridges(members.join(mixed, "key"), lines)
        linked = keep(part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest), "links")
        group = components(linked).join(spot, F.col("node") == F.col("name")).select(
            F.col("name").alias("name_a"), "name_b", "component")
        group = keep(group, "groups")
        marked = names.join(group, ["name_a", "name_b"], "left").select(
            F.coalesce("component", "name_a").alias("g"), F.when(F.col("component").isNull(), F.col("name_b")).otherwise(0).alias("h"),
            "doc", "place")
        first = marked.groupBy("g", "h").agg(F.min("doc").alias("first_doc"), F.count("*").alias("n")).where("n > 1")
        several = keep(marked.join(keep(first.drop("n"), "first"), ["g", "h"]), "several")
        inside = several.where("doc = first_doc")
        least = inside.groupBy("g", "h").agg(F.min("place").alias("first_place"))
        return several.where("doc > first_doc").select("doc", "place").unionByName(
            inside.join(least, ["g", "h"]).where("place > first_place").select("doc", "place"))

    def cut(self) -> DataFrame:
        """``docs`` with the removed lines taken out of text, and n_lines, n_removed and n_left: how many lines
        there were, went, and are left that are not blank."""
        gone = self.removed().groupBy(F.col("doc").alias("line_doc")).agg(F.collect_set("place").alias("line_gone"))
        kept = self.docs.drop("n_lines", "n_removed", "n_left", "line_doc", "line_gone")
        rows = kept.join(gone, kept["doc_id"].cast("long") == gone["line_doc"], "left").drop("line_doc")
        names = kept.columns

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                texts, n, away, left = [], [], [], []
                for text, places in zip(batch.column("text").to_pylist(), batch.column("line_gone").to_pylist()):
                    lines = text.split("\n") if text is not None else []
                    drop = set(places or ())
                    stay = [x for i, x in enumerate(lines) if i not in drop] if drop else lines
                    texts.append("\n".join(stay) if text is not None else None)
                    n.append(len(lines))
                    away.append(len(lines) - len(stay))
                    left.append(sum(1 for x in stay if x.strip(BLANK)))
                columns = [pa.array(texts, batch.column(c).type) if c == "text" else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, pa.int64()) for v in (n, away, left))],
                                                 [*names, "n_lines", "n_removed", "n_left"])

        more = [T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed", "n_left")]
        return rows.mapInArrow(scan, T.StructType([*kept.schema.fields, *more]))

