"""Byte-level BPE encoding and decoding.

Texts are cut into pieces by the tokenizer's pattern. Only distinct pieces are merged: a
higher-order fold over the byte array of a piece replaces, step by step, the leftmost pair of least rank,
looking ranks up in a literal map (dealt into small maps by hash, since Spark scans a map from its start).
Documents are dealt into blocks of bounded size; a block is a stream of its own pieces with their ids, then of its documents,
which are put together again as they come. Decoding concatenates the bytes of the ids. Bytes are held in hexadecimal.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.llm.labelled import narrow
from landgrid.llm.pieces import cut, kind_ranges
from landgrid.llm.store import keep, packed, release, unpacked
from landgrid.llm.tokens import raw, trim

BITS = 20
NEVER = (1 << BITS) - 1
LONG_PIECE = 512


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines: token in base64, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by a queue of pairs, for pieces too long to fold: least rank first, then leftmost."""
    if piece in ranks:
        return [ranks[piece]]
    parts: list[bytes | None] = [piece[i:i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    queue: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(parts):
            pair = parts[i] + parts[after[i]]
            if pair in ranks:
                heapq.heappush(queue, (ranks[pair], i, pair))

    for i in range(len(parts)):
        offer(i)
    while queue:
        _, i, pair = heapq.heappop(queue)
        j = after[i] if parts[i] is not None else len(parts)
        if j >= len(parts) or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in parts if p is not None]


def pair_cells(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of joined tokens in one array: tokens l and r join to the one of rank ``cells[base[l] + r] ^ (l + 1) << BITS``, if that
    is below NEVER. Rows of the sparse matrix (l, r) are laid over each other, longest first, where their entries meet gaps; half of
    the cells stay empty, so that gaps are found soon."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                rows.setdefault(left, []).append((right, rank))
    width = max(ranks.values(), default=0) + 1
    size = 2 * sum(map(len, rows.values())) + width
    base, cells = np.zeros(width, np.int64), np.zeros(size + width, np.int64)
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        right, rank = np.array(row, np.int64).T
        at, free, tried = left * 39_571_431, np.zeros(1, bool), 64
        while not free.any():
            tries = np.arange(at, at + tried) % size
            free = (cells[tries[:, None] + (right - right.min())] == 0).all(axis=1)
            at, tried = at + tried, min(2 * tried, 4096)
        base[left] = tries[free.argmax()] - right.min()
        cells[base[left] + right] = (left + 1) << BITS | rank
    return base, cells


class ByteBpe:
    """Codec of the ranks in a file, with the pattern that cuts texts.

    A null text is an empty one; an empty text has no ids. Rows that repeat an id are encoded each, a null doc_id
    stays; extra columns are ignored.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str, block_bytes: int = 24 << 20):
        self.spark, self.pattern, self.block_bytes = spark, pattern, block_bytes
        self.ranks = read_ranks(path)
        base, cells = pair_cells(self.ranks)
        self.tables = json.dumps({"base": base.tolist(), "cells": cells.tolist(), "bytes": [self.ranks[bytes([b])] for b in range(256)]},
                                 separators=(",", ":"))
        pieces = [""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = token.hex().upper()
        self.hex_of_id = ",".join(pieces)

    def fold(self, piece: Column) -> Column:
        """Ids of a piece by merging alone. The tables are one literal, bound once around the whole fold.

        The state is one array with a number per part: the rank that it makes with the next part, its place and its own id. The
        least number is then the leftmost pair of least rank.
        """
        def let(value: Column, use) -> Column:
            return F.get(F.transform(F.array(value), use), F.lit(0))

        def with_tables(tables: Column) -> Column:
            def packed_part(rank: Column, place: Column, id_: Column) -> Column:
                return F.shiftleft(rank, 2 * BITS) + place + id_

            def own(part: Column) -> Column:
                return part.bitwiseAND(F.lit(NEVER)).cast("int")

            def place(part: Column) -> Column:
                return part.bitwiseAND(F.lit(NEVER << BITS))

            def rank(left: Column, right: Column) -> Column:
                cell = F.get(tables["cells"], F.get(tables["base"], left) + right)
                return F.least(cell.bitwiseXOR(F.shiftleft((left + 1).cast("long"), BITS)), F.lit(NEVER).cast("long"))

            def step(parts: Column, _: Column) -> Column:
                def merge(best: Column) -> Column:
                    at, joined = best["at"], F.shiftright(best["least"], 2 * BITS).cast("int")
                    after, before = F.get(parts, at + 1), F.get(parts, at - 2)
                    here = packed_part(rank(joined, own(after)), place(best["least"]), joined)
                    left = F.when(at > 1, F.array(packed_part(rank(own(before), joined), place(before), own(before)))).otherwise(
                        F.array().cast("array<long>"))
                    return F.concat(F.slice(parts, 1, F.greatest(at - 2, F.lit(0))), left, F.array(here), F.slice(parts, at + 2, F.size(parts)))

                def chosen(least: Column) -> Column:
                    return F.when(least >= NEVER << 2 * BITS, parts).otherwise(
                        let(F.struct(F.array_position(parts, least).cast("int").alias("at"), least.alias("least")), merge))

                return let(F.array_min(parts), chosen)

            # Bytes as characters of the same number.
            bytes_ = F.transform(F.split(F.decode(F.encode(piece, "utf-8"), "ISO-8859-1"), ""), lambda c: F.get(tables["bytes"], F.ascii(c)))

            def merged(ids: Column) -> Column:
                start = F.transform(ids, lambda id_, i: packed_part(rank(id_, F.get(ids, i + 1)), F.shiftleft(i.cast("long"), BITS), id_))
                return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ids) - 1, F.lit(1))), start, step, lambda s: F.transform(s, own))

            return let(bytes_, merged)

        return let(F.from_json(F.lit(self.tables), "base array<int>, cells array<long>, bytes array<int>"), with_tables)

    def whole(self) -> DataFrame:
        """(token, rank): the vocabulary's tokens that are texts."""
        rows = []
        for token, rank in self.ranks.items():
            try:
                rows.append((token.decode(), rank))
            except UnicodeDecodeError:
                continue
        return self.spark.createDataFrame(pa.table({"token": [t for t, _ in rows], "rank": pa.array([r for _, r in rows], pa.int32())}))

    def encode_pieces(self, pieces: DataFrame) -> DataFrame:
        """``pieces`` with a column piece (string) and ids added."""
        ranks = self.ranks
        size = F.octet_length("piece")
        columns = [pieces[c] for c in pieces.columns]
        short = pieces.where(size <= LONG_PIECE).join(F.broadcast(self.whole()), F.col("piece") == F.col("token"), "left").select(
            *columns, F.when(F.col("rank").isNotNull(), F.array("rank")).otherwise(self.fold(F.col("piece"))).alias("ids"))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [merge_long(p.encode(), ranks) for p in batch.column("piece").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

        long = pieces.where(size > LONG_PIECE).mapInArrow(scan, short.schema)
        return short.unionByName(long)

    def encode(self, docs: DataFrame) -> DataFrame:
        """(doc_id, ids) of every document."""
        rows, pattern, ranges = narrow(docs), self.pattern, kind_ranges()
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(4, -(-total // self.block_bytes))

        small = packed(rows).withColumn(
            "block", F.pmod(F.xxhash64("doc_id", "packed"), F.lit(blocks)).cast("int"))
        small = small.select("block", "doc_id", "size", "packed")

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            met: dict[int, list[pa.Array]] = {}
            for batch in unpacked(batches):
                pieces, count = cut(*raw(batch.column("text")), pattern, ranges)
                owner = np.repeat(batch.column("block").to_numpy(), count)
                for block in sorted(set(batch.column("block").to_pylist())):
                    mine = pc.unique(pieces if (owner == block).all() else pieces.filter(pa.array(owner == block)))
                    parts = met.setdefault(block, [])
                    parts.append(mine)
                    # Merged when the news outgrow what is known, so that each piece is hashed a few times only.
                    if sum(map(len, parts[1:])) > max(200_000, len(parts[0])):
                        met[block] = [pc.unique(pa.concat_arrays(parts))]
            for block, parts in met.items():
                pieces = pc.unique(pa.concat_arrays(parts))
                for at in range(0, len(pieces), 1 << 16):
                    part = pieces.slice(at, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int32)), part], ["block", "piece"])
            met.clear()
            release()

        seen = small.repartition(blocks, "block").mapInArrow(distinct, "block int, piece string")
        words = keep(seen.groupBy("piece").agg(F.collect_list("block").alias("blocks")), "pieces")
        known = self.encode_pieces(words).select(F.explode("blocks").alias("block"), "piece", "ids")
        # Pieces of a block come before its documents.
        both = known.select("block", F.lit(False).alias("text_"), "piece", "ids").unionByName(
            small.withColumn("text_", F.lit(True)), allowMissingColumns=True)
        stream = both.repartitionById(blocks, "block").sortWithinPartitions("text_")

        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            block, words_, known_ = None, [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                key = batch.column("block").to_numpy() * 2 + batch.column("text_").to_numpy(zero_copy_only=False)
                at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
                for a, b in zip(at, [*at[1:], batch.num_rows]):
                    part = batch.slice(a, b - a)
                    if key[a] // 2 != block:
                        block, words_, known_ = key[a] // 2, [], None
                    if key[a] % 2 == 0:
                        words_.append(part.select(["piece", "ids"]))
                    else:
                        if known_ is None:
                            known_ = listed(words_)
                            words_ = []
                        yield from put(*known_, part.select(["doc_id", "size", "packed"]))
            words_, known_ = [], None
            release()

        def listed(words_: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
            """Pieces of a block, all of their ids, and number and first place of the ids of each."""
            if words_:
                table = pa.Table.from_batches(words_).combine_chunks()
                names, ids = table.column("piece").combine_chunks(), table.column("ids").combine_chunks()
            else:  # empty texts alone
                names, ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            sizes = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            return names, flat, sizes, np.cumsum(sizes, dtype=np.int32) - sizes

        def put(names: pa.Array, flat: np.ndarray, sizes: np.ndarray, first: np.ndarray, docs_: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for ids_, pieces, per_doc in cut_texts(docs_):
                at = pc.index_in(pieces, value_set=names).to_numpy(zero_copy_only=False).astype(np.int32)
                count = sizes[at] if len(at) else np.zeros(0, np.int32)
                ends = np.zeros(len(count) + 1, np.int32)
                np.cumsum(count, out=ends[1:])
                place = np.arange(ends[-1], dtype=np.int32) + np.repeat((first[at] if len(at) else count) - ends[:-1], count)
                offsets = ends[np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int64)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[place] if len(place) else flat[:0]))
                yield pa.RecordBatch.from_arrays([ids_, lists], ["doc_id", "ids"])
                del pieces, at, count, ends, place, offsets, lists
                trim()

        def cut_texts(docs_: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
            """Ids, pieces and their numbers of about 4 MB of texts, which are cut a little at a time: cutting takes many times
            the memory of its text, while looking pieces up costs a table of all names each time."""
            ids_, pieces, counts, held = [], [], [], 0
            for batch in unpacked(iter([docs_])):
                data, offs = raw(batch.column("text"))
                found, count = cut(data, offs, pattern, ranges)
                ids_.append(batch.column("doc_id"))
                pieces.append(found)
                counts.append(count)
                held += len(data)
                if held > 4 << 20:
                    yield pa.concat_arrays(ids_), pa.concat_arrays(pieces), np.concatenate(counts)
                    ids_, pieces, counts, held = [], [], [], 0
            if ids_:
                yield pa.concat_arrays(ids_), pa.concat_arrays(pieces), np.concatenate(counts)

        return stream.mapInArrow(together, "doc_id long, ids array<int>")

    def decode(self, ids: Column) -> Column:
        """Bytes of an array of ids."""
        table = F.split(F.lit(self.hex_of_id), ",")
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))
