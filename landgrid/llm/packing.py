"""Packing of documents into sequences by order-preserving dynamic programming.

Documents are tokenised in the order in which they are stored and laid end to end in blocks of about a million tokens.
Windows of at most ``size`` tokens cut the block at places of different cost: nothing between documents, little
between sentences, more inside a sentence. The plan of least cuts plus padding is found place by place: of all windows that
end at a place, the cheapest start is the head of a monotone queue; windows whose length is a power of two
need no padding and are looked up apart.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from landgrid.llm.labelled import narrow
from landgrid.llm.tokens import chunks, segments

BLOCK = 1 << 20
#: About 250 MB in a worker.
KNOWN_RUNS = 1_000_000
#: Pre-tokenisation ends a run of letters before these marks in any case.
SEAM = re.compile(rb"(?<=[A-Za-z])(?=[.,;:!?])")
BAR = "|"
JOINED = 64
FINAL = (".", "!", "?", "。", "！", "？")
CLOSING = "\"')]}»”’"


class Codes(dict):
    """Number of each run met so far; runs met for the first time are listed in ``new``. Plain ASCII runs share the number of
    their lower case: the tokenizer lower-cases, and composes characters only beyond ASCII."""

    def __init__(self):
        super().__init__()
        self.count, self.new = 0, []

    def __missing__(self, run: bytes) -> int:
        low = run.lower() if run.isascii() else run
        if low != run:
            code = self[low]
        else:
            code = self.count
            self.count += 1
            self.new.append(run)
        self[run] = code
        return code


class RunEncoder:
    """Ids of texts with a word-level vocabulary, which drops white space: a text is the row of its runs between
    blanks. Runs met before are looked up, new ones are encoded together; the table of known runs starts again when full."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.removesuffix("</w>").rstrip(CLOSING).endswith(FINAL)
        bar = self._ids([BAR])[0]
        self.bar = int(bar[0]) if len(bar) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.codes = Codes()
        self.ids, self.sizes, self.first = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self) -> None:
        """Ids of the new runs, many in one text with a bar between them; runs with a bar of their own go alone."""
        new = [r.decode() for r in self.codes.new]
        self.codes.new = []
        alone = [n for n, r in enumerate(new) if BAR in r or self.bar is None]
        held = set(alone)
        joined = [n for n in range(len(new)) if n not in held] if held else range(len(new))
        groups = [joined[i:i + JOINED] for i in range(0, len(joined), JOINED)]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(new)
        for group, ids in zip(groups, self._ids([f" {BAR} ".join(new[n] for n in group) for group in groups])):
            bars = np.flatnonzero(ids == self.bar)
            for n, a, b in zip(group, [0, *(bars + 1).tolist()], [*bars.tolist(), len(ids)], strict=True):
                out[n] = ids[a:b]
        for n, ids in zip(alone, self._ids([new[n] for n in alone])):
            out[n] = ids
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, *out])

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of one text, worked in parts of bounded size."""
        parts = [p for s in segments(text) for p in self.encode_all([s])]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.codes) > KNOWN_RUNS:
            self._forget()
        split = [SEAM.sub(b" ", t).split() for t in texts]
        runs = sum(map(len, split))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(split)), np.int64, runs)
        if self.codes.new:
            self._encode_new()
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if runs else 0
        ids = self.ids[np.arange(total) + np.repeat(self.first[codes] - (ends - sizes), sizes)]
        at = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])]
        return [ids[a:b] for a, b in zip(at[:-1], at[1:])]


@lru_cache(maxsize=1)
def encoder(path: str) -> RunEncoder:
    return RunEncoder(path)


def least_cost_cuts(places: np.ndarray, costs: np.ndarray, size: int) -> list[int]:
    """Indices of the places, first and last included, that cut windows of at most ``size`` at least cost.

    ``places`` ascend from the start to the end of the row, steps of at most ``size``; a cut costs ``costs`` there and a
    window ``size`` less its length, or nothing if its length is a power of two. With c(i) the least cost up to place
    i, a plain window from j costs c(j) + place(j) + size - place(i): among the places within reach the queue
    keeps those of ever larger c + place, so its head is the best start.
    """
    n = len(places)
    into, start = [], []
    for k in range(size.bit_length()):
        if 1 << k <= size:
            at = np.searchsorted(places, places - (1 << k))
            hit = np.flatnonzero(places[at] == places - (1 << k))
            into.append(hit)
            start.append(at[hit])
    into, start = np.concatenate(into), np.concatenate(start)
    order = np.argsort(into, kind="stable")
    into, start = into[order].tolist() + [n], start[order].tolist()
    where, price = places.tolist(), costs.tolist()
    cost, back, queue, rank, nth = [0] * n, [0] * n, deque([0]), [0] * n, 0
    rank[0] = where[0]
    for i in range(1, n):
        here = where[i]
        while where[queue[0]] < here - size:
            queue.popleft()
        best = queue[0]
        least = rank[best] + size - here
        while into[nth] == i:
            if cost[start[nth]] < least:
                best = start[nth]
                least = cost[best]
            nth += 1
        cost[i], back[i] = least + price[i], best
        rank[i] = cost[i] + here
        while queue and rank[queue[-1]] > rank[i]:
            queue.pop()
        queue.append(i)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def cut_places(ends: np.ndarray, sentences: np.ndarray, total: int, size: int, grain: int,
               sentence_cost: int, inner_cost: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a row of ``total`` tokens may be cut, with costs: ``ends`` of documents, ``sentences``, every ``grain``
    tokens between places further apart than that, and every token of the last ``size``, so that a block's rest
    may be told in windows that need no padding."""
    price = np.full(total + 1, -1, np.int64)
    price[max(total - size, 0):] = inner_cost
    price[sentences] = sentence_cost
    price[ends] = price[0] = price[total] = 0
    known = np.flatnonzero(price >= 0)
    wide = np.flatnonzero(np.diff(known) > grain)
    for a, b in zip(known[wide].tolist(), known[wide + 1].tolist()):
        price[a + grain:b:grain] = inner_cost
    places = np.flatnonzero(price >= 0)
    return places, price[places]


def windows(ids: np.ndarray, first: np.ndarray, ends_sentence: np.ndarray, block: int,
            costs: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, document) of each piece, a window at a time, for documents whose ids begin at ``first``; its last value
    is the end. More than ``block`` tokens, as of a very long document, are planned a block at a time."""
    for base in range(0, len(ids), block):
        total = min(block, len(ids) - base)
        inside = first[np.searchsorted(first, base, "right"):np.searchsorted(first, base + total)] - base
        sentences = np.flatnonzero(ends_sentence[ids[base:base + total]]) + 1
        places, prices = cut_places(inside, sentences, total, **costs)
        cuts = places[least_cost_cuts(places, prices, costs["size"])] + base
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            docs = np.arange(np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b))
            yield np.maximum(first[docs], a), np.minimum(first[docs + 1], b), docs


class Packer:
    """Packs documents into sequences of at most ``size`` tokens, in stored order, with little padding.

    ``docs`` needs doc_id and text. Each document is its ids by the tokenizers file at ``path`` and the id ``end``; null
    and empty texts are the end alone. A cut between sentences costs as much as ``sentence_cost`` tokens of padding, one
    inside a sentence ``inner_cost``. Windows of a power of two are taken as free of padding.

    Nothing is shuffled or gathered: every task packs the rows of its own input, a block at a time, and a block's
    last window is the only one that need not be full. A row is a document of its own, also where ids are null or
    repeat. An empty table gives none. Other columns are ignored. Sequence ids begin with the number of the input
    partition, so a task that runs again gives the same rows.
    """

    def __init__(self, docs: DataFrame, path: str, size: int = 4096, end: int = 2, sentence_cost: int = 2,
                 inner_cost: int = 8, grain: int = 64, block: int = BLOCK):
        if not 1 <= size <= block or not 1 <= grain <= size:
            raise ValueError("1 <= grain <= size <= block")
        self.docs, self.path, self.size, self.end, self.block = narrow(docs), path, size, end, block
        self.costs = {"size": size, "grain": grain, "sentence_cost": sentence_cost, "inner_cost": inner_cost}

    def pieces(self) -> DataFrame:
        """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece."""
        return self._pieces("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", False)

    def sequences(self) -> DataFrame:
        """``pieces`` with their ``ids``."""
        return self._pieces("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
                            "ids array<int>", True)

    def _pieces(self, schema: str, with_ids: bool) -> DataFrame:
        path, block, last, costs = self.path, self.block, self.end, self.costs
        names = [part.split()[0] for part in schema.split(", ")]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = encoder(path)
            ends_sentence = codec.ends if last < len(codec.ends) else np.append(codec.ends, np.zeros(last + 1 - len(codec.ends), bool))
            sequence = TaskContext.get().partitionId() << 33
            held: list[np.ndarray] = []
            names_of: list[int | None] = []
            size = 0

            def flush() -> Iterator[pa.RecordBatch]:
                nonlocal sequence
                ids = np.concatenate(held)
                first = np.cumsum([0, *map(len, held)])
                held.clear()
                columns: list[list] = [[] for _ in names]
                for starts, ends, docs in windows(ids, first, ends_sentence, block, costs):
                    for a, b, d in zip(starts.tolist(), ends.tolist(), docs.tolist()):
                        row = (names_of[d], a - int(first[d]), b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()),
                               int(first[d + 1] - first[d]), sequence, a - int(starts[0]), *((ids[a:b],) if with_ids else ()))
                        for column, value in zip(columns, row):
                            column.append(value)
                    sequence += 1
                names_of.clear()
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]),
                                                  *(pa.array(c, pa.list_(pa.int32())) for c in columns[7:])], names)

            for batch in chunks(batches):
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                coded = [codec.encode(texts[0])] if len(texts) == 1 else codec.encode_all(texts)
                for i, ids in zip(batch.column("doc_id").to_pylist(), coded):
                    held.append(np.append(ids, np.int32(last)))
                    names_of.append(i)
                    size += len(ids) + 1
                    if size >= block:
                        yield from flush()
                        size = 0
            if held:
                yield from flush()

        return self.docs.mapInArrow(scan, schema)
