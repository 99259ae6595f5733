"""Spelling variants of a corpus vocabulary by finite-state composition.

Near words are the pairs accepted by A o E o A, where A is the minimal acceptor of the vocabulary and E a transducer of
one replaced or inserted code point. The composition is enumerated in parts. Two words of which the shorter has m
code points agree in the first half of its places or in the last, wherever the edit is: A is entered at the states behind every
first half, and its mirror image at those behind every last half. Each such state is a group of words that agree in
fixed places, with its own acceptor of what lies between. A group too large for one task is entered further in,
behind half of what is left, until at most two code points vary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.llm.labelled import narrow
from landgrid.llm.store import keep
from landgrid.llm.tokens import LOWER, chunks, segments

RUN = re.compile("[a-zÀ-ÿ]+")
ASCII_LOWER = bytes(LOWER.tolist())
FLUSH = 200_000
#: Words of one acceptor. Groups of at most two varying places hold fewer: 90 letters give 90 + 90 * 90 of them.
GROUP = 20_000


class Acceptor:
    """Minimal acceptor of sorted, distinct words of one length: state 0 is final, ``root`` the initial one."""

    def __init__(self, words: list[str]):
        self.moves: list[dict[str, int]] = [{}]
        self.register: dict[tuple, int] = {}
        path: list[dict[str, int]] = [{}]
        last = ""
        for word in words:
            same = 0
            while same < len(last) and last[same] == word[same]:
                same += 1
            self._close(path, last, same)
            path.extend({} for _ in range(len(word) - same))
            last = word
        self._close(path, last, 0)
        self.root = self._state(path[0]) if words else 0

    def _state(self, moves: dict[str, int]) -> int:
        """The one state with these moves."""
        if not moves:
            return 0
        known = self.register.setdefault(tuple(moves.items()), len(self.moves))
        if known == len(self.moves):
            self.moves.append(moves)
        return known

    def _close(self, path: list[dict[str, int]], word: str, depth: int) -> None:
        """States of ``word`` below ``depth`` are complete: from the end on, each becomes the state it equals."""
        while len(path) > depth + 1:
            done = path.pop()
            path[-1][word[len(path) - 1]] = self._state(done)


def shared(a: list[dict[str, int]], p: int, b: list[dict[str, int]], q: int) -> Iterator[str]:
    """Words accepted both from ``p`` of one acceptor and from ``q`` of the other."""
    stack = [(p, q, "")]
    while stack:
        p, q, word = stack.pop()
        if not a[p] and not b[q]:
            yield word
            continue
        there = b[q]
        for letter, to in a[p].items():
            if letter in there:
                stack.append((to, there[letter], word + letter))


def one_edit_pairs(short: list[str], long: list[str], at_end: bool) -> Iterator[tuple[str, str]]:
    """Pairs of ``short`` words with one code point replaced, and pairs of a short and a ``long`` word with one more
    code point, each once: an inserted code point counts where the words first differ. ``at_end`` tells whether it
    may stand behind the last one. Words of either list are sorted, distinct and of one length."""
    a, b = Acceptor(short), Acceptor(long)
    one, two = a.moves, b.moves
    stack = [(a.root, b.root if long else None, "")]
    while stack:
        p, q, head = stack.pop()
        moves = list(one[p].items())
        for i, (x, to_x) in enumerate(moves):
            for y, to_y in moves[i + 1:]:
                for rest in shared(one, to_x, one, to_y):
                    yield head + x + rest, head + y + rest
        if q is not None:
            for y, to_y in two[q].items():
                if not moves:
                    if at_end:
                        yield head, head + y
                    continue
                for x, to_x in moves:
                    if x != y and x in two[to_y]:
                        for rest in shared(one, to_x, two, two[to_y][x]):
                            yield head + x + rest, head + y + x + rest
        for x, to_x in moves:
            stack.append((to_x, two[q].get(x) if q is not None else None, head + x))


class SpellingGroups:
    """Groups the words of a corpus by spelling.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. To have misspellings of known origin, a run
    whose CRC-32 of ``<doc_id>:<run>`` is a multiple of ``slip`` loses the code point at that value modulo its length; 0 turns this off.
    Of the results, those of ``least_length`` code points and ``least_count`` occurrences are the vocabulary. The form of a word is the
    most frequent word one edit away (ties: the smallest in code-point order), if that has ``ratio`` times its occurrences.

    Null and empty texts have no words; a null id is written as nothing before the colon. Rows that repeat an id are
    counted as they stand. An empty table has no words. Other columns are ignored.
    """

    def __init__(self, docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, slip: int = 97, group: int = GROUP):
        if ratio < 2 or least_length < 1:
            raise ValueError("forms need at least twice the occurrences, and words a code point")
        self.docs, self.least_length, self.least_count, self.ratio, self.slip = narrow(docs), least_length, least_count, ratio, slip
        self.group = group

    def vocabulary(self) -> DataFrame:
        """(word, n) with occurrences over all texts."""
        least, slip = self.least_length, self.slip

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter[str] = Counter()

            def out() -> pa.RecordBatch:
                batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
                found.clear()
                return batch

            for batch in chunks(batches):
                for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    seed = zlib.crc32(b"" if i is None else b"%d" % i)
                    seed = zlib.crc32(b":", seed)
                    for part in segments((text or "").encode().translate(ASCII_LOWER)):
                        for run, n in Counter(RUN.findall(part.decode())).items():
                            if len(run) >= least:
                                h = zlib.crc32(run.encode(), seed)
                                if slip and h % slip == 0:
                                    at = h % len(run)
                                    run = run[:at] + run[at + 1:]
                                    if len(run) < least:
                                        continue
                                found[run] += n
                        if len(found) > FLUSH:
                            yield out()
            yield out()

        counted = self.docs.mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        return counted.where(F.col("n") >= self.least_count)

    def _inward(self, rows: DataFrame) -> DataFrame:
        """Each group (m, low, high, fixed) entered behind the first and behind the last half of its varying places."""
        gap = F.col("m") - F.col("low") - F.col("high")
        half = F.floor(gap / 2).cast("int")
        cut = lambda start, size: F.substring("mid", start, size)
        first = F.struct((F.col("low") + half).alias("low"), F.col("high"), F.concat(
            F.expr("substring(fixed, 1, low)"), cut(F.lit(1), half), F.expr("substring(fixed, low + 1)")).alias("fixed"),
            cut(half + 1, F.char_length("mid")).alias("mid"))
        left = F.char_length("mid") - (gap - half)
        last = F.struct(F.col("low"), (F.col("high") + gap - half).alias("high"), F.concat(
            F.expr("substring(fixed, 1, low)"), cut(left + 1, gap - half), F.expr("substring(fixed, low + 1)")).alias("fixed"),
            cut(F.lit(1), left).alias("mid"))
        return rows.select("m", "n", F.explode(F.array(first, last)).alias("at")).select("m", "at.low", "at.high", "at.fixed", "at.mid", "n")

    def _groups(self, words: DataFrame) -> DataFrame:
        """Rows (m, low, high, fixed, mid, n): words of m or m + 1 code points by their first ``low`` and last ``high`` ones."""
        size = F.char_length("word")
        whole = words.select(F.explode(F.array(size - 1, size)).alias("m"), F.lit(0).alias("low"), F.lit(0).alias("high"),
                             F.lit("").alias("fixed"), F.col("word").alias("mid"), "n").where(F.col("m") >= self.least_length)
        fresh, settled, key = self._inward(whole), None, ["m", "low", "high", "fixed"]
        while True:
            fresh = keep(fresh, "groups")
            large = fresh.where(F.col("m") - F.col("low") - F.col("high") > 1).groupBy(key).count().where(F.col("count") > self.group)
            large = keep(large.select(key), "large")
            if large.isEmpty():
                return fresh if settled is None else settled.unionByName(fresh)
            small = fresh.join(large, key, "left_anti")
            settled = small if settled is None else settled.unionByName(small)
            fresh = self._inward(fresh.join(large, key, "left_semi"))

    def near(self, words: DataFrame) -> DataFrame:
        """(word, n, n_near, best): number of words one edit away and the most frequent of them, for words that have any."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []

            def cut() -> pa.RecordBatch:
                columns = list(zip(*out)) or [()] * 5
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                    pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["word", "n", "n_near", "best_n", "best"])

            for (m, low, high, fixed), run in groupby(rows(batches), lambda r: r[:4]):
                first = next(run)
                second = next(run, None)
                if second is None:
                    continue
                short, long, count = [], [], {}
                for row in (first, second, *run):
                    (short if len(row[4]) == m - low - high else long).append(row[4])
                    count[row[4]] = row[5]
                if not short:
                    continue
                n_near: Counter[str] = Counter()
                best: dict[str, str] = {}
                for x, y in one_edit_pairs(short, long, high == 0):
                    for a, b in ((x, y), (y, x)):
                        n_near[a] += 1
                        now = best.get(a)
                        if now is None or (-count[b], b) < (-count[now], now):
                            best[a] = b
                head, tail = fixed[:low], fixed[low:]
                out += [(head + a + tail, count[a], n, count[best[a]], head + best[a] + tail) for a, n in n_near.items()]
                if len(out) > FLUSH:
                    yield cut()
            yield cut()

        key = ["m", "low", "high", "fixed"]
        grouped = self._groups(words).select(*key, "mid", "n").repartition(*key).sortWithinPartitions(*key, F.char_length("mid"), "mid")
        found = grouped.mapInArrow(scan, "word string, n long, n_near long, best_n long, best string")
        best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
        return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("top")).select(
            "word", "n", "n_near", (-F.col("top.less")).alias("best_n"), "top.best")

    def groups(self) -> DataFrame:
        """(word, form, root, n, n_near, form_n) of the vocabulary; the root is where forms lead in the end."""
        words = keep(self.vocabulary(), "vocabulary")
        fits = F.col("best_n") >= self.ratio * F.col("n")
        near = keep(self.near(words).select("word", "n_near", F.when(fits, F.col("best")).alias("form"),
                                            F.when(fits, F.col("best_n")).alias("form_n")), "near")
        # A form has twice the occurrences, so chains end; each round doubles the steps taken.
        roots = keep(near.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
        while not roots.where("moved").isEmpty():
            step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
            roots = keep(roots.join(step, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        return words.join(near, "word", "left").join(roots.select("word", "root"), "word", "left").select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
