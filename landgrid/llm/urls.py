"""URL filter: rules by host and path, and a classifier of segmented names where no rule fits.

Host labels and path parts are cut into words by Viterbi over a unigram model of the words that the pages
themselves use. A multinomial naive Bayes model scores the words. It is trained on all pages with weak labels: pages
whose words include a seed word are unwanted, all others are not; words that go along with seeds
gain weight, common ones lose it.

Both models are written tables without a bound on their rows. A distinct name looks up its own substrings by a join,
and the words of a distinct address look up their odds by another; hot words are left to skew joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.llm.store import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict, host and path of the default rules (fixed values).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words of unwanted sites.
SEEDS = ("ads", "adult", "bet", "bets", "betting", "casino", "cheap", "escort", "farm", "gambling", "jackpot", "loans", "pills",
         "poker", "porn", "replica", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx")
#: Seeds that mark a page by themselves; the others only help to cut names.
STRONG = ("ads", "adult", "bets", "betting", "casino", "escort", "gambling", "jackpot", "pills", "poker", "porn", "slots", "spam",
          "viagra", "warez", "xxx")
LONGEST = 24


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; empty without "://"."""
    at = F.locate("://", url)
    after = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, null without one; of equally long ones the first by text."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Segmenter:
    """Best cut of a lower-case name into words of a unigram model; letters of no known word stay together.

    ``counts`` may be the part of a model that holds all words within the names to cut; ``total`` is then the sum of
    all counts of the model.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) + 1
        self.score = {w: math.log(c / total) for w, c in counts.items()}
        self.unknown = -math.log(total) - 2

    def __call__(self, name: str) -> list[str]:
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(name)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - LONGEST), end):
                word = name[start:end]
                value = self.score.get(word)
                if value is None:
                    value = self.unknown - 2.3 * len(word)
                value += best[start][0]
                if value > best[end][0]:
                    best[end] = (value, start)
        words, end = [], len(name)
        while end:
            start = best[end][1]
            words.append(name[start:end])
            end = start
        return words[::-1]


class UrlFilter:
    """Verdicts over a table (page_id, url, html).

    A null url, or one without "://", has an empty host and path and no words; it is allowed. Null html has no words.
    Every row gets one verdict, so rows that repeat are judged alike; extra columns are ignored. Words of the pages of
    over ``LONGEST`` letters are left out of the unigram model as a whole.
    """

    def __init__(self, pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES):
        host, path = host_path(F.col("url"))
        self.pages = pages.select(pages["page_id"], pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
        self.plain = self.pages.select("page_id", host.alias("host"), path.alias("path"))
        self.rules = rules
        self.counts = keep(self._unigrams(), "unigrams")
        self.addresses = keep(self._words(), "addresses")
        self.prior, self.odds = self._bayes()

    def _unigrams(self) -> DataFrame:
        """(word, n): counts of words of ASCII letters in the pages."""
        words = F.regexp_extract_all(F.translate("html", UPPER, LOWER), F.lit("[a-z]{2,}"), F.lit(0))
        words = F.filter(words, lambda w: F.char_length(w) <= LONGEST)
        return self.pages.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def _seeds(self) -> tuple[dict[str, int], int]:
        """Counts of the seeds, a thousandth of the largest count at least, and the sum of all counts with these."""
        total, most = self.counts.agg(F.sum("n"), F.max("n")).first()
        found = {r["word"]: r["n"] for r in self.counts.where(F.col("word").isin(*SEEDS)).collect()}
        floor = (most or 1000) // 1000 + 1
        seeds = {w: max(found.get(w, 0), floor) for w in SEEDS}
        return seeds, (total or 0) + sum(seeds.values()) - sum(found.values())

    def _cut(self, names: DataFrame) -> DataFrame:
        """(name, words): distinct names cut by the model. Each name meets the counts of its own substrings."""
        size = F.char_length("name")
        starts = names.where(size >= 2).select("name", F.explode(F.sequence(F.lit(1), size - 1)).alias("at"))
        lengths = F.sequence(F.lit(2), F.least(F.lit(LONGEST), size - F.col("at") + 1))
        parts = starts.select("name", F.explode(F.transform(lengths, lambda n: F.substring("name", F.col("at"), n))).alias("word"))
        found = parts.distinct().join(self.counts, "word").select("name", F.struct("word", "n").alias("f"))
        held = found.unionByName(names.select("name", F.lit(None).cast(found.schema["f"].dataType).alias("f")))
        seeds, total = self._seeds()

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = []
                for name, known in zip(batch.column("name").to_pylist(), batch.column("known").to_pylist()):
                    words.append(Segmenter({f["word"]: f["n"] for f in known} | seeds, total)(name))
                yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

        return held.groupBy("name").agg(F.collect_list("f").alias("known")).mapInArrow(scan, "name string, words array<string>")

    def _words(self) -> DataFrame:
        """(host, path, n, words, bad) of each distinct address with a name; n is its number of rows, words of the path
        begin with a slash."""
        pairs = self.plain.groupBy("host", "path").agg(F.count("*").alias("n"))
        of = lambda text, mark: F.transform(
            F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0)), lambda w: F.struct(F.lit(mark).alias("mark"), w.alias("name")))
        names = F.concat(of(F.col("host"), ""), of(F.translate("path", UPPER, LOWER), "/"))
        placed = pairs.select("host", "path", "n", F.posexplode(names).alias("at", "named")).select("host", "path", "n", "at", "named.*")
        cut = keep(self._cut(placed.select("name").distinct()), "names")
        marked = placed.join(cut, "name").select(
            "host", "path", "n", F.struct("at", F.transform("words", lambda w: F.concat("mark", w)).alias("words")).alias("w"))
        rows = marked.groupBy("host", "path", "n").agg(F.array_sort(F.collect_list("w")).alias("w"))
        strong = F.array(*map(F.lit, (*STRONG, *("/" + s for s in STRONG))))
        rows = rows.select("host", "path", "n", F.flatten("w.words").alias("words"))
        return rows.withColumn("bad", F.arrays_overlap("words", strong).cast("int"))

    def _bayes(self) -> tuple[float, DataFrame]:
        """Log prior odds of unwanted pages, and (word, odds): the log odds of each word, from counts over all pages."""
        n = self.plain.count()
        bad = self.addresses.agg(F.sum(F.col("n") * F.col("bad"))).first()[0] or 0
        counts = self.addresses.select("n", "bad", F.explode("words").alias("word")).groupBy("word").agg(
            F.sum(F.col("n") * F.col("bad")).alias("x"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("y"))
        counts = keep(counts, "tokens")
        a, b = counts.agg(F.sum(F.col("x") + 1), F.sum(F.col("y") + 1)).first()
        odds = F.log((F.col("x") + 1) / F.lit(float(a or 1))) - F.log((F.col("y") + 1) / F.lit(float(b or 1)))
        return math.log((bad + 1) / (n - bad + 1)), counts.select("word", odds.alias("odds"))

    def judge(self) -> DataFrame:
        """(page_id, host, path, rule, verdict, score, words): score is the log odds of an unwanted page."""
        placed = self.addresses.select("host", "path", F.posexplode("words").alias("at", "word"))
        # Added in the order of the words, so that a score does not depend on tasks.
        found = placed.join(self.odds, "word").groupBy("host", "path").agg(
            F.array_sort(F.collect_list(F.struct("at", "odds", "word"))).alias("w"))
        added = F.aggregate("w", F.lit(0.0), lambda s, w: s + w["odds"])
        found = found.select("host", "path", added.alias("odds"), F.col("w.word").alias("words"))
        rows = self.plain.join(found, ["host", "path"], "left")
        scored = rows.withColumns({"score": F.lit(self.prior) + F.coalesce("odds", F.lit(0.0)),
                                   "words": F.coalesce("words", F.array().cast("array<string>"))})
        ruled = scored.withColumn("r", rule_of(F.col("host"), F.col("path"), self.rules))
        own = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
        return ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"),
                            "score", "words")
