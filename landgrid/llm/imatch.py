"""I-Match document fingerprints with DataFrame functions only.

Terms are runs of letters, lower-cased in A-Z. The lexicon keeps terms of a middle band of inverse document
frequency: in two documents at least, in a share ``common`` of all at most, and of those the ``lexicon`` most
frequent ones, a number that bounds what is sent to the executors. A fingerprint hashes the sorted distinct
lexicon terms of a document, and again those in each of 48 random lexicon subsets: 16 that hold a sixteenth
of the lexicon each and 32 that hold 1/256, drawn by digits of the term's md5. Likeness is the share of equal
hashes among subsets of which either document has a term: large subsets tell near copies apart, small ones
texts that share a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[a-z\x{80}-\x{10FFFF}]+"
DIGITS = "0123456789abcdef"
BUCKETS = 65_536
TOP_TASKS = 64  # each task sends its own first terms to the driver, so their number is bounded


def terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LETTERS), F.lit(0)))


class IMatch:
    """Fingerprints of ``docs`` and of texts put in their place.

    A null text is empty; texts without lexicon terms share one fingerprint. Extra columns are ignored. Rows that
    repeat a doc_id follow each other by their text. Rows with null doc_id have no next document: their later half
    is cut off in the edited text and near_next is 0.
    """

    def __init__(self, docs: DataFrame, lexicon: int = 4096, common: float = 0.2, bucket_rows: int = 256):
        self.docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
        self.lexicon, self.common, self.bucket_rows = lexicon, common, bucket_rows

    def chosen_terms(self) -> list[str]:
        """The lexicon, ``lexicon`` terms at most."""
        total = self.docs.count()
        found = self.docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        band = found.where((F.col("df") >= 2) & (F.col("df") <= self.common * total))
        return [r["term"] for r in band.coalesce(TOP_TASKS).orderBy(F.desc("df"), "term").limit(self.lexicon).collect()]

    @staticmethod
    def fingerprinted(rows: DataFrame, text: str, chosen: list[str], out: str) -> DataFrame:
        """``rows`` with an array of 49 hashes of 8 digits, of the whole lexicon first; 8 dashes where a subset has no
        term. Steps are columns of their own, since an expression that is named twice is computed twice."""
        if not chosen:
            return rows.withColumn(out, F.array_repeat(F.lit("-" * 8), 49))
        known = F.col("known")
        digest = F.transform(known, lambda t: F.concat(F.md5(t), t))
        wide = F.transform("named", lambda t: F.concat(F.lit("1"), F.substring(t, 1, 1), F.lit("\x02"), F.substring(t, 33, 1 << 20)))
        rare = F.filter("named", lambda t: F.substring(t, 2, 1) < "2")
        narrow = F.transform(rare, lambda t: F.concat(F.lit("2"), F.substring(t, 2, 2), F.lit("\x02"), F.substring(t, 33, 1 << 20)))
        # Sorted, a mark stands before the terms of its subset; cutting at the marks leaves a part per subset.
        marks = F.array(*(F.lit(f"{k}{d}\x01") for k in ("1", "20", "21") for d in DIGITS))
        parts = F.split(F.array_join(F.sort_array(F.concat(marks, wide, narrow)), ""), "(1|2[01])[0-9a-f]\x01")
        every = F.concat(F.array(F.array_join(F.sort_array(known), " ")), F.slice(parts, 2, 48))
        hashed = F.transform("every", lambda s: F.when(s == "", F.lit("-" * 8)).otherwise(F.substring(F.md5(s), 1, 8)))
        rows = rows.withColumn("known", F.array_intersect(F.split(F.lit(" ".join(chosen)), " "), terms(F.col(text))))
        return rows.withColumn("named", digest).withColumn("every", every).withColumn(out, hashed).drop("known", "named", "every")

    @staticmethod
    def likeness(a: Column, b: Column) -> Column:
        pairs = F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), 2, 48)
        some = F.filter(pairs, lambda p: (p["x"] != "-" * 8) | (p["y"] != "-" * 8))
        same = F.filter(some, lambda p: p["x"] == p["y"])
        return F.when(F.size(some) == 0, F.lit(1.0)).otherwise(F.size(same) / F.size(some))

    def _dealt(self) -> DataFrame:
        """Documents in buckets of neighbouring ids, each bucket with a guest: the first document of the next one."""
        ids = self.docs.where("doc_id is not null")
        low, high, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
        if not n:
            return self.docs.select("doc_id", "text", F.lit(0).alias("bucket"), F.lit(False).alias("guest"))
        buckets = min(BUCKETS, -(-n // self.bucket_rows))
        width = max(1.0, (float(high) - float(low) + 1) / buckets)
        bucket = F.floor((F.col("doc_id").cast("double") - F.lit(float(low))) / F.lit(width)).cast("int")
        # One row per bucket, BUCKETS at most.
        heads = sorted((r["bucket"], r["head"]) for r in ids.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("head")).collect())
        above = [b for b, _ in heads[1:]] + [heads[0][0]]
        visits = self.docs.sparkSession.createDataFrame(
            [(head, b) for (_, head), b in zip(heads, above)], "doc_id long, visits int")
        rows = self.docs.join(F.broadcast(visits), "doc_id", "left")
        places = F.array_compact(F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("guest")),
                                         F.when(F.col("visits").isNotNull(), F.struct(F.col("visits").alias("bucket"), F.lit(True).alias("guest")))))
        return rows.select("doc_id", "text", F.inline(places))

    def compare(self) -> DataFrame:
        """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each document
        against itself with its later half replaced by the beginning of the next one, by descending doc_id."""
        chosen = self.chosen_terms()
        rows = self._dealt().repartition("bucket", F.col("doc_id").isNull())
        rows = self.fingerprinted(rows, "text", chosen, "f")
        order = Window.partitionBy("bucket", F.col("doc_id").isNull()).orderBy("guest", F.desc("doc_id"), "text")
        row_next = rows.withColumns({"next_text": F.lead("text").over(order), "next_f": F.lead("f").over(order)}).where("not guest")
        known = F.col("doc_id").isNotNull()
        row_next = row_next.withColumns({"next_text": F.when(known, F.col("next_text")), "next_f": F.when(known, F.col("next_f")),
                                         "n": F.char_length("text")})
        half = F.floor(F.col("n") / 2).cast("int")
        edited = F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.coalesce(F.substring("next_text", F.lit(1), half), F.lit("")))
        out = self.fingerprinted(row_next.withColumn("edited", edited), "edited", chosen, "g")
        return out.select(
            "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
            F.array_join("f", "").alias("fingerprint"), F.array_join("g", "").alias("edited_fingerprint"),
            self.likeness(F.col("f"), F.col("g")).alias("near_edited"),
            F.coalesce(self.likeness(F.col("f"), F.col("next_f")), F.lit(0.0)).alias("near_next"))
