"""Bounded samples of labelled documents, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id and text only, of known types; other columns cannot clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: dict[str, str], size: int, where: Column | None = None,
                    seed: int = 11) -> DataFrame:
    """At most ``size`` labelled ids with their text and label expressions, the ids of least hash.

    Labels that are null are left out; of labels that contradict each other for one id the smallest counts.
    The sampled side is bounded by ``size`` rows, so it is broadcast to the documents.
    """
    found = labels.select(labels["doc_id"].cast("long").alias("doc_id"), *(F.expr(e).cast("int").alias(n) for n, e in columns.items()))
    found = found.dropna().groupBy("doc_id").agg(*(F.min(n).alias(n) for n in columns))
    if where is not None:
        found = found.where(where)
    found = found.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(size)
    return narrow(docs).join(F.broadcast(found), "doc_id").dropDuplicates(["doc_id"])
