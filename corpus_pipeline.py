"""A training corpus from the documents table: five stages, each written as Parquet and read by the next.

1. Documents that the quality classifier scores below one half go.
2. Lines that are near copies of earlier lines go, and documents of which nothing but such lines is left.
3. Of documents that reach 0.8 of Jaccard likeness on five-word shingles, directly or through others, the one of
   smallest id stays.
4. Documents are repeated so that languages get equal numbers of tokens; none is lost.
5. Texts are encoded with a byte-level BPE vocabulary and decoded again.

Null and empty texts pass stages 2 to 5 as they are; rows without an id pass stage 3. Ids are taken to be unique: of rows that repeat
one with different texts stage 3 keeps one, whichever Spark meets first. Other columns stay up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.llm.jaccard import JaccardJoin
from landgrid.llm.lines import LineDedup
from landgrid.llm.mixing import SoftMixer
from landgrid.llm.quality import QualityClassifier
from landgrid.llm.queries import encoded, labelled_domains, table
from landgrid.llm.store import keep


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = QualityClassifier(docs, table(spark, sf_dir, "labels")).scored(docs)
    return judged.where("score >= 0.5").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = LineDedup(docs).cut().where("n_removed = 0 or n_left > 0")
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = JaccardJoin(docs).components().where("doc_id is not null")
    first = groups.where("doc_id = component_id").select("doc_id")
    kept = docs.join(first.distinct(), "doc_id", "left_semi")
    if not first.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(docs.columns)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    domains = labelled_domains(docs, table(spark, sf_dir, "labels"))
    return SoftMixer(docs, domains, least=1.0, room=1.1).mixed()


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(spark, docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing_weights", mix_languages),
    ("byte_bpe", encode),
]

#: Learned models and near copies by shingles have no SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
