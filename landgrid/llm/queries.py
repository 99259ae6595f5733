"""The registered queries of the corpus operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.llm.bpe import ByteBpe
from landgrid.llm.imatch import IMatch
from landgrid.llm.jaccard import JaccardJoin
from landgrid.llm.lines import LineDedup
from landgrid.llm.mixing import SoftMixer
from landgrid.llm.neighbours import ForestIndex
from landgrid.llm.packing import Packer
from landgrid.llm.quality import QualityClassifier
from landgrid.llm.resampling import ImportanceResampler
from landgrid.llm.spelling import SpellingGroups
from landgrid.llm.store import small_batches
from landgrid.llm.substrings import SubstringDedup
from landgrid.llm.toxicity import ToxicityChain
from landgrid.llm.urls import UrlFilter
from landgrid.plans.common import Query, register

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
query = register(QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(table(spark, sf_dir, "documents")).components()


@query("op9_substring_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SubstringDedup(table(spark, sf_dir, "documents")).run()


ORACLES["op9_substring_dedup"] = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram FROM p WHERE i + 12 <= len(ws)),
f AS (SELECT gram, min(doc_id) AS first_doc FROM g GROUP BY gram),
hit AS (SELECT g.doc_id, g.i FROM g JOIN f USING (gram) WHERE f.first_doc < g.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit),
kept AS (SELECT p.doc_id, string_agg(p.ws[p.i], ' ' ORDER BY p.i) AS kept FROM p
         LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i WHERE gone.i IS NULL GROUP BY p.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


@query("op10_nearest_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ForestIndex(table(spark, sf_dir, "embeddings"))
    queries = index.points.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return index.nearest(queries)


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return QualityClassifier(docs, table(spark, sf_dir, "labels")).judge(docs)


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ToxicityChain(docs, table(spark, sf_dir, "labels")).judge(docs)


@query("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LineDedup(table(spark, sf_dir, "documents")).cut().select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def encoded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    codec = ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = codec.encode(docs)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2(codec.decode(F.col("ids")), 256).alias("decoded_sha256"))


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, table(spark, sf_dir, "documents"))


@query("op2_document_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IMatch(table(spark, sf_dir, "documents")).compare()


ORACLES["op2_document_fingerprints"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, lead(t) OVER (ORDER BY doc_id DESC) AS l, lead(doc_id) OVER (ORDER BY doc_id DESC) AS li,
      first_value(t) OVER (ORDER BY doc_id DESC) AS f, first_value(doc_id) OVER (ORDER BY doc_id DESC) AS fi FROM d),
e AS (SELECT doc_id, n, t, coalesce(li, fi) AS next_id, substring(t, 1, n - n // 2) || substring(coalesce(l, f), 1, n // 2) AS x FROM o),
both_ AS (SELECT doc_id, 0 AS k, t AS s FROM d UNION ALL SELECT doc_id, 1, x FROM e),
w AS (SELECT DISTINCT doc_id, k, unnest(regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM both_),
lex AS (SELECT term FROM (SELECT term, count(*) AS df FROM w WHERE k = 0 GROUP BY term)
        WHERE df >= 2 AND df <= 0.2 * (SELECT count(*) FROM documents) ORDER BY df DESC, term LIMIT 4096),
known AS (SELECT doc_id, k, term, md5(term) AS h FROM w JOIN lex USING (term)),
tagged AS (SELECT doc_id, k, '1' || substring(h, 1, 1) AS tag, term FROM known
           UNION ALL SELECT doc_id, k, '2' || substring(h, 2, 2), term FROM known WHERE substring(h, 2, 1) < '2'),
part AS (SELECT doc_id, k, tag, substring(md5(string_agg(tag || chr(2) || term, '' ORDER BY term)), 1, 8) AS v
         FROM tagged GROUP BY doc_id, k, tag
         UNION ALL SELECT doc_id, k, '00', substring(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) FROM known GROUP BY doc_id, k),
tags AS (SELECT '00' AS tag UNION ALL SELECT a || b FROM (SELECT unnest(['1', '20', '21']) AS a), (SELECT unnest(string_split('0 1 2 3 4 5 6 7 8 9 a b c d e f', ' ')) AS b)),
slot AS (SELECT b.doc_id, b.k, tags.tag, coalesce(part.v, '--------') AS v FROM both_ b CROSS JOIN tags
         LEFT JOIN part ON part.doc_id = b.doc_id AND part.k = b.k AND part.tag = tags.tag),
print AS (SELECT doc_id, k, string_agg(v, '' ORDER BY tag) AS p FROM slot GROUP BY doc_id, k),
near AS (SELECT e.doc_id, y.k, count(*) FILTER (x.v <> '--------' OR y.v <> '--------') AS n,
                count(*) FILTER (x.v = y.v AND x.v <> '--------') AS m
         FROM e JOIN slot x ON x.doc_id = e.doc_id AND x.k = 0
         JOIN slot y ON y.tag = x.tag AND ((y.k = 1 AND y.doc_id = e.doc_id) OR (y.k = 0 AND y.doc_id = e.next_id))
         WHERE x.tag <> '00' GROUP BY e.doc_id, y.k)
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.x) AS edited_sha256, p0.p AS fingerprint, p1.p AS edited_fingerprint,
       CAST(CASE WHEN n1.n = 0 THEN 1 ELSE n1.m / n1.n END AS DOUBLE) AS near_edited,
       CAST(CASE WHEN n0.n = 0 THEN 1 ELSE n0.m / n0.n END AS DOUBLE) AS near_next
FROM e JOIN print p0 ON p0.doc_id = e.doc_id AND p0.k = 0 JOIN print p1 ON p1.doc_id = e.doc_id AND p1.k = 1
JOIN near n1 ON n1.doc_id = e.doc_id AND n1.k = 1 JOIN near n0 ON n0.doc_id = e.doc_id AND n0.k = 0
"""


@query("op3_url_filters")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return UrlFilter(table(spark, sf_dir, "pages")).judge()


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): languages of the documents in the label table."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id")


@query("op5_mixing_weights")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixer = SoftMixer(docs, labelled_domains(docs, table(spark, sf_dir, "labels")))
    return mixer.rated().select("doc_id", "n_tokens", "domain", "rate", "copies")


@query("op11_spelling_groups")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SpellingGroups(table(spark, sf_dir, "documents")).groups()


@query("op12_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Packer(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).pieces()


@query("op13_importance_resampling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = ImportanceResampler(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drawn()
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
