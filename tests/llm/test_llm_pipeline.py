"""The pipeline's stages against what they promise, and the queries with SQL against it."""

import hashlib

import hard
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from landgrid.llm.store import keep
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ("op2_document_fingerprints", "op9_substring_dedup"))
def test_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    cur = duck(SF).execute(entry.oracle_sql()[name])
    assert compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in cur.description], cur.fetchall()) == ""


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF), name)
        kept[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == columns
    good = {r["doc_id"]: r["text"] for r in kept["quality_classifier"]}
    assert all(texts[i] == t for i, t in good.items())
    assert sum(labels[i] == 1 and i not in good for i in labels) <= 1 and sum(labels[i] == 0 and i in good for i in labels) <= 1
    lines = {r["doc_id"]: r["text"] for r in kept["line_dedup"]}
    for i, t in lines.items():
        have = iter(good[i].split("\n"))
        assert all(any(x == y for y in have) for x in t.split("\n"))  # lines go, none changes its place
    exact = [x for i in sorted(lines) for x in lines[i].split("\n") if any(ord(c) > 32 for c in x)]
    assert len(exact) == len(set(exact))
    near = {r["doc_id"]: r["text"] for r in kept["ngram_jaccard_join"]}
    sets = {i: hard.shingles(t) for i, t in lines.items()}
    group = hard.groups(sets, lambda a, b: hard.alike(sets[a], sets[b]))
    assert near == {i: t for i, t in lines.items() if group[i] == i}
    mixed = kept["mixing_weights"]
    assert {r["doc_id"] for r in mixed} == set(near) and all(near[r["doc_id"]] == r["text"] for r in mixed)
    last = kept["byte_bpe"]
    assert len(last) == len(mixed)
    assert all(r["decoded_sha256"] == hashlib.sha256(near[r["doc_id"]].encode()).hexdigest() for r in last)
