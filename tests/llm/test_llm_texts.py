"""Operators on texts against brute force, on the awkward table."""

import base64
import hashlib
import tracemalloc

import hard
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from landgrid.llm import tokens
from landgrid.llm.bpe import BITS, NEVER, ByteBpe, merge_long, pair_cells
from landgrid.llm.imatch import IMatch
from landgrid.llm.jaccard import JaccardJoin, band_starts, segment_counts, set_keys, tolerated
from landgrid.llm.lines import LineDedup, inked_lines, shingles
from landgrid.llm.queries import encoded
from landgrid.llm.queries import table as entry_table
from landgrid.llm.store import BATCH_BYTES
from landgrid.llm.substrings import SubstringDedup
from landgrid.llm.tokens import shingle_sets


def test_pigeonhole_index_finds_every_linked_pair(rows):
    """Each linked pair of different sets shares a key that one of the two probes."""
    texts = [t or "" for _, t in rows]
    for percent in (60, 80, 90):
        sets = shingle_sets(pa.array(texts), 5)
        keys = {}
        for k, o, p in zip(*(x.tolist() for x in set_keys(sets, percent))):
            keys.setdefault(o, {})[k] = keys.get(o, {}).get(k, False) or p
        plain = [hard.shingles(t) for t in texts]
        for a in range(len(texts)):
            for b in range(a):
                if hard.alike(plain[a], plain[b], percent):
                    shared = keys[a].keys() & keys[b].keys()
                    assert any(keys[a][k] or keys[b][k] for k in shared), (percent, rows[a][0], rows[b][0])


def test_bands_cover_every_partner():
    starts = band_starts(80)
    assert (starts[1:] > starts[:-1]).all() and (starts[:-2] * 100 // 80 < starts[1:-1]).all()
    assert (segment_counts(starts, 80) > tolerated(2 * (starts[1:] - 1), 80)).all()


def test_jaccard_components(docs, rows):
    sets = {i: hard.shingles(t) for i, t in rows}
    want = hard.groups(sets, lambda a, b: hard.alike(sets[a], sets[b]))
    join = JaccardJoin(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join.components().collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = sorted(first.values())
    links = {(b, a) for a in reps for b in reps if a < b and hard.alike(sets[a], sets[b])}
    assert {(r["a"], r["b"]) for r in join.links().collect()} == links


def test_jaccard_empty_null_ids_and_repeats(spark, none):
    assert JaccardJoin(none).components().count() == 0
    some = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "A B C D E F")], "doc_id long, text string")
    got = sorted(map(tuple, JaccardJoin(some).components().select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == [(3, 2, 3), (3, 2, 3), (5, 2, 3), (None, 2, 3)] or got[:3] == [(3, 2, 3), (3, 2, 3), (5, 2, 3)]


def test_substrings(docs, rows):
    want = hard.kept_words(rows)
    got = {r["doc_id"]: r for r in SubstringDedup(docs).run().collect()}
    assert set(got) == set(want)
    for i, (words, kept) in want.items():
        sha = hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(words), len(words) - len(kept), sha), i


def test_substrings_take_failed_paths_apart(docs, rows, monkeypatch):
    """With every path forced together by a false size, digests differ and windows are compared instead."""
    real = SubstringDedup.paths

    def stretched(repeated):
        return real(repeated).withColumn("size", F.col("size") + 1)

    monkeypatch.setattr(SubstringDedup, "paths", staticmethod(stretched))
    want = hard.kept_words(rows)
    got = {r["doc_id"]: r["n_removed"] for r in SubstringDedup(docs.where("doc_id <> 23")).run().collect()}
    small = hard.kept_words([r for r in rows if r[0] != 23])
    assert all(got[i] == len(w) - len(k) for i, (w, k) in small.items()) and len(want) == len(got) + 1


def test_substrings_empty_null_ids_and_repeats(spark, none):
    assert SubstringDedup(none).run().count() == 0
    text = " ".join("abcdefghijklmnop")
    some = spark.createDataFrame([(None, text), (3, text), (3, text), (5, text)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in SubstringDedup(some).run().collect()), key=str)
    assert got == [(3, 16, 0), (5, 16, 16), (None, 16, 0)]


def line_sets(text):
    out = []
    for k, line in enumerate((text or "").split("\n")):
        raw = line.translate(hard.ASCII_LOWER).encode()
        if any(c > 32 for c in raw):
            out.append((k, frozenset(raw[i:i + 8] for i in range(max(1, len(raw) - 7)))))
    return out


def test_lines(docs, rows):
    """The banding is made sure here by many bands of one row, so the result is that of brute force."""
    small = [r for r in rows if r[0] not in (22, 24)]
    lines = [(i, k, s) for i, t in sorted(small) for k, s in line_sets(t)]
    group = hard.groups(range(len(lines)), lambda a, b: hard.alike(lines[a][2], lines[b][2]))
    gone = {(i, k) for n, (i, k, _) in enumerate(lines) if group[n] != n}
    kept = docs.where("doc_id not in (22, 24)")
    got = {(r["doc"], r["place"]) for r in LineDedup(kept, bands=24, rows=2).removed().collect()}
    assert got == gone
    cut = {r["doc_id"]: r["text"] for r in LineDedup(kept, bands=24, rows=2).cut().collect()}
    for i, text in small:
        want = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)
        assert cut[i] == want
    assert LineDedup(docs).cut().columns == [c for c in docs.columns] + ["n_lines", "n_removed", "n_left"]


def test_lines_empty_and_null_ids(spark, none):
    assert LineDedup(none).cut().count() == 0
    some = spark.createDataFrame([(None, "a line of text"), (None, None), (3, "a line of text"), (4, "a line of text")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in LineDedup(some).cut().collect()), key=str)
    assert got == [(3, 0), (4, 1), (None, 0), (None, 0)]


@pytest.fixture(scope="module")
def tokenizer():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs, rows, none, tokenizer):
    got = {r["doc_id"]: r for r in encoded(spark, docs).collect()}
    for i, text in rows:
        ids = tokenizer[1].encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids), i
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), i
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest(), i
    assert encoded(spark, none).count() == 0


def test_bpe_looks_up_several_cuts_at_once(spark, tokenizer):
    """Texts of over four megabytes in one block, whose pieces are cut a megabyte at a time; a worker keeps one table of powers."""
    rows = [(i, f"Line {i % 3} of naïve words, don't ask.\n" * n) for i, n in enumerate((20_000, 1, 40_000, 0, 30_000, 50_000, 7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    codec = ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r["doc_id"]: list(r["ids"]) for r in codec.encode(docs).collect()}
    assert got == {i: tokenizer[1].encode_ordinary(text) for i, text in rows}
    large, small = tokens.powers(50_000), tokens.powers(10)
    assert small[0] is large[0] and small[1] is large[1]


def test_bpe_queue_is_the_fold(spark, tokenizer):
    ranks, encoding = tokenizer
    pieces = ["thertion", "xxxxxxxxxx", "aaaabaaaab", "éèéèéè", "!!!!!!!", " something"]
    for p in pieces:
        assert merge_long(p.encode(), ranks) == encoding.encode_ordinary(p)
    codec = ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    made = codec.encode_pieces(spark.createDataFrame([(p,) for p in pieces], "piece string"))
    assert {r["piece"]: list(r["ids"]) for r in made.collect()} == {p: encoding.encode_ordinary(p) for p in pieces}


def test_bpe_pairs_in_one_array(tokenizer):
    """Each pair of tokens that joins to a token is found in the cells, others are not."""
    ranks, _ = tokenizer
    base, cells = pair_cells(ranks)
    pairs = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
    some = list(pairs)[::7] + [(a, b) for a in range(0, len(ranks), 997) for b in range(0, len(ranks), 991)]
    for a, b in some:
        at = base[a] + b
        joined = int(cells[at]) ^ (a + 1) << BITS if 0 <= at < len(cells) else NEVER
        assert pairs.get((a, b), NEVER) == min(joined, NEVER), (a, b)


def test_near_lines_of_a_band_give_few_links(spark):
    """Lines that are all near each other and share a band: links join them, but they are fewer than the lines."""
    base = "the quick brown fox jumps over the lazy dog and runs along the river bank until it meets the sleeping bear " * 2
    lines = [base[:k] + chr(97 + k % 26) * 2 + base[k + 2:] for k in range(0, 200, 2)] + ["something else entirely that has no part in it at all"]
    found = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(lines)], "name long, line binary")
    members = spark.createDataFrame([(k, i, i) for k in (7, 8) for i in range(len(lines))], "key long, doc long, part long")
    sets = [frozenset(t[i:i + 8] for i in range(len(t) - 7)) for t in lines]
    want = hard.groups(range(len(lines)), lambda a, b: hard.alike(sets[a], sets[b]))
    dedup = LineDedup(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    for block in (4096, 16):  # whole, and dealt out as pairs of blocks
        rows = dedup.bridges(members, found, block=block).collect()
        links = {(r["a"], r["b"]) for r in rows}
        assert all(hard.alike(sets[a], sets[b]) for a, b in links)
        assert hard.groups(range(len(lines)), lambda a, b: (max(a, b), min(a, b)) in links) == want
        if block > len(lines):
            assert len(rows) <= 2 * len(lines)


def test_steps_on_texts_take_little_memory():
    """Lines of eight megabytes of texts, which are cut in small parts, with their tables."""
    batch = pa.record_batch({"text": [f"line {i} of some words\n" * 1500 for i in range(250)]})
    tokens._held.clear()
    tracemalloc.start()
    for part in tokens.chunks(iter([batch])):
        data, starts, ends, _, _ = inked_lines(part)
        shingles(data, starts, ends, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_batches_of_long_texts_are_small(spark):
    """What a worker gets at once is bounded in bytes, also for the result's own plan."""
    docs = entry_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", F.repeat("text", 20).alias("text")).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.nbytes], pa.int64())})

    got = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 3 * BATCH_BYTES and max(got) < 2 * BATCH_BYTES


def test_fingerprints(docs, rows, none):
    order = sorted(rows, reverse=True)
    got = {r["doc_id"]: r for r in IMatch(docs, common=0.9, bucket_rows=4).compare().collect()}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[9]["fingerprint"] == got[20]["fingerprint"] != got[24]["fingerprint"]
    assert IMatch(none).compare().count() == 0


def test_fingerprints_null_ids_and_repeats(spark):
    some = spark.createDataFrame([(None, "abcd"), (3, "abcdef"), (3, "abcdef"), (5, "xy")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["edited_sha256"], r["near_next"]) for r in IMatch(some).compare().collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((i, s) for i, s, _ in got if i is not None) == sorted([(5, sha("xa")), (3, sha("abcabc")), (3, sha("abcxy"))])
    assert (None, sha("ab"), 0.0) in got


def test_likeness_falls_with_edits(spark):
    """A half-edited text is nearer than the next one for nearly all documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = IMatch(docs).compare().agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("int")), F.avg("near_next")).first()
    assert got[0] > 0.9 and got[1] < 0.05
