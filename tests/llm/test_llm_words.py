"""Spelling groups, packing and importance resampling against brute force, on the awkward table and on planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import hard
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landgrid.llm.bpe import ByteBpe
from landgrid.llm.packing import Packer, RunEncoder, cut_places, least_cost_cuts
from landgrid.llm.pieces import COMMON, cut, kind_ranges
from landgrid.llm.resampling import ImportanceResampler, features
from landgrid.llm.spelling import Acceptor, SpellingGroups, one_edit_pairs, shared

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# Spelling

def one_edit(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) - len(u) == 1 and any(v[:k] + v[k + 1:] == u for k in range(len(v)))


def spelling(rows, least_count=3):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(hard.ASCII_LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= least_count}
    near = {w: [] for w in n}
    holes = {}
    for w in n:
        for k in range(len(w)):
            holes.setdefault((k, w[:k] + w[k + 1:]), []).append(w)
    for w in n:
        other = {v for k in range(len(w)) for v in holes[(k, w[:k] + w[k + 1:])]}
        other |= {w[:k] + w[k + 1:] for k in range(len(w))} & set(n)
        for v in other - {w}:
            near[w].append(v)
            if len(v) < len(w):
                near[v].append(w)
    out = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best and n[best] >= 2 * n[w] else None, None, n[w], len(near[w])]
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: (f, r, c, k, n.get(f)) for w, (f, r, c, k) in out.items()}


def spelled(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, word string")
    return {r["word"]: tuple(r)[1:] for r in SpellingGroups(df, **options).groups().collect()}


def planted(seed, words=300):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(4, 9))) for _ in range(words)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(150):
            w = base[min(int(rng.expovariate(0.02)), words - 1)]
            k = rng.randrange(len(w))
            text.append(rng.choice([w, w, w, w[:k] + w[k + 1:], w[:k] + "e" + w[k:], w.upper()]))
        rows.append((i * 7, " ".join(text)))
    return rows


def test_acceptors_are_minimal_and_pairs_complete():
    rng = random.Random(3)
    for size in (1, 2, 3, 5):
        short = sorted({"".join(rng.choice("abc") for _ in range(size)) for _ in range(40)})
        long = sorted({"".join(rng.choice("abc") for _ in range(size + 1)) for _ in range(40)})
        a = Acceptor(short)
        assert sorted(shared(a.moves, a.root, a.moves, a.root)) == short
        assert len({tuple(sorted(m.items())) for m in a.moves}) == len(a.moves)
        got = list(one_edit_pairs(short, long, True))
        want = [(u, v) for u in short for v in short if u < v and one_edit(u, v)] + [(u, v) for u in short for v in long if one_edit(u, v)]
        assert sorted(got) == sorted(want)
    full = Acceptor(sorted(x + y + z for x in "abc" for y in "abc" for z in "abc"))
    assert len(full.moves) == 4
    assert list(one_edit_pairs([""], ["a", "b"], True)) == [("", "a"), ("", "b")] and not list(one_edit_pairs([""], ["a"], False))


@pytest.mark.parametrize("group", (20_000, 20))
def test_spelling_equals_brute_force(spark, group):
    rows = planted(1)
    got = spelled(spark, rows, group=group)  # small groups are entered further in, to the same result
    want = spelling(rows)
    assert got == want and len(got) > 150
    assert any(f and f != r for f, r, *_ in got.values()) and any(w[0] is None and w[3] == 0 for w in got.values())


def test_spelling_on_awkward_rows(spark, docs, none, rows):
    got = {r["word"]: tuple(r)[1:] for r in SpellingGroups(docs).groups().collect()}
    assert got == spelling(rows) and got
    assert SpellingGroups(none).groups().count() == 0
    long = "y" * 15_000
    odd = [(None, f"{long} {long}x"), (3, f"{long} {long}x"), (3, f"{long} {long}x"), (4, f"{long}\n÷×ÀÉé ÷×ÀÉé"), (5, "÷×ÀÉé ÷×ÀéÉ")]
    plain = [("" if i is None else i, t) for i, t in odd]
    assert spelled(spark, odd) == spelling(plain)
    assert spelled(spark, [(7, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa")], slip=0) == {
        "aaaaa": ("aaaaaa", "aaaaaa", 3, 1, 6), "aaaaaa": (None, "aaaaaa", 6, 1, None)}


# Packing

def cheapest(places, costs, size):
    """Least cost by trying every start of every window."""
    best = [0] + [math.inf] * (len(places) - 1)
    for i in range(1, len(places)):
        for j in range(i):
            n = places[i] - places[j]
            if n <= size:
                best[i] = min(best[i], best[j] + costs[i] + (0 if n & (n - 1) == 0 else size - n))
    return best[-1]


@pytest.mark.parametrize("size", (1, 2, 7, 16, 24))
def test_cuts_are_optimal(size):
    rng = np.random.default_rng(size)
    for _ in range(30):
        places = np.concatenate([[0], np.cumsum(rng.integers(1, size + 1, 60))])
        costs = rng.integers(0, 6, len(places))
        cuts = least_cost_cuts(places, costs, size)
        sizes = np.diff(places[cuts])
        assert cuts[0] == 0 and cuts[-1] == len(places) - 1 and (sizes <= size).all() and (sizes > 0).all()
        cost = sum(0 if n & (n - 1) == 0 else size - n for n in sizes.tolist()) + int(costs[cuts[1:]].sum())
        assert cost == cheapest(places.tolist(), costs.tolist(), size)


def test_cut_places():
    places, costs = cut_places(np.array([100, 250]), np.array([40, 100, 130]), 400, 16, 64, 2, 8)
    known = dict(zip(places.tolist(), costs.tolist()))
    assert known[40] == 2 and known[100] == 0 and known[130] == 2 and 104 not in known
    assert known[194] == 8 and known[250] == 0 and known[400] == 0 and all(k in known for k in range(384, 401))
    assert max(np.diff(places)) <= 64


def check_pieces(rows, got, size=4096, end=2):
    """Every id in one piece, sequences gapless; returns the share of padding."""
    tok = Tokenizer.from_file(VOCABULARY)
    tok.encode_special_tokens = True
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    wanted = {}
    for i, text in rows:
        wanted.setdefault(i, []).append([*tok.encode(text or "", add_special_tokens=False).ids, end])
    assert set(by_doc) == set(wanted)
    for i, lists in wanted.items():
        if len(lists) > 1:
            assert len(by_doc[i]) >= len(lists)
            continue
        at, ids = 0, lists[0]
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            part = np.array(ids[at:at + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
        total += at
    return padding / max(total, 1)


def test_run_encoder_is_the_tokenizer(rows):
    tok = Tokenizer.from_file(VOCABULARY)
    tok.encode_special_tokens = True
    hard_texts = [t or "" for _, t in rows] + [
        "can't WON'T, I'll; x.y.z 'tis a.'s (b.) c!\"d\" <|endoftext|> , .5 1,000.25", "ẖ H̱. É, ẞ a b\u0085c\x1cd\x1fe",
        "İI.̇ ΣΣ. 12a,b3?", "日本語。中文！a。b", "​zero‍width", "\x00 nul \x7f", "a|b | || c| |d", "é,è;é."]
    codec = RunEncoder(VOCABULARY)
    for got, text in zip(codec.encode_all([t.encode() for t in hard_texts]), hard_texts):
        assert got.tolist() == tok.encode(text, add_special_tokens=False).ids, text[:50]
    for text in hard_texts:
        assert codec.encode(text.encode()).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing(spark, docs, none, rows):
    for size, block in ((4096, 1 << 20), (64, 4096)):
        got = Packer(docs, VOCABULARY, size=size, block=block, grain=min(64, size)).pieces().collect()
        assert check_pieces(rows, got, size) < 0.01
    assert Packer(none, VOCABULARY).pieces().count() == 0
    odd = [(None, "a b"), (3, "same"), (3, "other words"), (4, None)]
    df = spark.createDataFrame(odd, "doc_id long, text string").coalesce(1)
    got = Packer(df, VOCABULARY).sequences().collect()
    tok = Tokenizer.from_file(VOCABULARY)
    assert [i for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])) for i in r["ids"]] == [
        i for _, t in odd for i in [*tok.encode(t or "", add_special_tokens=False).ids, 2]]  # order is preserved
    one = Packer(df.limit(1).withColumn("sequence_id", F.lit("x")), VOCABULARY, end=49_500).sequences().collect()
    assert sum(r["length"] for r in one) == 3 and one[-1]["ids"][-1] == 49_500


def test_cuts_prefer_documents_and_sentences(spark):
    rng = random.Random(4)
    words = ["river", "stone", "cloud", "green", "walks", "under"]
    text = lambda: " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(4, 12))) + "." for _ in range(40))
    df = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string").coalesce(1)
    got = Packer(df, VOCABULARY, size=1024).sequences().collect()
    dot = Tokenizer.from_file(VOCABULARY).token_to_id(".</w>")
    cut = [r for r in got if r["start"] + r["length"] < r["doc_tokens"]]
    assert cut and sum(r["ids"][-1] == dot for r in cut) > 0.9 * len(cut)


# Importance resampling

def resampled(docs, target, buckets=10_000, seed=7, least=20, percent=25):
    pattern = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def grams(text):
        words = pattern.findall((text or "").translate(hard.ASCII_LOWER))
        return words, [zlib.crc32(g.encode()) % buckets for g in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(grams(text)[1])
    for text in target:
        t.update(grams(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, found = grams(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return sorted((i, n, w, x, rank.get(i)) for i, n, w, x, _ in rows)


def drawn(docs, target, **options):
    got = ImportanceResampler(docs, target, **options).drawn().collect()
    return sorted((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got)


def test_features_of_parts():
    text = "Ab cd,EF 9é  x--y ".encode() * 50
    whole = sorted(c for _, part in features(text, 3) for c in part.tolist())
    words = text.decode().translate(hard.ASCII_LOWER).replace(",", " ").replace("-", " ").split()
    assert whole == sorted(zlib.crc32(" ".join(words[i:i + n]).encode()) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    for n in (1, 2, 3, 4):
        got = sorted(c for _, part in features(text, n, 5) for c in part.tolist())
        assert got == sorted(zlib.crc32(" ".join(words[i:i + k]).encode()) for k in range(1, n + 1) for i in range(len(words) - k + 1))


def test_resampling_equals_brute_force(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert drawn(docs, target) == resampled(rows, [r["text"] for r in target.collect()])


def test_resampling_on_awkward_rows(spark, docs, none, rows):
    target = spark.createDataFrame([(None, "x"), ("same same words", "y"), ("", None)], "text string, bucket string")
    assert drawn(docs, target) == resampled(rows, [None, "same same words", ""])
    assert drawn(docs, none.select("text")) == resampled(rows, [])
    assert drawn(none, target) == []
    twice = spark.createDataFrame([(i % 3, " ".join(["word"] * 30)) for i in range(30)] + [(None, "b " * 40)], "doc_id long, text string")
    got = ImportanceResampler(twice, target, percent=50).drawn().collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 16)) and len(got) == 31
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["score"] for r in ranked] == sorted((r["score"] for r in ranked), reverse=True)


# Pieces of the byte-level vocabulary

def test_pieces_are_the_tokenizers_at_every_code_point():
    """Our pieces become the vocabulary: the engine then gives one id per piece, in order, exactly if it cuts alike."""
    ranges = kind_ranges()
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 1 << 17):
        text = "".join(f"{chr(c)}'s{chr(c)}a 1{chr(c)}\n" for c in every[at:at + (1 << 17)])
        data = np.frombuffer(text.encode(), np.uint8)
        pieces = [p.encode() for p in cut(data, np.array([0, len(data)]), COMMON, ranges)[0].to_pylist()]
        ranks = {bytes([b]): b for b in range(256)}
        for p in pieces:
            ranks.setdefault(p, len(ranks))
        engine = tiktoken.Encoding(f"own{at}", pat_str=COMMON, mergeable_ranks=ranks, special_tokens={})
        assert engine.encode_ordinary(text) == [ranks[p] for p in pieces]


def test_encoding_newer_letters_and_repeats(spark):
    texts = ["Ᲊ's", "Ɤ's x", "Ꟛ's", "\U000105c0's", None, "", "a" * 5_000 + "'s", " 　 x", "same", "same"]
    rows = [(i // 2 if i else None, t, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int")
    codec = ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    engine = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = sorted((str(r["doc_id"]), r["ids"]) for r in codec.encode(df).collect())
    assert got == sorted((str(i), engine.encode_ordinary(t or "")) for i, t, _ in rows)
