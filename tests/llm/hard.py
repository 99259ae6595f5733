"""A small table with the awkward cases, and brute-force versions of the operators."""

import random
import re
from itertools import combinations

WORDS = re.compile("[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    """(doc_id, text): nulls, empty and blank texts, short and very long ones, copies, near copies, shared passages."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["tha", "er", "ing", "ou", "é", "ß", "re"]) for _ in range(rng.randint(1, 3)))
    prose = lambda n: [word() for _ in range(n)]
    rows = [(1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, "One"), (6, "a b c d"), (7, "a b c d"), (8, "\u00a0 x\u2003y")]
    base = prose(120)
    rows.append((9, " ".join(base)))
    for k in range(10, 16):  # near copies of 9, some beyond the threshold
        near = list(base)
        for _ in range(k - 9):
            near[rng.randrange(len(near))] = word()
        rows.append((k, " ".join(near)))
    passage = prose(30)
    for k in range(16, 20):
        rows.append((k, " ".join(prose(20) + passage + prose(15))))
    rows += [(20, " ".join(base)), (21, " ".join(base).upper()), (22, "x" * 30_000), (23, "same " * 3_000), (24, " ".join(prose(20_000)))]
    line = " ".join(prose(12))
    for k in range(25, 29):
        rows.append((k, "\n".join([" ".join(prose(10)), line if k % 2 else line + "!", "", " ".join(prose(9))])))
    rows += [(-7, "it's 100 apples, I'll say: don't   stop\r\n\r\n\t 日本語 ÀÉ 😀😀"), (1 << 40, " ".join(passage[:13]))]
    return rows


def shingles(text, n=5):
    words = WORDS.findall((text or "").translate(ASCII_LOWER))
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def groups(keys, linked):
    """Least member within reach of links, for each key."""
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(parent), 2):
        if linked(a, b):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in parent}


def alike(x, y, percent=80):
    return bool(x or y) and 100 * len(x & y) >= percent * len(x | y)


def kept_words(rows, window=13):
    """(words, kept words) of each document after removing windows that start in a smaller document too."""
    first = {}
    words = {i: WORDS.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k:k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (w, [x for k, x in enumerate(w) if k not in gone])
    return out
