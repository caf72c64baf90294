import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quarry.llm import periodic as P
from quarry.llm.suffix_tree import Tree

SCHEMA = "doc_id long, text string, runs string, n_words string, start int"


def brute_runs(words, min_length=6, min_periods=4):
    """All runs by comparing words q apart, for every q."""
    n, out, found = len(words), [], set()
    for q in range(1, n // max(2, min_periods) + 1 if min_periods else n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(min_length, min_periods * q) and length >= 2 * q and not any((i, length) == f[:2] for f in found):
                found.add((i, length, q))
            i = j + 1
    return sorted(found)


def test_tree_answers_extensions():
    rng = random.Random(1)
    for _ in range(60):
        n, k = rng.randint(1, 40), rng.randint(1, 4)
        s = [rng.randint(1, k) for _ in range(n)]
        t = Tree(s)
        assert sorted(range(n + 1), key=lambda i: [*s[i:], 0]) == np.argsort(t.rank).tolist()
        assert sorted(range(n + 1), key=lambda i: [*(9 - x for x in s[i:]), 0]) == np.argsort(t.backward_rank()).tolist()
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
        got = t.lce(*map(np.array, zip(*pairs)))
        for (i, j), g in zip(pairs, got):
            w = 0
            while max(i, j) + w < n and s[i + w] == s[j + w]:
                w += 1
            assert w == g


def test_tree_is_ukkonens_size():
    s = [1, 2, 1, 1, 2, 1, 2, 2] * 50
    t = Tree(s)
    assert t.size <= 2 * (len(s) + 1)


def test_lyndon_lengths_by_definition():
    rng = random.Random(3)
    for _ in range(100):
        s = [rng.randint(1, 3) for _ in range(rng.randint(1, 14))]
        for rank, key in ((Tree(s).rank, lambda x: x), (Tree(s).backward_rank(), lambda x: -x)):
            w = [key(x) for x in s]
            for i, got in enumerate(P.lyndon_lengths(rank)):
                longest = max(L for L in range(1, len(w) - i + 1) if all(w[i : i + L] < w[i + d : i + L] for d in range(1, L)))
                assert got == longest


@pytest.mark.parametrize("min_length,min_periods", [(6, 4), (2, 2), (9, 5)])
def test_runs_against_brute_force(min_length, min_periods):
    rng = random.Random(min_length)
    for k in range(400):
        s = [rng.randint(1, rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 40))]
        if k % 2:
            unit = [rng.randint(1, 4) for _ in range(rng.randint(1, 6))]
            s = [5, 6] * (k % 3) + unit * rng.randint(2, 9) + unit[: rng.randint(0, len(unit))] + s
        want = brute_runs(s, min_length, min_periods)
        assert [tuple(r) for r in P.runs_of(s, min_length, min_periods)] == want
        size = np.array([0, len(s), 3])
        codes = np.array([*s, 7, 7, 7], np.int64)
        got = P._slice_runs(codes, size, min_length, min_periods)
        assert [tuple(r[1:]) for r in got if r[0] == 1] == want


def brute_row(i, text, plant):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else None
    if plant and i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (j - a) % p] for j in range(a, n)]
    runs = brute_runs(w)
    keep = [x for j, x in enumerate(w) if not any(s + q <= j < s + L for s, L, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *top, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(keep)))


def test_operator_rows(spark):
    texts = [None, "", " \t\n", "a", "a " * 7, "x a b a b a b a b y", "a b a b a b", "é é é é é é", "one two " * 5, "a\x0bb\x0ca\rb a b a b"]
    texts += ["x y z " * 2_000, "same same same same same same", "same same same same same same", "q " + "a a a a a a b " * 5]
    rows = [(i, t, "c", "d", 1) for i, t in enumerate(texts)] + [(None, "b b b b b b b", "", "", 0)]
    got = {(r.doc_id, r.n_words): r for r in P.find_runs(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        r = got[i, len(w)]
        want = brute_runs(w) if len(w) < 100 else [(0, 6000, 3)]
        assert [tuple(x) for x in r.runs] == want
        assert r.collapsed == " ".join(x for j, x in enumerate(w) if not any(s + q <= j < s + L for s, L, q in want))
    assert P.find_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in P.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    short = [r for r in docs if len((r.text or "").split()) < 1500]
    assert len(short) > 100 and any(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in short)
    for r in short:
        assert got[r.doc_id] == brute_row(r.doc_id, r.text, True)


def test_long_text_of_one_word():
    assert P.runs_of([1] * 50_000).tolist() == [[0, 50_000, 1]]
