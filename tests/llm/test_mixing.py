import random
import re

import numpy as np
import pytest

from quarry.llm import mixing as X

DOCS = "doc_id long, text string, source string, size int, target string, mix int"


def fill_slow(sizes, weights, most):
    """Pour in small portions until all is shared."""
    target = [0.0] * len(sizes)
    portion = sum(sizes) / 200_000
    left = float(sum(sizes))
    while left > 1e-9:
        free = [i for i in range(len(sizes)) if target[i] < most * sizes[i] - 1e-9]
        if not free:
            break
        w = sum(weights[i] for i in free)
        give = min(portion, left)
        for i in free:
            target[i] = min(most * sizes[i], target[i] + give * weights[i] / w)
        left = sum(sizes) - sum(target)
    return target


def test_fill():
    rng = random.Random(1)
    for n in (1, 2, 5, 9):
        sizes = [rng.choice((0, 3, 50, 1000, 20000)) for _ in range(n)]
        weights = [(5, 2, 1)[i % 3] for i in range(n)]
        got = X.fill(np.array(sizes, float), np.array(weights, float), 3)
        assert got.sum() == pytest.approx(sum(sizes))
        assert got == pytest.approx(fill_slow(sizes, weights, 3), abs=0.01 * max(1, sum(sizes)))


def test_fit_counts_is_exact_where_it_can_be():
    rng = random.Random(2)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 60), 8)))
        counts = np.array([rng.randint(0, 5) for _ in lengths])
        reach = {0}
        for n, c in zip(lengths, counts):
            reach = {r + k * int(n) for r in reach for k in range(c + 1)}
        total = int((lengths * counts).sum())
        budget = rng.randint(0, total + 5)
        take = X.fit_counts(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        got, best = int((lengths * take).sum()), max(r for r in reach if r <= budget)
        assert got <= budget and best - got <= lengths[counts > 0].max(initial=0)
        # a window over the whole budget and no share taken first: the exact optimum
        if total and budget < total and (counts * (budget / total) < 1).all():
            assert got == best


def rows():
    rng = random.Random(3)
    out = [(i, "w " * rng.randint(0, 40), rng.choice(("a", "b", "c", "é", None)), 0, "", 0) for i in range(600)]
    out += [(1000 + i, "same words here", "a", 0, "", 0) for i in range(300)]  # one length, one source
    out += [(5, None, "b", 0, "", 0), (None, "x y z", "c", 0, "", 0), (7, "", "only-empty", 0, "", 0), (8, "one word\tand three", "Z", 0, "", 0), (9, "big " * 60_000, "b", 0, "", 0)]
    return out + [out[1], out[1]]


def test_mix(spark):
    df = spark.createDataFrame(rows(), DOCS)
    got = [r.asDict(recursive=True) for r in X.mix(df, group_rows=50).collect()]
    assert len(got) == len(rows())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[2] for r in rows()} - {None}) + [None]
    own = [sum(size(r[1]) for r in rows() if r[2] == s) for s in names]
    target = dict(zip(names, X.fill(np.array(own, float), np.array([(5, 2, 1)[i % 3] for i in range(len(names))], float), 3)))
    for s, n in zip(names, own):
        part = [r for r in got if r["source"] == s]
        taken = sum(r["mix"]["size"] * r["mix"]["repeats"] for r in part)
        assert all(r["mix"]["size"] == size(r["text"]) and r["mix"]["source_size"] == n and 0 <= r["mix"]["repeats"] <= 3 for r in part)
        assert all(abs(r["mix"]["target"] - target[s]) < 1e-6 for r in part)
        longest = max(r["mix"]["size"] for r in part)
        assert abs(taken - target[s]) <= max(1, longest if longest > 1000 else 2)
        assert all(r["mix"]["repeats"] == 0 for r in part if r["mix"]["size"] == 0)
    again = X.mix(df.repartition(7), group_rows=50).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] or "", r["mix"]["repeats"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    even = df.where("doc_id <> 9")  # without the text that fills the mix, length groups are taken in part
    one, other = (sorted(map(key, X.mix(even, seed=s, group_rows=50).collect())) for s in (1, 99))
    assert one != other and len(one) == len(other)


def test_edges(spark):
    df = spark.createDataFrame(rows(), DOCS)
    assert X.mix(df.limit(0)).collect() == []
    void = df.where("text is null or text = ''")
    assert all(r["mix"]["repeats"] == 0 and r["mix"]["target"] == 0 for r in X.mix(void).collect())
    one = X.mix(df.where("source = 'c'")).collect()
    assert all(r["mix"]["repeats"] == 1 for r in one if r["mix"]["size"])


def sums_of(lengths, counts):
    reach = {0}
    for n, c in zip(lengths, counts):
        reach = {r + k * int(n) for r in reach for k in range(int(c) + 1)}
    return reach


def fitted(lengths, counts, budget, **options):
    lengths, counts = np.array(lengths, np.int64), np.array(counts, np.int64)
    take = X.fit_counts(lengths, counts, budget, above=True, **options)
    assert (take >= 0).all() and (take <= counts).all()
    return int((lengths * take).sum()), take


def test_fit_counts_takes_the_nearest_sum():
    assert fitted([100_000], [1], 95_000)[0] == 100_000  # one long document, far over the window
    assert fitted([100_000], [1], 45_000)[0] == 0
    assert fitted([40_000, 50_000, 60_000], [1, 1, 1], 90_000)[0] == 90_000
    assert fitted([7, 10], [2, 2], 20)[0] == 20  # not a document of each length
    assert fitted([50, 100], [3, 3], 120)[0] == 100 and fitted([50, 100], [3, 3], 130)[0] == 150
    assert fitted([20_000, 20_500], [30, 30], 401_000)[0] == 401_000
    rng = random.Random(4)
    for step in (1, 1000):
        for window in (1, 50, X.WINDOW):
            for _ in range(30):
                lengths = [n * step for n in sorted(rng.sample(range(1, 60), 6))]
                counts = [rng.randint(0, 4) for _ in lengths]
                budget = rng.randint(0, sum(n * c for n, c in zip(lengths, counts)) + 5)
                got, best = fitted(lengths, counts, budget, window=window)[0], min(abs(r - budget) for r in sums_of(lengths, counts))
                assert abs(got - budget) == best


def test_fit_counts_far_over_the_window():
    rng = random.Random(5)
    lengths = sorted(rng.sample(range(20, 3000), 350)) + [19_999, 20_020, 90_001]
    counts = [rng.choice((1, 1, 2)) for _ in lengths]
    total = sum(n * c for n, c in zip(lengths, counts))
    for part in (0.1, 0.3, 0.8):
        got, take = fitted(lengths, counts, int(part * total))
        assert got == int(part * total)
        # documents of all lengths, not the longest first: each third of the lengths near its share
        for k in range(3):
            mine = slice(k * 117, k * 117 + 117)
            assert abs(take[mine].sum() / sum(counts[mine]) - part) < 0.1
        assert not np.array_equal(take, fitted(lengths, counts, int(part * total), seed=99)[1])
    long = [20_000 + 7 * i for i in range(300)]  # every document longer than the window
    assert fitted(long, [1] * 300, 1_234_567)[0] == 1_234_567
    # cells wider than a word: sums stay exact, and as near as a cell
    assert abs(fitted(long, [1] * 300, 1_234_567, cells=4096)[0] - 1_234_567) <= 1000


def test_mix_of_long_documents(spark):
    df = spark.createDataFrame([(1, "a " * 100_000, "a", 0, "", 0), (2, "b " * 90_000, "b", 0, "", 0)], DOCS)
    got = {r.doc_id: r.mix for r in X.mix(df).collect()}
    assert got[1].target == pytest.approx(190_000 * 5 / 7) and got[1].repeats == 1  # 135,714 words: 100,000 is nearer than 200,000
    assert got[2].target == pytest.approx(190_000 * 2 / 7) and got[2].repeats == 1  # 54,286 words: 90,000 is nearer than 0
