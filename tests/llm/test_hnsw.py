import math

import numpy as np
import pytest

from quarry.llm import hnsw as N

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def brute(ids, x, every, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, q in zip(ids, u):
        if i % every == 0:
            s = u @ q
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def answers(spark, rows, every=50, k=5, **kw):
    base = N.vectors(spark.createDataFrame(rows, SCHEMA))
    got = N.neighbours(N.index(base, k=k, **kw), base.where(f"vec_id % {every} = 0"), k=k).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, x = df.vec_id.to_numpy(), np.array(df.embedding.to_list(), float)
    got = answers(spark, [(int(i), [float(a) for a in v], 0, 0) for i, v in zip(ids, x)], shard=700)
    want = brute(ids, x, 50)
    hit = sum(len({a for a, _ in got[q]} & {a for a, _ in w}) for q, w in want.items())
    assert hit / sum(map(len, want.values())) >= 0.95
    for q, w in want.items():
        exact = dict(brute(ids, x, q, k=len(ids))[q] if q else want[q])
        assert all(abs(s - exact[i]) < 1e-9 for i, s in got[q] if i in exact)


def test_recall_on_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([c + 0.05 * rng.normal(size=(150, 24)) for c in rng.normal(size=(30, 24))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    layers, links = N.build(x)
    assert len(layers) > 1 and all(n.shape[1] == (2 * N.M if i == 0 else N.M) for i, n in enumerate(links))
    q = x[::37]
    best, _ = N.search(x, layers, links, q)
    want = np.argsort(-(q @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(best, want)]) > 0.95


def test_copies_and_ties(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0, 0) for i in range(300)] + [(i, [float(i), 1.0, -1.0], 0, 0) for i in range(300, 340)]
    got = answers(spark, rows)
    assert [a for a, _ in got[0]] == [1, 2, 3, 4, 5] and [a for a, _ in got[50]] == [0, 1, 2, 3, 4]
    assert all(abs(s - 1) < 1e-12 for _, s in got[100])
    assert [a for a, _ in got[300]][:2] == [301, 302]


@pytest.mark.parametrize("k", [5, 10])
def test_parallel_and_equal_vectors(spark, k):
    rows = [(i, [(40 - i) * 0.5, (40 - i) * 1.5, (i - 40) * 0.25], 0, 0) for i in range(40)]  # one direction, other lengths
    rows += [(i, [0.25, -1.0, 3.0], 0, 0) for i in range(100, 130)] + [(i, [math.sin(i), math.cos(i), 0.1 * i], 0, 0) for i in range(200, 260)]
    got = answers(spark, rows, every=1, k=k)
    want = brute(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float), 1, k=k)
    assert {q: [i for i, _ in a] for q, a in got.items()} == {q: [i for i, _ in a] for q, a in want.items()}
    assert all(abs(x[1] - y[1]) < 1e-9 for q in want for x, y in zip(got[q], want[q]))


def test_index_of_fewer_answers_is_refused(spark):
    base = N.vectors(spark.createDataFrame([(0, [1.0, 0.0], 0, 0), (1, [1.0, 1.0], 0, 0)], SCHEMA))
    with pytest.raises(ValueError):
        N.neighbours(N.index(base, k=5), base, k=6)


@pytest.mark.parametrize("wide", [64, 256])
def test_recall_of_a_whole_shard(wide):
    rng = np.random.default_rng(wide)
    x = rng.normal(size=(N.SHARD, wide)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    layers, links = N.build(x)
    q = x[::64]
    best, sims = N.search(x, layers, links, q)
    want = np.argsort(-(q @ x.T), axis=1)[:, :6]
    found = np.take_along_axis(best, np.argsort(-sims, axis=1)[:, :6], 1)
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(found, want)]) >= 0.9


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0], 0, 0), (1, [0.0, 0.0], 0, 0), (2, None, 0, 0), (3, [1.0, None], 0, 0), (4, [math.nan, 1.0], 0, 0),
        (5, [math.inf, 1.0], 0, 0), (6, [1.0, 1.0], 0, 0), (6, [1.0, 1.0], 0, 0), (7, [1.0, 1.0, 1.0], 0, 0), (50, [], 0, 0), (None, [1.0, 1.0], 0, 0),
    ]
    got = answers(spark, rows)
    assert list(got) == [0] and len(got[0]) == 1 and got[0][0][0] == 6 and abs(got[0][0][1] - math.sqrt(0.5)) < 1e-12
    assert answers(spark, []) == {} and answers(spark, rows[:1]) == {}
