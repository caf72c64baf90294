import math
import random
from fractions import Fraction

import numpy as np
import pytest

from quarry.llm import whiten as W
from quarry.llm.common import staged

SCHEMA = "vec_id long, embedding array<double>, x int, component string, n string"


def run(spark, rows, k=4):
    df = W.quantised(spark.createDataFrame([(i, v, 1, "c", "n") for i, v in rows], SCHEMA).repartition(5))
    fit_list = staged(df.select("x").distinct(), "w")
    model = W.fit(fit_list, components=k)
    error = None if model is None else W.identity_error(fit_list, model)
    return model, W.whiten(df, model, error).collect()


def brute(rows):
    """Exact means and deviations by fractions, eigenvalues by the library."""
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max(len(v) for _, v in ok)
    ok = [(i, v + [0] * (dim - len(v))) for i, v in ok]
    distinct = sorted({tuple(v) for _, v in ok})
    n = len(distinct)
    sums = [sum(c) for c in zip(*distinct)]
    cov = [[float(sum(Fraction(n * v[a] - sums[a]) * (n * v[b] - sums[b]) for v in distinct) / Fraction(n) ** 3) for b in range(dim)] for a in range(dim)]
    return ok, n, sums, np.array(cov)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * (j + 1) / 6 for j in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # copies count once in the fit
    rows += [(2000, None), (2001, [None] * 6), (2002, [math.nan] + [0.0] * 5), (2003, [math.inf] + [0.0] * 5), (None, rows[3][1]), (5, rows[9][1]), (6, [0.5, -0.5])]
    ok, n, sums, cov = brute(rows)
    model, got = run(spark, rows)
    assert model["n"] == n and model["sums"] == sums
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:4], vector[:, ::-1][:, :4]
    assert np.allclose(model["values"], value, rtol=1e-12)
    assert np.allclose(np.abs((model["axes"] * vector).sum(axis=0)), 1.0, atol=1e-13)
    assert np.allclose(np.linalg.norm(model["axes"], axis=0), 1.0, atol=1e-15)
    assert len(got) == 4 * len(ok)
    sign = np.sign((model["axes"] * vector).sum(axis=0))
    want = sorted(
        (str(i), c + 1, n, sum((n * x - s) ** 2 for x, s in zip(v, sums)), float((np.array([n * x - s for x, s in zip(v, sums)]) / n) @ vector[:, c] * sign[c] / math.sqrt(value[c])))
        for i, v in ok
        for c in range(4)
    )
    for w, g in zip(want, sorted(((str(r.vec_id), r.component, r.n, r.deviation, r.whitened) for r in got))):
        assert w[:4] == g[:4] and abs(w[4] - g[4]) < 1e-9 * max(1.0, abs(w[4]))
    assert all(r.identity_error < 1e-10 and abs(r.explained - value[r.component - 1] / np.trace(cov)) < 1e-12 for r in got)


def test_few_directions_and_empty(spark):
    model, got = run(spark, [(i, [i / 4, i / 2, 1.0, 7.0, 7.0]) for i in range(40)])
    assert len(model["values"]) == 1 and len(got) == 40 and got[0].identity_error < 1e-12
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])[1] == []
    assert run(spark, [(1, None)]) == (None, []) and run(spark, [(1, [])])[1] == []


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e15, 0.0]), (2, [1e15 + 1, 1.0]), (3, [-1e15, 2.0]), (4, [3.0, 1.0]), (5, [1e300, -1e300])][:4]
    ok, n, sums, cov = brute(rows)
    model, got = run(spark, rows)
    assert np.allclose(model["values"], sorted(np.linalg.eigvalsh(cov))[::-1][: len(model["values"])], rtol=1e-9)
    exact = {i: sum((n * x - s) ** 2 for x, s in zip(v, sums)) for i, v in ok}
    assert all(r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 2**63 else None) for r in got)
    assert len(run(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])])[1]) >= 3  # beyond 64 bits: no crash


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_factor_and_rotations(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d + 3))
    a = a @ a.T
    l = W.pivoted_cholesky(a)
    assert np.allclose(l @ l.T, a, atol=1e-10 * np.trace(a))
    u = W.jacobi_columns(l)
    g = u.T @ u
    assert np.allclose(g - np.diag(np.diag(g)), 0.0, atol=1e-12 * np.trace(a))
    assert np.allclose(sorted(np.diag(g)), np.linalg.eigvalsh(a), rtol=1e-10)


def test_factor_is_triangular_in_pivot_order():
    a = np.array([[4.0, 2.0, 2.0], [2.0, 9.0, 1.0], [2.0, 1.0, 1.25]])
    l = W.pivoted_cholesky(a)
    rows = [1, 0, 2]  # largest diagonal first
    assert np.allclose(np.triu(l[rows], 1), 0.0) and np.allclose(l @ l.T, a)


def test_given_embeddings(spark):
    got = W.op13_whitening(spark, "/root/testdata/sf0.001")
    rows = got.collect()
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert len(rows) == 4 * n and all(r.identity_error < 1e-8 for r in rows)
