import numpy as np
import pytest

from quarry.operators import search
from quarry.plans import pivots


def frame(spark, vectors, name="embedding", id_name="vec_id"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], f"{id_name} long, {name} array<double>")


def planted(kind, rng):
    if kind == "clusters":
        centres = rng.normal(size=(20, 16)) * 10
        vectors = list(centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 0.1)
    elif kind == "gauss":
        vectors = list(rng.normal(size=(1500, 16)))
    else:  # many equal and parallel vectors, whole numbers: ties everywhere
        vectors = list(rng.integers(0, 2, size=(800, 4)).astype(float))
    dim = len(vectors[0])
    return [*vectors, None, [float("nan")] * dim, [1.0], *vectors[:30]], dim


@pytest.mark.parametrize("kind,k,block", [("clusters", 5, 16 << 20), ("clusters", 3, 3000), ("gauss", 7, 16 << 20), ("ties", 10, 16 << 20), ("ties", 2000, 16 << 20)])
def test_rows_equal_the_full_search(spark, tmp_path, kind, k, block):
    rng = np.random.default_rng(3)
    vectors, dim = planted(kind, rng)
    corpus = frame(spark, vectors)
    asked = [v for v in vectors[:25]] + [np.full(dim, 1e3), np.zeros(dim), None, [2.0]]
    queries = frame(spark, asked, "query_vec", "query_id")
    pivots.write_pivots(corpus, str(tmp_path / "p"), id_col="vec_id", vec_col="embedding", dim=dim)
    note = []
    got = pivots.pivot_topk(spark, str(tmp_path / "p"), queries, k=k, max_block_bytes=block, note=note)
    want = search.vector_topk(corpus, queries, id_col="vec_id", vec_col="embedding", k=k, dim=dim)
    rows = lambda df, i: sorted((r.query_id, r["rank"], r[i], round(r.dist, 9)) for r in df.collect())
    assert rows(got, "id") == rows(want, "vec_id")
    assert (len(note) > 1) == (block == 3000)


def test_clusters_are_skipped_and_the_scan_sees_the_ranges(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors, dim = planted("clusters", rng)
    root, note = str(tmp_path / "p"), []
    pivots.write_pivots(frame(spark, vectors), root, id_col="vec_id", vec_col="embedding", dim=dim)
    pivots.pivot_topk(spark, root, frame(spark, vectors[:1], "query_vec", "query_id"), k=5, note=note)
    assert pivots.skipped_share(spark, root, note[0]) > 0.85
    plan = spark.read.parquet(f"{root}/rows").where(pivots._inside(note[0]))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(dist" in plan.split("PushedFilters")[1]


def test_empty_tables(spark, tmp_path):
    none, some = frame(spark, []), frame(spark, [[1.0, 2.0]], "query_vec", "query_id")
    pivots.write_pivots(none, str(tmp_path / "a"), id_col="vec_id", vec_col="embedding", dim=2)
    assert pivots.pivot_topk(spark, str(tmp_path / "a"), some).collect() == []
    pivots.write_pivots(frame(spark, [[1.0, 2.0]]), str(tmp_path / "b"), id_col="vec_id", vec_col="embedding", dim=2)
    assert [tuple(r) for r in pivots.pivot_topk(spark, str(tmp_path / "b"), some).collect()] == [(0, 0, 0.0, 1)]
    assert pivots.pivot_topk(spark, str(tmp_path / "b"), frame(spark, [], "query_vec", "query_id")).collect() == []
