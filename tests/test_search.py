import numpy as np
from pyspark.sql import functions as F

from quarry.operators import search


def brute(corpus, queries, k, metric):
    out = {}
    for qid, q in queries:
        rows = []
        for did, d in corpus:
            q64, d64 = np.asarray(q, float), np.asarray(d, float)
            if metric == "l2":
                key = -round(float(((q64 - d64) ** 2).sum()), 9)
            elif metric == "dot":
                key = round(float(q64 @ d64), 9)
            else:
                den = np.linalg.norm(q64) * np.linalg.norm(d64)
                key = round(float(q64 @ d64 / den) if den > 0 else 0.0, 9)
            rows.append((-key, did))
        out[qid] = [d for _, d in sorted(rows)[:k]]
    return out


def frames(spark, corpus, queries):
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in corpus], "id long, v array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in queries], "query_id long, query_vec array<double>")
    return c, q


def test_topk_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(-2, 3, size=(60, 6))
    corpus = [(i, base[i % 20]) for i in range(60)]  # every vector three times: ties
    queries = [(100 + j, rng.integers(-2, 3, size=6)) for j in range(9)]
    c, q = frames(spark, corpus, queries)
    for metric in ("l2", "cosine", "dot"):
        res = search.vector_topk(c, q, id_col="id", vec_col="v", k=5, metric=metric).collect()
        got = {}
        for r in sorted(res, key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == brute(corpus, queries, 5, metric), metric
        assert sorted({r["rank"] for r in res}) == [1, 2, 3, 4, 5]


def test_query_blocks_split_gives_same_answer(spark):
    rng = np.random.default_rng(3)
    corpus = [(i, rng.normal(size=8)) for i in range(200)]
    queries = [(1000 + j, rng.normal(size=8)) for j in range(40)]
    c, q = frames(spark, corpus, queries)
    one = search.vector_topk(c, q, id_col="id", vec_col="v", k=3, metric="l2")
    many = search.vector_topk(c, q, id_col="id", vec_col="v", k=3, metric="l2", max_block_bytes=2000)
    assert len(list(search.query_blocks(q, "query_id", "query_vec", max_block_bytes=2000))) > 1
    a = sorted((r["query_id"], r["rank"], r["id"]) for r in one.collect())
    b = sorted((r["query_id"], r["rank"], r["id"]) for r in many.collect())
    assert a == b


def test_bad_vectors_are_skipped(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [1.0]), (4, [0.0, 1.0])], "id long, v array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, query_vec array<double>")
    ids = [r["id"] for r in search.vector_topk(c, q, id_col="id", vec_col="v", k=5).orderBy("rank").collect()]
    assert ids == [1, 4]


def test_plan_has_partial_topk_and_no_cartesian(spark):
    rng = np.random.default_rng(1)
    c, q = frames(spark, [(i, rng.normal(size=4)) for i in range(50)], [(7, rng.normal(size=4))])
    plan = search.vector_topk(c, q, id_col="id", vec_col="v", k=5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_group_col_ranks_per_table(spark):
    rng = np.random.default_rng(5)
    corpus = [(i, rng.normal(size=4)) for i in range(30)]
    c, q = frames(spark, corpus, [(1, rng.normal(size=4))])
    c = c.withColumn("kind", F.when(F.col("id") % 2 == 0, "method").otherwise("class"))
    res = search.vector_topk(c, q, id_col="id", vec_col="v", k=2, group_col="kind").collect()
    assert sorted((r["kind"], r["rank"]) for r in res) == [("class", 1), ("class", 2), ("method", 1), ("method", 2)]


def test_sparse_and_dense_vectors_rank_the_same(spark):
    from quarry.operators import embed

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    qs = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    out = []
    for sparse in (False, True):
        e = embed.HashingEmbedder(dim=64, sparse=sparse)
        r = search.text_search(docs, qs, e, id_col="doc_id", text_col="text", query_id="query_id", query_text="q", k=5, metric="cosine")
        out.append(sorted((x.query_id, x["rank"], x.doc_id, round(x.score, 9)) for x in r.collect()))
    assert out[0] == out[1] and len(out[0]) > 0


def test_long_vectors_keep_their_distances(spark):
    rows = [(1, [1e6, 0.001]), (2, [1e6, 0.0]), (3, [1e6, 0.002])] + [(i, [1e6, 1.0 + i]) for i in range(10, 90)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    q = spark.createDataFrame([(7, [1e6, 0.0012])], "query_id long, query_vec array<double>")
    got = search.vector_topk(df, q, id_col="id", vec_col="v", k=3).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3, 2] and abs(got[0].dist - 0.0002) < 1e-9


def test_blocks_and_running_topk_agree(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 6)), 1)
    df = spark.createDataFrame([(i, [float(a) for a in v], "a" if i % 3 else "b", f"t{i}") for i, v in enumerate(x)], "id long, v array<double>, g string, t string").repartition(3)
    q = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x[:20])], "query_id long, query_vec array<double>")
    for metric in search.METRICS:
        one = search.vector_topk(df, q, id_col="id", vec_col="v", k=4, metric=metric, carry=["t"], group_col="g", chunk_cells=200)
        many = search.vector_topk(df, q, id_col="id", vec_col="v", k=4, metric=metric, carry=["t"], group_col="g", max_block_bytes=400)
        key = lambda r: (r.query_id, r.g, r["rank"], r.id, r.t)
        got = sorted(map(key, one.collect()))
        assert got == sorted(map(key, many.collect())) and len(got) == 160 and all(t == f"t{i}" for *_, i, t in got)


def test_merge_by_slices_keeps_the_full_order(spark):
    rng = np.random.default_rng(11)
    S = rng.integers(0, 6, size=(400, 7)) / 5.0
    S[:, 6] = -np.inf  # a query without any hit
    ids = rng.permutation(400)
    best = None
    for a in range(0, 400, 3):
        best = search.merge_best(best, S[a : a + 3].copy(), ids[a : a + 3], 5)
    for j in range(6):
        want = sorted(range(400), key=lambda i: (-S[i, j], ids[i]))[:5]
        order = sorted(range(5), key=lambda r: (-best[2][r, j], best[0][r, j]))
        assert [int(best[0][r, j]) for r in order] == [int(ids[i]) for i in want]
    assert np.isinf(best[2][:, 6]).all()


def test_a_batch_is_searched_in_slices(spark, monkeypatch):
    """No matrix of a task grows with the Arrow batch (a slice has ``chunk_cells`` cells)."""
    rng = np.random.default_rng(5)
    corpus = [(i, rng.integers(-2, 3, size=6)) for i in range(300)]
    queries = [(1000 + j, rng.integers(-2, 3, size=6)) for j in range(4)]
    c, q = frames(spark, corpus, queries)
    block = next(iter(search.query_blocks(q, "query_id", "query_vec")))[0]
    seen = []
    inner = search._matrix
    for metric in ("l2", "cosine", "dot"):
        res = search.vector_topk(c, q, id_col="id", vec_col="v", k=5, metric=metric, chunk_cells=60).collect()
        got = {}
        for r in sorted(res, key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == brute(corpus, queries, 5, metric), metric
    monkeypatch.setattr(search, "_matrix", lambda col, n, dim: seen.append(n) or inner(col, n, dim))
    class Whole:  # the task's function on one large batch, without a session between
        sparkSession, schema = spark, c.schema

        def select(self, *cols):
            self.schema = c.select(*cols).schema
            return self

        def mapInArrow(self, run, schema):
            list(run([c.coalesce(1).toArrow().combine_chunks().to_batches()[0]]))

    search._block_candidates(Whole(), block, id_col="id", vec_col="v", qid_name="query_id", qid_type=q.schema["query_id"].dataType, group_col=None, k=5, metric="dot", chunk_cells=60)
    assert max(seen) <= 10 and sum(seen) == 300


def test_embedding_slices_give_the_same_vectors(spark, monkeypatch):
    import pyarrow as pa

    from quarry.operators import embed

    tokens = pa.array([["a", "b", "a"], None, [], ["c"] * 50, ["d", "e"]] * 20, pa.list_(pa.string()))
    whole = embed._normalised(tokens, 16)
    monkeypatch.setattr(embed, "SLICE_TOKENS", 7)
    parts = list(embed._pieces(tokens, 16))
    assert len(parts) > 20 and sum(map(len, parts)) == len(tokens)
    assert np.array_equal(np.concatenate([embed._normalised(p, 16) for p in parts]), whole)
