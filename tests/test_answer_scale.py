"""The turn job at size: what is scored in double precision, how terms are found, what is written."""

import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.functions import term_lists
from quarry.functions.vectors import terms
from quarry.operators import embed, rerank, search
from quarry.plans import answer


def searched(D, Q, ids, k, cells, monkeypatch):
    """One task's best rows, and how many cells were scored in double precision."""
    dense = []
    inner = search._scores
    monkeypatch.setattr(search, "_scores", lambda D, Q, qsq, metric: dense.append(len(D) * len(Q)) or inner(D, Q, qsq, metric))

    class Context:
        def broadcast(self, value):
            return type("B", (), {"value": value})

    class Corpus:
        from pyspark.sql import types as T

        sparkSession = type("S", (), {"sparkContext": Context()})
        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

        def select(self, *cols):
            return self

        def mapInArrow(self, run, schema):
            lists = pa.array([list(map(float, v)) for v in D], pa.list_(pa.float64()))
            self.out = list(run(iter([pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["id", "v"])])))

    corpus = Corpus()
    search._block_candidates(
        corpus, (np.arange(len(Q)), Q, Q.shape[1]), id_col="id", vec_col="v", qid_name="q", qid_type=Corpus.T.LongType(), group_col=None, k=k, metric="cosine", chunk_cells=cells
    )
    found = pa.Table.from_batches(corpus.out).sort_by([("q", "ascending"), ("_key", "descending"), ("id", "ascending")])
    return [found.filter(pa.compute.equal(found["q"], j))["id"].to_pylist()[:k] for j in range(len(Q))], sum(dense)


def ranked(D, Q, ids, k):
    n = np.linalg.norm(D, axis=1)[:, None] * np.linalg.norm(Q, axis=1)[None, :]
    key = np.round(np.divide(D @ Q.T, n, out=np.zeros(n.shape), where=n > 0), 9)
    return [[int(ids[i]) for i in sorted(range(len(D)), key=lambda i: (-key[i, j], ids[i]))[:k]] for j in range(len(Q))]


def test_cosines_are_scored_in_double_only_near_the_kth_key(monkeypatch):
    rng = np.random.default_rng(4)
    D, Q = rng.normal(size=(3000, 24)), rng.normal(size=(40, 24))
    ids = rng.permutation(3000)
    got, dense = searched(D, Q, ids, 5, 4000, monkeypatch)
    assert got == ranked(D, Q, ids, 5)
    assert dense <= 3000 * 40 // 20  # before: every cell


def test_close_cosines_ties_and_odd_lengths_keep_the_order(monkeypatch):
    rng = np.random.default_rng(9)
    D = rng.integers(0, 3, size=(1500, 6)).astype(float)  # many rows of one direction
    D[::7] *= 1e6
    D[5::11] = 0
    D[1200:] = D[0] + rng.normal(size=(300, 6)) * 1e-8  # closer to each other than single precision tells
    Q = np.concatenate([rng.integers(0, 3, size=(12, 6)).astype(float), D[:3], np.zeros((1, 6))])
    ids = rng.permutation(1500)
    got, _ = searched(D, Q, ids, 5, 600, monkeypatch)
    assert got == ranked(D, Q, ids, 5)


def test_lengths_that_cannot_be_scaled_are_scored_as_before(monkeypatch):
    rng = np.random.default_rng(2)
    D, Q = rng.normal(size=(200, 4)), rng.normal(size=(5, 4))
    D[::9] *= 1e-120
    ids = np.arange(200)
    got, dense = searched(D, Q, ids, 3, 40, monkeypatch)
    assert dense > 100 and got == ranked(D, Q, ids, 3)


def test_terms_of_a_batch_are_those_of_the_pattern(spark, monkeypatch):
    random.seed(3)
    pool = [*"abXYZ019_ \n\t.,'-", *"éÉßΣςσİıǅﬁ½²Ⅷ一二٣", "́", "‍", "̇", "𝒜", "𐐀", "🙂", "�", "ࡰ", "­", "\x00"]
    rows = [None, "", " ", "a", "é", "ΑΣ ΑΣ.Α", "İstanbul"] + ["".join(random.choices(pool, k=random.randint(0, 50))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").coalesce(1)
    got = df.select("i", F.lower("t").alias("low"), terms("t").alias("want")).orderBy("i").toArrow()
    finder = term_lists.TermLists(term_lists.term_ranges())
    for size in (1, 60, 1_000_000):
        monkeypatch.setattr(term_lists, "SLICE_BYTES", size)
        assert [x for part in finder.slices(got["low"].combine_chunks().slice(3)) for x in part.to_pylist()] == got["want"].to_pylist()[3:]


def test_words_are_hashed_as_by_md5():
    random.seed(5)
    words = ["", "a", "é" * 27, "x" * 55, "x" * 56, "y" * 300] + ["".join(random.choices("abä0_一", k=random.randint(1, 40))) for _ in range(500)]
    for dim in (256, 1_000_003):
        assert embed._md5_buckets(pa.array(["q", *words]).slice(1), dim).tolist() == [embed._md5_bucket(w, dim) for w in words]


def test_vectors_from_counts_are_those_of_the_text(spark):
    df = spark.createDataFrame([(0, "a b a, C c"), (1, ""), (2, None), (3, "x " * 500)], "i int, t string")
    for_text, emb = embed.bucket_counts("t", 16), embed.HashingEmbedder(dim=16, sparse=True)
    rows = df.select("i", emb.column("t").alias("a"), for_text.alias("c")).select("*", emb.column_of_counts("c").alias("b")).collect()
    assert all(r.a == r.b for r in rows) and {r.i: r.c and sum(x.n for x in r.c) for r in rows} == {0: 5, 1: [], 2: None, 3: 500}


def test_expanded_texts_are_not_written(spark, tmp_path, monkeypatch):
    """The texts of the hits stand in an expanded question many times over; vector and buckets are kept of it."""
    kept = []
    inner = answer.written
    monkeypatch.setattr(answer, "written", lambda df, name: kept.append((name, df.columns)) or inner(df, name))
    emb = embed.HashingEmbedder(dim=rerank.BUCKETS, sparse=True)
    base = spark.createDataFrame([(i, f"f{i}", f"word{i % 5} thing{i % 3} other") for i in range(12)], "entity_id long, file_path string, code string")
    mt = emb.embed(base, "code", "method_embeddings")
    ct = emb.embed(base.select("entity_id", "file_path", F.col("code").alias("source_code"), F.lit("").alias("references")), "source_code", "class_embeddings")
    turns = spark.createDataFrame([(u, t, "@codebase word1" if t == 1 else "thing2") for u in range(4) for t in (1, 2)], "user long, turn int, text string")
    out = answer.answer_log(turns.withColumn("rr", F.col("user") % 2 == 0), mt, ct, emb, user_col="user", order_col="turn", rerank_col="rr").collect()
    assert len(out) == 8 and all("File: f" in r.response for r in out)
    assert kept and not [c for _, c in kept if "hyde_query_v2" in c]
    assert any("query_vec" in c for _, c in kept)
