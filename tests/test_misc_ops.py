import numpy as np
from pyspark.sql import functions as F

from quarry.functions import vectors as vec
from quarry.operators import chat, embed
from quarry.sources import files as src


def test_native_vector_expressions_match_numpy(spark):
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=7), rng.normal(size=7)
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<double>, b array<double>")
    r = df.select(vec.dot("a", "b").alias("d"), vec.cosine("a", "b").alias("c"), vec.l2("a", "b").alias("l")).first()
    assert abs(r.d - a @ b) < 1e-12
    assert abs(r.c - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    assert abs(r.l - np.linalg.norm(a - b)) < 1e-12


def test_hash_embedding_is_normalised_and_deterministic(spark):
    df = spark.createDataFrame([(1, "Alpha beta beta"), (2, ""), (3, None)], "id long, t string")
    e = embed.HashingEmbedder(dim=16)
    rows = {r.id: r.v for r in e.embed(df, "t", "v").collect()}
    assert abs(np.linalg.norm(rows[1]) - 1) < 1e-12
    # counts alpha=1, beta=2 → squared weights 1/5 and 4/5 (or one bucket holding all 3)
    top = sorted(np.round(np.square(rows[1]) * 5, 6))[-2:]
    assert top in ([1.0, 4.0], [0.0, 5.0])
    assert rows[2] == [0.0] * 16 and rows[3] is None
    again = {r.id: r.v for r in e.embed(df, "t", "v").collect()}
    assert again[1] == rows[1]


def test_assign_user_keeps_or_mints(spark):
    df = spark.createDataFrame([("u1",), (None,), (None,)], "user_id string")
    ids = [r.user_id for r in chat.assign_user(df).collect()]
    assert ids[0] == "u1" and all(ids) and len(set(ids)) == 3


def test_corpus_name(spark):
    df = spark.createDataFrame([("/a/b/proj/",), ("proj2",), ("/x/y",)], "p string")
    assert [r.n for r in df.select(src.corpus_name(F.col("p")).alias("n")).collect()] == ["proj", "proj2", "y"]


def test_two_pass_with_rerank_runs(spark):
    from quarry.plans import answer, index

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    emb = embed.HashingEmbedder(dim=64)
    mt, ct = index.document_tables(docs, emb)
    qs = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).limit(3)
    out = answer.two_pass_context(qs, mt, ct, emb, rerank=True).collect()
    assert len(out) == 3 and all(r.context.count("END OF ROW") == 3 for r in out)
