import math

import pytest

from quarry.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int, score int"


def brute(rows, k=10, every=100):
    q = {}
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in sorted({(i, tuple(v)) for i, v in ok if i % every == 0}):
        if i in q:
            continue
        q[i] = v
        s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def got(spark, rows):
    base = K.quantised(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(r) for r in K.topk(base, base.where("vec_id % 100 = 0")).collect())


def test_against_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(K, "BLOCK", 3)
    rng = random.Random(3)
    # float32-exact values, many ties
    rows = [(i, [rng.randint(-8, 8) / 8 for _ in range(4)], 1, 2) for i in range(700)]
    rows += [(i, [0.5, -0.25, 0.125, 1.0], 1, 2) for i in range(1000, 1600)]  # a third are one vector
    rows += [(2000, None, 1, 2), (2100, [], 1, 2), (2200, [None, 1.0, 1.0, 1.0], 1, 2), (2300, [math.nan] * 4, 1, 2), (2400, [math.inf, 0.0, 0.0, 0.0], 1, 2), (None, [1.0, 1.0, 1.0, 1.0], 1, 2)]
    rows += [(2500, [1.0, 0.5], 1, 2), (2501, [0.5, 0.5], 1, 2), (33, rows[33][1], 1, 2)]
    rows = [(i, [x if x is None else float(x) for x in v] if v is not None else None, a, b) for i, v, a, b in rows]
    assert got(spark, rows) == brute(rows)


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0], 1, 1), (1, [1.0, 0.0], 1, 1), (2, [-1.0, 0.0], 1, 1)]
    assert got(spark, rows) == [(0, 1, 1, 1048576), (0, 2, 2, -1048576)]
    assert got(spark, rows[:1]) == [] and got(spark, []) == []


def test_wide_numbers():
    import numpy as np

    q = np.array([[2**40, 1]], dtype=np.int64)
    assert K._scores(q, q)[0, 0] == 2**80 + 1


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_oracle(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = sorted(con.execute(K.ORACLE).fetchall())
    assert sorted(tuple(r) for r in K.op3_topk(spark, sf).collect()) == want


@pytest.mark.parametrize("block", [1, 1024])
def test_every_vector_of_a_query_id_asks(spark, monkeypatch, tmp_path, block):
    import random

    import duckdb

    monkeypatch.setattr(K, "BLOCK", block)
    rng = random.Random(6)
    rows = [(i, [rng.randint(-8, 8) / 8 for _ in range(3)], 1, 2) for i in range(120)]
    rows += [(100, [1.0, 1.0, -1.0], 1, 2), (100, [-1.0, 0.5, 1.0], 1, 2), (0, [0.5, 0.25], 1, 2), (7, [1.0, 1.0], 1, 2)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(K.ORACLE).fetchall())
    assert len(want) == 20 and sorted(tuple(r) for r in K.op3_topk(spark, str(tmp_path)).collect()) == want
