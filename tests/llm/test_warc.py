import hashlib

from pyspark.sql import functions as F

from quarry.llm import warc as W
from quarry.session import scratch_path

SF = "/root/testdata/sf0.001"


def archive(spark, rows, n=3):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, hash int, node int")
    return W.write_warc(pages, scratch_path(spark, "warc"), n)


def pages(n=200):
    return [(i, f"http://x/{i}", f"<p>{i}</p>" * (1 + i % 50), 0, 0) for i in range(n)]


def test_layout(spark):
    rows = archive(spark, pages() + [(None, None, None, 0, 0), (5, "http://x/5", "<p>é</p>", 0, 0)]).collect()
    assert len(rows) == 202
    for a in {r.archive for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.archive == a), key=lambda r: r.offset):
            assert r.offset == at and len(r.record) == r.length
            head, body = bytes(r.record).split(b"\r\n\r\n", 1)
            assert head.startswith(b"WARC/1.0\r\n") and int(head.rsplit(b" ", 1)[1]) == len(body) - 4
            at += r.length


def test_audit_finds_exactly_the_damage(spark):
    first = archive(spark, pages(400))
    second = W.damaged(first).withColumn("record", F.when(F.col("page_id") == 77, F.lit("x").cast("binary")).otherwise(F.col("record")))
    extra = first.where("page_id = 9").withColumn("offset", F.lit(10**9))
    got = {(r.page_id, r.status) for r in W.audit(first, second.unionByName(extra), range_bytes=512).collect()}
    want = {(i, "missing" if i % 101 == 5 else "changed") for i in range(400) if i % 101 == 5 or i % 97 == 3 or i == 77} | {(9, "added")}
    assert got == want


def test_same_and_empty(spark):
    first = archive(spark, pages(50))
    assert W.audit(first, first).collect() == []
    none = first.where("page_id < 0")
    assert W.audit(none, none).collect() == []
    assert W.audit(first, none).groupBy("status").count().collect() == [("missing", 50)]
    assert W.audit(none, first).groupBy("status").count().collect() == [("added", 50)]
    empty = archive(spark, [])
    assert empty.count() == 0


def test_repeated_rows(spark):
    first = archive(spark, [(1, "u", "same", 0, 0)] * 40)
    twice = first.unionByName(first.where("offset = 0"))
    got = W.audit(first, twice).collect()
    assert {r.status for r in got} == {"changed"}
    assert {(r.archive, r.offset) for r in got} == {(r.archive, 0) for r in first.where("offset = 0").collect()}


def test_root_is_the_hash_of_its_children(spark):
    every = W.leaves(archive(spark, pages(120), 2)).withColumn("replica", F.lit(0))
    levels, up = W.tree(every, 1024)
    assert levels[-1].count() == 1 and up >= 1
    for low, high in zip(levels[:-1], levels[1:]):
        kids = low.collect()
        for node in high.collect():
            if high is levels[len(levels) - up]:
                own = sorted((k.archive, k.hash) for k in kids if k.archive >> 4 == node.node)
            else:
                own = sorted((k.node, k.hash) for k in kids if k.archive == node.archive and k.node >> 4 == node.node)
            assert node.hash == hashlib.sha256(("1" + ",".join(f"{n}:{h}" for n, h in own)).encode()).hexdigest()


def test_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    got = sorted((r.length, r.page_id, r.status) for r in W.op4_warc(spark, SF).collect())
    assert got == sorted((b, a, c) for a, b, c in con.execute(W.ORACLE).fetchall())
