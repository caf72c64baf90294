import os
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import chat
from quarry.sources import batch_log, history
from quarry.streaming import context_stream as cs


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cover_takes_the_largest_runs_and_misses_none():
    have = {(0, i) for i in range(11)} | {(1, i) for i in range(5)} | {(2, 0), (2, 1), (3, 0)}
    assert batch_log.newest(have, 2) == 11
    assert batch_log.cover(have, 11, 2) == [(3, 0), (1, 4), (0, 10)]
    assert batch_log.cover(have, 7, 2) == [(2, 0), (1, 2), (0, 6)]
    assert batch_log.cover(set(), 0) == []
    with pytest.raises(FileNotFoundError):
        batch_log.cover(have - {(0, 10)}, 11, 2)


def turns(spark, rows):
    return spark.createDataFrame(rows, "who string, at long, entry string")


def planted(no):
    """One user with half of all entries, one without a name, many that come and go."""
    rows = [("hot", 1000 * no + i, f"h{no}-{i}") for i in range(40)] + [(f"u{(no * 7 + i) % 90}", 1000 * no + i, f"{no}-{i}") for i in range(40)]
    return [*rows, (None, 1000 * no, f"nobody-{no}")] if no != 3 else []  # batch 3 is empty


def plain_last(rows, n=5):
    by = {}
    for who, at, entry in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(who, []).append(entry)
    return {w: "\n".join(es[-n:]) for w, es in by.items()}


def test_history_equals_plain_python_after_merges_retries_and_clean_up(spark, tmp_path):
    root, rows = str(tmp_path), []
    for no in range(5):
        history.append_entries(turns(spark, planted(no) + [("lost", 1, "of a dead attempt")]), root, no, user_col="who", order_col="at", fan=2)
        history.append_entries(turns(spark, planted(no)), root, no, user_col="who", order_col="at", fan=2)  # the retry
        rows += planted(no)
        if no == 3:
            history.clean_up(spark, root, fan=2)
            history.append_entries(turns(spark, planted(no)), root, no, user_col="who", order_col="at", fan=2)  # also after it
    got = {r.user: r.history for r in history.last_entries(spark, root, fan=2).collect()}
    assert got == plain_last(rows)
    # few runs are left of five batches, and no gap or step back is taken
    assert batch_log.cover(batch_log.runs(spark, root), 5, 2) == [(2, 0), (0, 4)]
    for wrong in (3, 6):
        with pytest.raises(ValueError):
            history.append_entries(turns(spark, []), root, wrong, user_col="who", order_col="at", fan=2)


def test_few_users_read_few_files(spark, tmp_path):
    root, rows = str(tmp_path), planted(0) + planted(1)
    history.append_entries(turns(spark, rows), root, 0, user_col="who", order_col="at")
    users = spark.createDataFrame([("u3",), ("hot",), ("u3",), (None,), ("nobody of these",)], "name string")
    got = history.last_entries(spark, root, users, user_col="name")
    want = plain_last(rows)
    assert {r.user: r.history for r in got.collect()} == {u: want[u] for u in ("u3", "hot")}
    some = history.entries(spark, root, users, user_col="name")
    plan = plan_text(some)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|INSET)", plan), plan
    assert "GreaterThanOrEqual(user,hot)" in plan and "LessThanOrEqual(user,u3)" in plan
    none = spark.createDataFrame([(None,)], "name string")
    assert history.last_entries(spark, root, none, user_col="name").collect() == []


def test_empty_store(spark, tmp_path):
    assert history.last_entries(spark, str(tmp_path)).collect() == []
    history.append_entries(turns(spark, []), str(tmp_path), 0, user_col="who", order_col="at")
    assert history.last_entries(spark, str(tmp_path)).collect() == []


SCHEMA = "user_id long, t long, s boolean, v string"


def stream_rows(no):
    return [(u, 100 * no + u, (u + no) % 3 == 0, None if u % 5 == 0 else f"{no}-{u}") for u in range(20)] + [(99, 100 * no + i, i % 4 == no, f"hot{no}-{i}") for i in range(30)]


def start(spark, root, src):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    return cs.carry_context_stream(stream, root=root, user_col="user_id", order_cols=["t"], setter=F.col("s"), value=F.col("v"), keep_cols=["t"], fan=2)


def test_stream_equals_batch_after_a_kill_at_every_step(spark, tmp_path, monkeypatch):
    root, src, rows = str(tmp_path / "q"), str(tmp_path / "in"), []
    real, calls = batch_log.append, []

    def dies(*args, **kw):
        """Every first attempt of a batch is lost: before it writes, or after."""
        batch_id = args[2]
        calls.append(batch_id)
        if calls.count(batch_id) == 1:
            if batch_id % 2:
                real(*args, **kw)
            raise RuntimeError("planted loss")
        real(*args, **kw)

    monkeypatch.setattr(batch_log, "append", dies)
    for no in range(5):
        spark.createDataFrame(stream_rows(no), SCHEMA).coalesce(1).write.mode("append").parquet(src)
        rows += stream_rows(no)
        with pytest.raises(Exception, match="planted loss"):
            start(spark, root, src).awaitTermination()
        start(spark, root, src).awaitTermination()
    assert sorted(calls) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    w = Window.partitionBy("user_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    log = spark.createDataFrame(rows, SCHEMA)
    want = log.withColumn("context", F.coalesce(F.last(F.when(F.col("s"), F.col("v")), ignorenulls=True).over(w), F.lit("")))
    got = spark.read.parquet(os.path.join(root, "output"))
    assert sorted((r.user_id, r.t, r.context) for r in got.collect()) == sorted((r.user_id, r.t, r.context) for r in want.collect())
    # runs that larger ones hold are gone but for those of the last step
    assert batch_log.runs(spark, os.path.join(root, "state")) == {(2, 0), (0, 4)}


def test_a_batch_writes_its_own_users_only(spark, tmp_path):
    root, src = str(tmp_path / "q"), str(tmp_path / "in")
    for users in (range(1000), range(500, 510)):
        spark.createDataFrame([(u, len(users), True, f"{u}") for u in users], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        cs.carry_context_stream(stream, root=root, user_col="user_id", order_cols=["t"], setter=F.col("s"), value=F.col("v"), keep_cols=["t"]).awaitTermination()
    written = [spark.read.parquet(batch_log.run_path(os.path.join(root, "state"), (0, no))).count() for no in (0, 1)]
    assert written == [1000, 10]


def test_the_sink_takes_micro_batches(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "h")
    for no in (0, 1):
        turns(spark, planted(no)).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("who string, at long, entry string").parquet(src)
        write = history.sink(root, user_col="who", order_col="at")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {r.user: r.history for r in history.last_entries(spark, root).collect()}
    assert got == plain_last(planted(0) + planted(1))


def test_equal_turns_are_told_apart_by_their_text(spark):
    rows = turns(spark, [("a", 1, e) for e in "gfedcba"])
    got = chat.last_n_history(rows, user_col="who", order_col="at", n=3).collect()
    assert [r.history for r in got] == ["e\nf\ng"]
