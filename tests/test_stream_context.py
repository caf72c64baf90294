import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import chat
from quarry.streaming import context_stream as cs

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def skewed_log(spark):
    """Quiet first and last hours, one user with most events, setters without a value."""
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(0, t0, 1, "signup", 0.0, "first"), (1, t0 + dt.timedelta(minutes=1), 2, "view", 0.0, "x")]
    for i in range(2, 80):
        kind = "signup" if i % 7 == 0 else "view"
        rows.append((i, t0 + dt.timedelta(hours=5, seconds=i), 1 if i % 4 else 2, kind, 0.0, None if i % 14 == 0 else f"p{i}"))
    rows.append((80, t0 + dt.timedelta(hours=9), 1, "view", 0.0, "y"))
    rows.append((81, t0 + dt.timedelta(hours=9, minutes=5), 2, "view", 0.0, "z"))
    return spark.createDataFrame(rows, EVENTS)


def test_stream_equals_plain_window(spark):
    log = skewed_log(spark)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = log.withColumn("context", F.coalesce(F.last(F.when(F.col("event_type") == "signup", F.col("props")), ignorenulls=True).over(w), F.lit("")))
    want = sorted((r.event_id, r.context) for r in want.collect())
    assert sorted((r.event_id, r.context) for r in cs.replay_events_context(spark, log).collect()) == want
    batch = chat.carry_context(log, user_col="user_id", order_cols=["ts", "event_id"], is_setter=F.col("event_type") == "signup", value=F.col("props"))
    assert sorted((r.event_id, r.context) for r in batch.collect()) == want


def test_empty_log(spark):
    assert cs.replay_events_context(spark, skewed_log(spark).limit(0)).collect() == []


def test_lost_state_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        cs._read_state(spark, str(tmp_path), 3, "user_id long, context string").collect()


def test_null_setter_keeps_the_state(spark):
    rows = [(1, 1, True, "A"), (1, 2, True, None)]
    df = spark.createDataFrame(rows, "user_id long, t long, s boolean, v string")
    _, state = cs.carry_context_batch(df, spark.createDataFrame([], "user_id long, context string"), user_col="user_id", order_cols=["t"], setter=F.col("s"), value=F.col("v"), keep_cols=["t"])
    assert [tuple(r) for r in state.collect()] == [(1, "A")]


def test_text_order_and_gaps(spark):
    rows = [("u", f"2024-01-{d:02d}T{h:02d}", d == 3, f"v{d}{h}") for d in range(1, 6) for h in (1, 9)]
    df = spark.createDataFrame(rows, "user string, t string, s boolean, v string")
    got = [r.context for r in chat.carry_context(df, user_col="user", order_cols=["t"], is_setter=F.col("s"), value=F.col("v")).orderBy("t").collect()]
    assert got == [""] * 4 + ["v31"] + ["v39"] * 5
    with pytest.raises(ValueError):
        chat.default_chunk(spark.createDataFrame([(True,)], "b boolean"), "b")
    turns = spark.createDataFrame([(1, 1, "user", "a"), (1, 900, "assistant", "b"), (1, 901, "user", "c"), (1, 905, "user", "d"), (2, 5, "user", "e")], "c long, t long, role string, text string")
    got = sorted((r.c, r.t, r.response) for r in chat.pair_turns(turns, conv_col="c", turn_col="t", role_col="role", text_col="text").collect())
    assert got == [(1, 1, "b"), (1, 901, None), (1, 905, None), (2, 5, None)]
    users = chat.assign_user(spark.createDataFrame([(None, "s1"), (None, "s1"), (None, "s2"), ("u", "s2")], "user_id string, sid string"), session_col="sid").collect()
    assert users[0].user_id == users[1].user_id != users[2].user_id and users[3].user_id == "u"
