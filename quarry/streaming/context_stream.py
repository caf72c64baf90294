"""Per-user conversation context over a stream of turns (H2, streaming form).

``readStream`` of turn files → ``foreachBatch``. Each micro-batch is processed by
the same skew-safe batch operator as the batch form (``chat.carry_context``: a
window per ``(user, chunk)`` plus a per-chunk carry), seeded with the state carried
over from earlier micro-batches. The state is a log of ``(user, context)`` in the shared
folder (``sources.batch_log``): a micro-batch writes the users whose context it sets and no
others, and reads the newest value of the users that it holds. So state is neither held in
executor memory per key nor collected to one task, and a user with a third of all turns is
spread over as many tasks as the batch operator uses.

Exactly-once: a micro-batch writes its output to ``batch=<id>`` and its changes to the run of
that number with overwrite, reading the runs of the batches before; a retried micro-batch
rewrites the same folders. Runs that a larger one holds go when the next micro-batch starts,
when no retry can ask for them. Rows arriving in a later micro-batch with an earlier
timestamp are not reordered (the source has no event-time rule to wait for).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat
from ..sources import batch_log
from ..session import scratch_path


def _state_root(root: str) -> str:
    return os.path.join(root, "state")


def _newest(state: DataFrame, user_col: str) -> DataFrame:
    """One row per user: the context of the newest run."""
    return state.groupBy(user_col).agg(F.max_by("context", "_end").alias("context"))


def _read_state(spark: SparkSession, root: str, batch_id: int, schema: str, fan: int = batch_log.FAN) -> DataFrame:
    """Changes of the micro-batches before, with ``_end``; a missing run raises, users are never forgotten."""
    at = _state_root(root)
    return batch_log.read(spark, at, batch_log.cover(batch_log.runs(spark, at), batch_id, fan), schema, fan)


def carry_context_batch(
    batch: DataFrame,
    state: DataFrame,
    *,
    user_col: str,
    order_cols: list[str],
    setter,
    value,
    keep_cols: list[str],
    chunk=None,
    default: str = "",
):
    """One micro-batch: ``(rows with context, users whose context it sets)``."""
    inner = chat.carry_context(batch, user_col=user_col, order_cols=order_cols, is_setter=setter, value=value, chunk=chunk, default=None, out_col="_ctx")
    seeded = inner.join(state.withColumnRenamed("context", "_prev"), user_col, "left")
    rows = seeded.select(user_col, *[c for c in keep_cols if c != user_col], F.coalesce("_ctx", "_prev", F.lit(default)).alias("context"))
    ordk = [F.col(c) for c in order_cols]
    last = batch.where(setter & value.isNotNull()).groupBy(user_col).agg(F.max(F.struct(*ordk, value.alias("_v")))["_v"].alias("_new"))
    return rows, last.select(user_col, F.col("_new").alias("context"))


def carry_context_stream(
    stream: DataFrame,
    *,
    root: str,
    user_col: str,
    order_cols: list[str],
    setter,
    value,
    keep_cols: list[str],
    user_type: str = "bigint",
    chunk=None,
    trigger: dict | None = None,
    fan: int = batch_log.FAN,
):
    """Start the streaming H2 job; returns the query handle. Output: ``root/output``."""
    out_dir = os.path.join(root, "output")
    schema = f"{user_col} {user_type}, context string"

    def process(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        batch_log.forget(spark, _state_root(root), batch_id, fan)
        log = _read_state(spark, root, batch_id, schema, fan)
        state = _newest(log.join(batch.select(user_col).distinct(), user_col, "left_semi"), user_col)
        rows, changed = carry_context_batch(
            batch, state, user_col=user_col, order_cols=order_cols, setter=setter, value=value, keep_cols=keep_cols, chunk=chunk
        )
        rows.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={batch_id:012d}"))
        merge = lambda df: _newest(df, user_col)
        batch_log.append(changed, _state_root(root), batch_id, schema=schema, merge=merge, fan=fan)

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", os.path.join(root, "checkpoint"))
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()


def time_slices(df: DataFrame, ts_col: str, slices: int) -> list[DataFrame]:
    """A table as ``slices`` consecutive time ranges, oldest first; some may be empty.

    The slice of a row is computed in Spark from epoch microseconds (no datetime
    literals), so every row lands in exactly one slice whatever the time zones.
    """
    t = F.unix_micros(F.col(ts_col).cast("timestamp"))
    b = df.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    if b["lo"] is None:
        return []
    span = max(1, (b["hi"] - b["lo"] + slices) // slices)
    at = F.coalesce(F.least(F.floor((t - F.lit(b["lo"])) / F.lit(span)), F.lit(slices - 1)), F.lit(0))
    return [df.where(at == i) for i in range(slices)]


def replay_events_context(spark: SparkSession, events: DataFrame, slices: int = 3, fan: int = 2) -> DataFrame:
    """The event log replayed as a stream; a signup event sets a user's context.

    Each time range is appended to the source folder (as many files as it has partitions)
    and consumed by one run of the query, which goes on from the checkpoint of the run
    before: a micro-batch is exactly one range, whatever its size.
    """
    root = scratch_path(spark, "events-stream")
    src_dir = os.path.join(root, "input")
    for part in time_slices(events, "ts", slices):
        part.write.mode("append").parquet(src_dir)
        stream = spark.readStream.schema(events.schema).parquet(src_dir)
        q = carry_context_stream(
            stream, root=root, user_col="user_id", order_cols=["ts", "event_id"], setter=F.col("event_type") == "signup",
            value=F.col("props"), keep_cols=["event_id"], fan=fan,
        )
        q.awaitTermination()
    out = spark.createDataFrame([], "user_id bigint, event_id bigint, context string")
    if events.isEmpty():
        return out
    return spark.read.schema(out.schema).parquet(os.path.join(root, "output"))
