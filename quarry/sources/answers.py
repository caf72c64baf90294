"""Answers of a model, asked for once.

A store is a folder of Parquet files with one row per prompt sent: the key (a SHA-256 of model
and prompt) with the answer, or with the error of a request that failed. ``ask`` sends only
prompts whose key has no answer yet, each distinct prompt once, so a job that died is run
again and goes on where it stopped.

What a job has paid for is kept in small steps. A task sends ``task_rows`` prompts at most, and
its file appears in the store when it ends, whatever becomes of its job (the store is written with
the committer that moves files task by task). A request that fails costs only its own
prompts: the others of its task are stored. A lost executor costs the requests in flight on it.
Files are read by key with repeats put together, so a task that was run twice does no harm.

Every table here is as large as the prompts or smaller, and is joined by the key: nothing is
collected but a count and one error text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K

#: a job of one wave: this many tasks at most, so that the driver's list of tasks stays bounded
WAVE_TASKS = 20_000


def key_of(model: str, prompt: Column) -> Column:
    """The key of a prompt for a model; the length of the name keeps (ab, c) from (a, bc)."""
    return F.sha2(F.concat(F.lit(f"{len(model)}:{model}:"), prompt), 256)


def _log_schema(answer_type: str) -> str:
    return f"key string, answer {answer_type}, error string"


def _folders(spark: SparkSession, root: str) -> tuple[list[str], int]:
    """The folders to read, and the number of the newest compacted one (0: none)."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    newest = max(done, default=0)
    return [f"{root}/v={newest}"] * (newest > 0) + [f"{root}/log"] * ("log" in names), newest


def log(spark: SparkSession, root: str, answer_type: str = "string") -> DataFrame:
    """One row ``(key, answer, error)`` per prompt sent; exactly one of the last two is null.

    ``compact`` puts answered prompts together and drops errors.
    """
    found = _folders(spark, root.rstrip("/"))[0]
    schema = _log_schema(answer_type)
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def answers(spark: SparkSession, root: str, answer_type: str = "string") -> DataFrame:
    """``(key, answer)``, one row per answered prompt."""
    got = log(spark, root, answer_type).where(F.col("answer").isNotNull())
    return got.groupBy("key").agg(F.min("answer").alias("answer"))


def _sender(call: Callable[[list], list], batch: int, concurrency: int, attempts: int):
    """Sends the prompts of a task in requests; a request without an answer leaves its error."""

    def send(prompts: list) -> list:
        said = ""
        for _ in range(attempts):
            try:
                got = list(call(prompts))
                if len(got) != len(prompts):
                    raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
                return [(a, None if a is not None else "no answer") for a in got]
            except Exception as e:  # kept as the error of these prompts; ask() reports it
                said = f"{type(e).__name__}: {e}"
        return [(None, said)] * len(prompts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for frame in frames:
                prompts = frame["prompt"].tolist()
                cuts = [prompts[i : i + batch] for i in range(0, len(prompts), batch)]
                found = [x for part in pool.map(send, cuts) for x in part]
                yield pd.DataFrame({"key": frame["key"], "answer": pd.Series([a for a, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    return run


def ask(
    prompts: DataFrame,
    root: str,
    call: Callable[[list], list],
    *,
    model: str,
    prompt: str | Column = "prompt",
    out_col: str = "answer",
    answer_type: str = "string",
    batch: int = K.ENRICH_BATCH,
    concurrency: int = K.ENRICH_CONCURRENCY,
    attempts: int = 1,
    task_rows: int = K.ENRICH_BATCH * K.ENRICH_CONCURRENCY,
    wave_tasks: int = WAVE_TASKS,
    strict: bool = True,
) -> DataFrame:
    """Add ``out_col``, the model's answer to ``prompt``; prompts answered before aren't sent.

    ``call`` takes a list of up to ``batch`` prompts and gives a list of as many answers of
    ``answer_type``; None is no answer. Requests that fail are tried ``attempts`` times within
    a run. Prompts left without an answer raise after all others are stored, or with ``strict=False`` get a
    null. A null prompt isn't sent and gets a null; an empty one is a prompt. Repeated rows
    stay, an empty table gives none, and other columns may have any name but ``out_col``.

    Asking happens here, not when the result is read; ``prompts`` is read twice and should be a
    table, or checkpointed, where it is dear.
    """
    if out_col in prompts.columns:
        raise ValueError(f"column {out_col} exists already")
    spark = prompts.sparkSession
    root = root.rstrip("/")
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    wanted = prompts.select(prompt.alias("prompt")).where(F.col("prompt").isNotNull())
    wanted = wanted.withColumn("key", key_of(model, F.col("prompt"))).groupBy("key").agg(F.min("prompt").alias("prompt"))
    pending = f"{root}/pending-{uuid.uuid4().hex}"
    todo = wanted.join(answers(spark, root, answer_type).select("key"), "key", "left_anti")
    # sorted, so that a wave's range of keys skips the row groups of the others
    todo.sortWithinPartitions("key").write.parquet(pending)
    stored = spark.read.schema("key string, prompt string").parquet(pending)
    try:
        tasks = -(-stored.count() // task_rows)
        waves = -(-tasks // wave_tasks)
        bounds = [f"{16**8 * w // waves:08x}" for w in range(waves)] + ["g"]
        run = _sender(call, batch, concurrency, attempts)
        for low, high in zip(bounds, bounds[1:]):
            part = stored.where((F.col("key") >= low) & (F.col("key") < high)).repartition(-(-tasks // waves), F.xxhash64("key"))
            # version 2 moves a task's file when the task ends, not when its job does
            sent = part.mapInPandas(run, _log_schema(answer_type)).write.mode("append")
            sent.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{root}/log")
        got = answers(spark, root, answer_type)
        lost = stored.join(got, "key", "left_anti").count() if strict and tasks else 0
        if lost:
            errors = log(spark, root, answer_type).join(stored, "key", "left_semi").agg(F.max("error")).first()
            raise RuntimeError(f"{lost} prompts without an answer, the others are stored; one error: {errors[0]}")
    finally:
        _delete(spark, pending)
    key, out = f"_key_{uuid.uuid4().hex[:8]}", f"_answer_{uuid.uuid4().hex[:8]}"
    got = got.select(F.col("key").alias(key), F.col("answer").alias(out))
    return prompts.withColumn(key, key_of(model, prompt)).join(got, key, "left").drop(key).withColumnRenamed(out, out_col)


def compact(spark: SparkSession, root: str, answer_type: str = "string") -> None:
    """Write the answers of all files into few and drop errors; not while a job asks or reads.

    The new folder is complete before the old ones go; a job that dies in between leaves answers that
    are read twice and counted once.
    """
    root = root.rstrip("/")
    old, newest = _folders(spark, root)
    kept = answers(spark, root, answer_type).withColumn("error", F.lit(None).cast("string"))
    kept.write.mode("overwrite").parquet(f"{root}/v={newest + 1}")
    for path in old:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
