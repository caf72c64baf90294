"""Tables that grow by numbered batches: one run of rows per batch, merged by levels.

A run is a Parquet folder ``level=<l>/v=<no>`` that holds batches ``no * fan**l`` up to
``(no + 1) * fan**l``. A batch writes its own rows and nothing else; where its number completes
``fan`` runs of a level, these are merged into one of the next. A row is written once per
level, and a reader meets at most ``fan - 1`` runs per level, so both grow with the logarithm
of the number of batches.

Batches are numbered from 0 without gaps. The newest may be written again (a retry): the runs it
needs stay until the next batch asks ``forget`` to delete what larger runs hold. Only folders
with a success mark count, so a batch that died half-way is as good as absent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8

Run = tuple[int, int]  # level, number


def run_path(root: str, run: Run) -> str:
    return f"{root.rstrip('/')}/level={run[0]}/v={run[1]:012d}"


def _end(run: Run, fan: int) -> int:
    return (run[1] + 1) * fan ** run[0]


def runs(spark: SparkSession, root: str) -> set[Run]:
    """The complete runs of a log (a few per level)."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = set()
    for level in fs.listStatus(path) if fs.exists(path) else []:
        for run in fs.listStatus(level.getPath()):
            if fs.exists(jvm.org.apache.hadoop.fs.Path(run.getPath(), "_SUCCESS")):
                names = (level.getPath().getName(), run.getPath().getName())
                found.add(tuple(int(n.split("=", 1)[1]) for n in names))
    return found


def newest(have: set[Run], fan: int = FAN) -> int:
    """How many batches a log holds."""
    return max((_end(r, fan) for r in have), default=0)


def cover(have: set[Run], upto: int, fan: int = FAN) -> list[Run]:
    """The fewest runs that hold batches 0 up to ``upto``, oldest first; a lost one raises."""
    at, out = 0, []
    while at < upto:
        fits = [r for r in have if r[1] * fan ** r[0] == at and _end(r, fan) <= upto]
        if not fits:
            raise FileNotFoundError(f"batch {at} of {upto} does not exist")
        out.append(max(fits))
        at = _end(out[-1], fan)
    return out


def read(spark: SparkSession, root: str, some: list[Run], schema: str, fan: int = FAN) -> DataFrame:
    """Rows of some runs in one scan; ``_end`` grows with the age of what a row's run holds last."""
    if not some:
        return spark.createDataFrame([], f"{schema}, _end bigint")
    df = spark.read.schema(f"{schema}, level int, v bigint").option("basePath", root).parquet(*[run_path(root, r) for r in some])
    end = (F.col("v") + 1) * F.pow(F.lit(fan), F.col("level")).cast("bigint")
    return df.withColumn("_end", end).drop("level", "v")


def append(
    df: DataFrame, root: str, batch_id: int, *, schema: str, merge: Callable[[DataFrame], DataFrame], partition: str | None = None, fan: int = FAN
) -> None:
    """Write batch ``batch_id`` and the merged runs that it completes; a retry overwrites the same folders.

    ``merge`` turns the rows of runs (with ``_end``) into the rows to keep. With ``partition``
    each run is laid out in folders of that column.
    """
    spark = df.sparkSession
    size = newest(runs(spark, root), fan)
    if batch_id not in (size, size - 1):
        raise ValueError(f"batch {batch_id} can't follow {size} batches")
    cols = [f.name for f in spark.createDataFrame([], schema).schema]

    def write(rows: DataFrame, run: Run):
        out = rows.select(*cols).write.mode("overwrite")
        (out.partitionBy(partition) if partition else out).parquet(run_path(root, run))

    write(df, (0, batch_id))
    level = 1
    while (batch_id + 1) % fan**level == 0:
        no = batch_id // fan**level
        parts = [(level - 1, no * fan + i) for i in range(fan)]
        write(merge(read(spark, root, parts, schema, fan)), (level, no))
        level += 1


def forget(spark: SparkSession, root: str, upto: int, fan: int = FAN) -> int:
    """Delete the runs of batches before ``upto`` that larger runs hold; returns how many.

    Safe while batch ``upto`` may still be retried: all that it reads stays.
    """
    have = runs(spark, root)
    kept = set(cover(have, upto, fan))
    old = [r for r in have if _end(r, fan) <= upto and r not in kept]
    for r in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(run_path(root, r))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(old)
