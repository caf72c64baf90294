"""The stored history of turns (S19, H4, H5): an append sink, and the last entries of some users.

Entries lie in the runs of a batch log (``batch_log``), each run in folders by bucket of the user
and sorted by user and turn within them. A reader of a few users opens the folders of their
buckets only (a partition filter), and skips the row groups outside their range of users
(a pushed filter).

Rows are dealt to tasks by ranges of (bucket, user, turn), so a user with a third of all
entries is written by many tasks; the last ``n`` of a user are picked before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import chat
from . import batch_log

#: part of the format: the folder of a user must stay the same for all runs
BUCKETS = 16
SCHEMA = "user string, turn bigint, entry string, bucket int"


def bucket_of(user):
    return F.pmod(F.xxhash64(user), F.lit(BUCKETS)).cast("int")


def _laid_out(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("bucket", "user", "turn").sortWithinPartitions("bucket", "user", "turn")


def append_entries(
    entries: DataFrame, root: str, batch_id: int, *, user_col: str, order_col: str, entry_col: str = "entry", fan: int = batch_log.FAN
) -> None:
    """H4: store a batch of entries; writing the newest batch again replaces it.

    Users are kept as text and turns as whole numbers. An entry without a user is stored, and
    read with all users only. An empty batch is a batch.
    """
    rows = entries.select(F.col(user_col).cast("string").alias("user"), F.col(order_col).cast("bigint").alias("turn"), F.col(entry_col).alias("entry"))
    rows = rows.withColumn("bucket", bucket_of(F.col("user")))
    batch_log.append(_laid_out(rows), root, batch_id, schema=SCHEMA, merge=_laid_out, partition="bucket", fan=fan)


def sink(root: str, *, user_col: str, order_col: str, entry_col: str = "entry", fan: int = batch_log.FAN):
    """H4 for ``writeStream.foreachBatch``: every micro-batch becomes one batch of the log."""

    def write(batch: DataFrame, batch_id: int):
        append_entries(batch, root, batch_id, user_col=user_col, order_col=order_col, entry_col=entry_col, fan=fan)

    return write


def entries(spark: SparkSession, root: str, users: DataFrame | None = None, *, user_col: str = "user", fan: int = batch_log.FAN) -> DataFrame:
    """Stored ``(user, turn, entry)``, of all users or of those in ``users`` (each once, null: none).

    The driver learns which of the 16 buckets are asked for and the range of users, never the users.
    """
    have = batch_log.runs(spark, root)
    stored = batch_log.read(spark, root, batch_log.cover(have, batch_log.newest(have, fan), fan), SCHEMA, fan)
    if users is not None:
        asked = users.select(F.col(user_col).cast("string").alias("user")).where(F.col("user").isNotNull()).distinct()
        look = asked.agg(F.collect_set(bucket_of(F.col("user"))).alias("b"), F.min("user").alias("lo"), F.max("user").alias("hi")).first()
        if look["lo"] is None:
            return stored.where(F.lit(False)).select("user", "turn", "entry")
        stored = stored.where(F.col("bucket").isin(sorted(look["b"])) & F.col("user").between(look["lo"], look["hi"]))
        stored = stored.join(asked, "user", "left_semi")
    return stored.select("user", "turn", "entry")


def last_entries(
    spark: SparkSession, root: str, users: DataFrame | None = None, *, user_col: str = "user", n: int = K.HISTORY_LAST, fan: int = batch_log.FAN
) -> DataFrame:
    """S19 + H5: the last ``n`` stored entries per user, oldest first, joined by line breaks."""
    return chat.last_n_history(entries(spark, root, users, user_col=user_col, fan=fan), user_col="user", order_col="turn", n=n)


def clean_up(spark: SparkSession, root: str, *, fan: int = batch_log.FAN) -> int:
    """Delete runs that larger ones hold, but for those that a retry of the newest batch needs.

    A job that reads while this runs may lose its files and has to be run again.
    """
    size = batch_log.newest(batch_log.runs(spark, root), fan)
    return batch_log.forget(spark, root, max(0, size - 1), fan)
