"""Readers for the driver tables and for the index tables this library writes.

Every reader returns a lazy DataFrame over Parquet, so column pruning and filter
pushdown reach the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def balanced(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread an under-partitioned scan over the cluster's cores.

    A scan yields one task per Parquet row group; a file written as one row group
    would put every per-row text operation on one core. When the table has fewer
    files than ``min_partitions`` (the session's parallelism), rows are hash-distributed on
    the leading key columns; a table of many files is read as it is.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) < target:
        # hash on the leading key columns (numbers/timestamps, not long text): as
        # deterministic under task retries as a round-robin split, without the full
        # sort that round-robin needs for that
        keys = [f.name for f in df.schema.fields[:2] if isinstance(f.dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType))]
        return df.repartition(target, *[F.col(c) for c in (keys or df.columns[:1])])
    return df


def table(spark: SparkSession, sf_dir: str, name: str, balance: bool = True) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return balanced(df) if balance else df
