"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read with Spark's reader (any path Spark can open)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads the written table and nothing before it
    runs again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (Spark compares names without case)."""
    have = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in have:
        name = f"__{base}_{uuid.uuid4().hex[:6]}"
    return name


def fold(column, remainder_base: int):
    """crc32(doc_id as text) mod ``remainder_base``: the fold of a document (null: null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(remainder_base))


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_slices(batch, column: str = "text", chars: int = 4_000_000):
    """Cut an Arrow batch into runs of rows of about ``chars`` bytes of text: (rows, texts).

    Bounds what one step of a task holds, however many long texts a batch has; a longer
    single text is a run of its own. Null texts come as None.
    """
    texts = batch.column(column)
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    end = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        before = int(end[a - 1]) if a else 0
        z = max(a + 1, int(np.searchsorted(end, before + chars, side="right")))
        yield batch.slice(a, z - a), texts.slice(a, z - a).to_pylist()
        a = z
