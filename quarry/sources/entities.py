"""Entity tables as CSV (S8-S12) for exchange with tools that expect the flat files.

Parquet is the default storage; these are the text-file equivalents. Written with
quoting on every field so multi-line source code survives, and read back with an
explicit all-string schema; blanks at the ends of a text stay. Only empty cells become null — words like ``NA`` or
``None`` stay text (no type inference).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

CLASS_FIELDS, METHOD_FIELDS = K.CLASS_FIELDS, K.METHOD_FIELDS


def write_entities_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """Header + the given columns in order (all of the frame's by default); never
    overwrites an input path."""
    fields = fields or df.columns
    (df.select(*[F.col(c).cast("string") for c in fields])
     .write.mode("errorifexists")
     .option("header", True).option("quoteAll", True).option("escape", '"').option("multiLine", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def read_entities_csv(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """All-string columns, explicit schema."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in fields])
    return (spark.read.schema(schema)
            .option("header", True).option("multiLine", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(path))
