"""Row cleaning and formatting before embedding (P1-P10) and keep-last dedupe.

All native column expressions; no Python per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import text as tx


def alias_column(df: DataFrame, src: str = "source_code", dst: str = "code") -> DataFrame:
    """``code := source_code``."""
    return df.withColumn(dst, F.col(src))


def row_has_null(df: DataFrame, cols: list[str] | None = None):
    """Column: does this row have a null in any of ``cols`` (default: all)?"""
    cols = cols or df.columns
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def any_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row ``(rows, null_rows, any_null)`` — a single partial+final aggregate."""
    has = row_has_null(df, cols)
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.sum(has.cast("bigint")).cast("bigint").alias("null_rows"),
    ).select("rows", F.coalesce("null_rows", F.lit(0)).alias("null_rows"), (F.coalesce("null_rows", F.lit(0)) > 0).alias("any_null"))


def fill_nulls(df: DataFrame, value: str = K.NULL_FILL_METHOD, cols: list[str] | None = None) -> DataFrame:
    """Nulls in string columns → ``value`` (``'empty'`` for methods, ``''`` for classes)."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.na.fill(value, subset=cols)


def format_class_text(file_path, class_name, source, max_tokens: int = K.MAX_TOKENS_SMALL):
    """``File: {p}\\n\\nClass: {c}\\n\\nSource Code:\\n{clip(src)}\\n\\n``."""
    return F.concat(
        F.lit("File: "), tx._c(file_path), F.lit("\n\nClass: "), tx._c(class_name),
        F.lit("\n\nSource Code:\n"), tx.clip_tokens(source, max_tokens), F.lit("\n\n"),
    )


def format_special_text(file_path, content, max_tokens: int = K.MAX_TOKENS_SMALL):
    """P5: ``File: {p}\\n\\nContent:\\n{clip(text)}\\n\\n``."""
    return F.concat(F.lit("File: "), tx._c(file_path), F.lit("\n\nContent:\n"), tx.clip_tokens(content, max_tokens), F.lit("\n\n"))


CLASS_COLUMNS, METHOD_COLUMNS = K.CLASS_COLUMNS, K.METHOD_COLUMNS


def special_rows(files: DataFrame, max_tokens: int = K.MAX_TOKENS_SMALL, path_col: str = "file_path", content_col: str = "content") -> DataFrame:
    """Special files (``.md``/``.sh``) as class-table rows with ``'empty'`` metadata."""
    return files.select(
        format_special_text(path_col, content_col, max_tokens).alias("source_code"),
        F.col(path_col).alias("file_path"),
        *[F.lit(K.PLACEHOLDER).alias(c) for c in ["class_name", "constructor_declaration", "method_declarations", "references"]],
    )


def placeholder_row(df: DataFrame, value: str = K.PLACEHOLDER) -> DataFrame:
    """If ``df`` is empty, one row of ``value`` in every (string) column; else ``df``.

    Decided inside the plan (a one-row frame anti-joined on an existence probe), so no
    driver-side count is needed.
    """
    spark = df.sparkSession
    one = spark.range(1).select(*[F.lit(value).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    probe = df.limit(1).select(F.lit(1).alias("_p"))
    fill = one.withColumn("_p", F.lit(1)).join(probe, "_p", "left_anti").drop("_p")
    return df.unionByName(fill)


def prepare_method_rows(methods: DataFrame, clip: bool = False, max_tokens: int = K.MAX_TOKENS_SMALL) -> DataFrame:
    """Method table rows as stored: ``code`` = source (clipped only when asked), nulls → 'empty'."""
    src = tx.clip_tokens("source_code", max_tokens) if clip else F.col("source_code")
    out = methods.withColumn("code", src)
    return fill_nulls(out, K.NULL_FILL_METHOD).select(*METHOD_COLUMNS)


def prepare_class_rows(classes: DataFrame, max_tokens: int = K.MAX_TOKENS_SMALL) -> DataFrame:
    """Class table rows as stored: nulls → '', source decorated and clipped."""
    filled = fill_nulls(classes, K.NULL_FILL_CLASS)
    out = filled.withColumn("source_code", format_class_text("file_path", "class_name", "source_code", max_tokens))
    return placeholder_row(out.select(*CLASS_COLUMNS))


def keep_last(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """One row per key, the last by ``order_cols`` (explicit scan order).

    ``max_by`` over a struct is a hash aggregate with a partial step before the
    shuffle, so a hot key contributes one partial row per map task, not all its rows.
    """
    others = [c for c in df.columns if c not in keys]
    ordk = F.struct(*[F.col(c) for c in order_cols])
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in others]), ordk).alias("_last"))
    return agg.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])
