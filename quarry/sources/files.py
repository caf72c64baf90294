"""File-tree sources (S1-S7, S17): list, filter, tag and read source files.

The listing is Spark's ``binaryFile`` source with recursive lookup; the extension
filter is handed to the listing as ``pathGlobFilter`` and the directory deny list
is a predicate on the scan's file metadata: files in denied folders are not opened.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K


def _qualified(spark: SparkSession, root: str):
    """The root as the file system names it, however it was written (``./x``, ``x``, ``/a/x/``)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)


def _below(path: Column, root: str) -> Column:
    """The part of ``path`` below ``root`` (both fully qualified)."""
    root = re.sub("^file:/+", "file:/", root.rstrip("/")) + "/"
    path = F.regexp_replace(path, "^file:/+", "file:/")  # the two forms of a local URI
    return F.when(path.startswith(root), path.substr(F.lit(len(root) + 1), F.length(path))).otherwise(path)


def dir_segments(rel_path) -> Column:
    """Directory names below the root (the file name removed)."""
    parts = F.split(rel_path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def file_name(rel_path) -> Column:
    return F.element_at(F.split(rel_path, "/"), -1)


def extension(name) -> Column:
    """Last suffix incl. the dot; a name like ``.py`` (dot first) has none."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def not_in_denied_dir(rel_path, deny_dirs=K.DENY_DIRS) -> Column:
    return ~F.arrays_overlap(dir_segments(rel_path), F.array(*[F.lit(d) for d in deny_dirs]))


def language_of(ext) -> Column:
    """Extension → language via a fixed literal map (no join needed)."""
    m = F.create_map(*[x for kv in K.EXTENSION_LANGUAGE.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.element_at(m, ext)


def decode_text(content) -> Column:
    """Bytes → text with universal newlines (``\\r\\n`` and ``\\r`` → ``\\n``)."""
    return F.regexp_replace(F.regexp_replace(content.cast("string"), "\r\n", "\n"), "\r", "\n")


def list_files(spark: SparkSession, root: str, glob: str | None = None, deny_dirs=()) -> DataFrame:
    """Files below ``root`` with ``rel_path``. The deny list is a predicate on the scan's file
    metadata, so files in denied folders are dropped from the listing and never opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root)
    root_path = _qualified(spark, root)
    if deny_dirs:
        df = df.where(not_in_denied_dir(_below(F.col("_metadata.file_path"), root_path.toUri().toString()), deny_dirs))
    return df.withColumn("rel_path", _below(F.col("path"), root_path.toString()))


def tag_files(paths: DataFrame, *, path_col: str = "rel_path", deny_dirs=K.DENY_DIRS, extensions=K.ALLOWED_EXTENSIONS, deny_files=K.DENY_FILES) -> DataFrame:
    """S1-S4 on any table of relative paths: prune, filter by extension, tag language."""
    p = F.col(path_col)
    out = paths.withColumn("file_name", file_name(p)).withColumn("extension", extension(F.col("file_name")))
    out = out.where(not_in_denied_dir(p, deny_dirs))
    out = out.where(F.col("extension").isin(*extensions) & ~F.col("file_name").isin(*deny_files))
    return out.withColumn("language", language_of(F.col("extension")))


def scan_files(spark: SparkSession, root: str, *, deny_dirs=K.DENY_DIRS, extensions=K.ALLOWED_EXTENSIONS, deny_files=K.DENY_FILES) -> DataFrame:
    """``(file_path, language, content, valid_utf8)`` for every kept source file.

    Rows with invalid UTF-8 are kept and flagged (``valid_utf8 = false``) so the
    caller can quarantine them instead of failing the whole run.
    """
    glob = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"
    files = tag_files(list_files(spark, root, glob, deny_dirs), deny_dirs=deny_dirs, extensions=extensions, deny_files=deny_files)
    files = files.where(F.col("language").isNotNull())
    text = decode_text(F.col("content"))
    return files.select(
        F.col("path").alias("file_path"),
        "rel_path",
        "language",
        text.alias("content"),
        F.is_valid_utf8(F.col("content").cast("string")).alias("valid_utf8"),
    )


def unsupported_files(spark: SparkSession, root: str, extensions=K.ALLOWED_EXTENSIONS) -> DataFrame:
    """S4 report: allowed extension but no language mapping (rows the scan skips)."""
    files = tag_files(list_files(spark, root, deny_dirs=K.DENY_DIRS).drop("content"), extensions=extensions)
    return files.where(F.col("language").isNull()).select("path", "extension")


def scan_special_files(spark: SparkSession, root: str, *, suffixes=K.SPECIAL_SUFFIXES, prune_dirs: bool = False) -> DataFrame:
    """``.md`` / ``.sh`` files with their text. No directory pruning by default."""
    df = list_files(spark, root, "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}", K.DENY_DIRS if prune_dirs else ())
    cond = F.lit(False)
    for s in suffixes:
        cond = cond | F.col("rel_path").endswith(s)
    return df.where(cond).select(
        F.col("path").alias("file_path"),
        decode_text(F.col("content")).alias("content"),
        F.is_valid_utf8(F.col("content").cast("string")).alias("valid_utf8"),
    )


def corpus_name(path_col_or_str) -> Column:
    """Last path segment of the corpus root — used as the table prefix."""
    c = F.lit(path_col_or_str) if isinstance(path_col_or_str, str) else path_col_or_str
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)
