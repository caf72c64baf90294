"""Operator 4: fixity audit of WARC replicas by Merkle trees.

``write_warc`` lays pages out as WARC response records: sorted, range-partitioned, one archive
per partition, every record at its byte offset. ``tree`` hashes a replica (SHA-256): a leaf is
a record with its offset and length; leaves are grouped by the range of ``RANGE`` bytes their
offset lies in, sixteen ranges make one of the next level, up to one node per archive, and
archives are grouped the same way up to the root. ``audit`` compares the roots of two
replicas and goes down only into nodes that differ (a semi join on the parents found to
differ), to the records at fault: ``changed``, ``missing`` (only in the first replica) or
``added`` (only in the second). As ranges are byte ranges and not positions in a list, a
missing record makes only its own range differ.

Hashing is native SQL; a node gathers at most the records that start in one range, or
sixteen children. Each level is written once; nothing is collected.

Defined cases: null url or html is written as an empty one; repeated pages are records of
their own, each at its offset; records that a replica holds twice at one offset are hashed
together in order of their hashes, and are ``changed`` if the other holds one; an empty
replica makes every record of the other missing or added; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parallelism, read, scratch_path, staged

RANGE = 1 << 16
FANOUT_BITS = 4
ARCHIVE = "archive int, offset bigint, length bigint, page_id bigint, record binary"


def records(pages: DataFrame) -> DataFrame:
    """``page_id, record``: each page as the bytes of a WARC response record."""
    url, html = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    h = F.md5(F.concat_ws("\0", F.col("page_id").cast("string"), url))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"),
        uuid,
        F.lit(">\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.concat(head, html, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def _lay_out(batches):
    from pyspark import TaskContext

    archive, end = TaskContext.get().partitionId(), 0
    for b in batches:
        record = b.column("record")
        length = pc.binary_length(record).to_numpy(zero_copy_only=False).astype(np.int64)
        offset = end + np.cumsum(length) - length
        end += int(length.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, archive, np.int32)), pa.array(offset), pa.array(length), b.column("page_id"), record], names=["archive", "offset", "length", "page_id", "record"])


def write_warc(pages: DataFrame, path: str, archives: int | None = None) -> DataFrame:
    """Write the archives (rows of ``ARCHIVE``) and read them back.

    The row number of the scan is the last sort key, so that pages repeated very often
    spread over archives like others.
    """
    spark = pages.sparkSession
    rows = records(pages).withColumn("n", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(archives or parallelism(spark), F.col("page_id"), F.col("n")).sortWithinPartitions("page_id", "n").drop("n")
    rows.mapInArrow(_lay_out, ARCHIVE).write.parquet(path)
    return spark.read.schema(ARCHIVE).parquet(path)


def leaves(replica: DataFrame) -> DataFrame:
    """``archive, offset, hash`` and what names the record."""
    place = F.concat_ws(":", F.col("archive"), F.col("offset"), F.col("length")).cast("binary")
    hashed = F.sha2(F.concat(F.lit("0").cast("binary"), place, F.col("record")), 256)
    return replica.select("archive", "offset", "length", "page_id", hashed.alias("hash"))


def _parents(level: DataFrame, archive, node) -> DataFrame:
    """One level up: the hash of the children's places and hashes, in order."""
    kids = F.sort_array(F.collect_list(F.struct(F.col("node"), F.col("hash"))))
    body = F.concat(F.lit("1"), F.array_join(F.transform(kids, lambda c: F.concat_ws(":", c["node"], c["hash"])), ","))
    return level.groupBy("replica", archive.alias("archive"), node.alias("up")).agg(F.sha2(body, 256).alias("hash")).withColumnRenamed("up", "node")


def tree(replica_leaves: DataFrame, range_bytes: int = RANGE) -> tuple[list[DataFrame], int]:
    """Levels from the leaves up: ``replica, archive, node, hash``; written one by one.

    Also how many of them, the last ones, are groups of archives.

    ``replica_leaves`` holds ``replica, archive, offset, hash``. Levels of byte ranges end when
    each archive is one node; levels of archives end with one root per replica.
    """
    low = replica_leaves.select("replica", "archive", F.col("offset").alias("node"), "hash")
    level = staged(_parents(low, F.col("archive"), F.floor(F.col("node") / range_bytes)), "merkle")
    out = [level]
    while (level.agg(F.max("node")).first()[0] or 0) > 0:
        level = staged(_parents(level, F.col("archive"), F.shiftright("node", FANOUT_BITS)), "merkle")
        out.append(level)
    # archives: the node of an archive is its number from here on
    ranges = len(out)
    level = level.select("replica", F.lit(0).alias("archive"), F.col("archive").cast("long").alias("node"), "hash")
    while True:
        level = staged(_parents(level, F.lit(0), F.shiftright("node", FANOUT_BITS)), "merkle")
        out.append(level)
        if (level.agg(F.max("node")).first()[0] or 0) == 0:
            return out, len(out) - ranges


def _differ(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of nodes that are not the same in both replicas."""
    return nodes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("replica", "hash"))).alias("both")).where(
        (F.size("both") != 2) | (F.col("both")[0]["replica"] == F.col("both")[1]["replica"]) | (F.col("both")[0]["hash"] != F.col("both")[1]["hash"])
    ).select(*keys)


def audit(first: DataFrame, second: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """``archive, offset, page_id, length, status, first_hash, second_hash`` of records that differ."""
    every = staged(leaves(first).withColumn("replica", F.lit(0)).unionByName(leaves(second).withColumn("replica", F.lit(1))), "merkle-leaves")
    levels, n_up = tree(every, range_bytes)
    bad = _differ(levels[-1], ["archive", "node"])  # the roots
    for i in range(len(levels) - 2, -1, -1):
        here = levels[i]
        if i == len(levels) - 1 - n_up:  # from groups of archives to the archives' own nodes
            parents = bad.select(F.col("node").alias("up"))
            some = here.join(parents, F.shiftright(F.col("archive").cast("long"), FANOUT_BITS) == F.col("up"), "left_semi")
        else:
            parents = bad.select(F.col("archive").alias("a"), F.col("node").alias("up"))
            some = here.join(parents, (here["archive"] == F.col("a")) & (F.shiftright(here["node"], FANOUT_BITS) == F.col("up")), "left_semi")
        bad = _differ(some, ["archive", "node"])
    ranges = bad.select(F.col("archive").alias("a"), F.col("node").alias("up"))
    suspects = every.join(ranges, (every["archive"] == F.col("a")) & (F.floor(every["offset"] / range_bytes) == F.col("up")), "left_semi")

    def side(i):
        x = suspects.where(F.col("replica") == i).groupBy("archive", "offset")
        return x.agg(F.min("page_id").alias(f"p{i}"), F.max("length").alias(f"l{i}"), F.array_join(F.sort_array(F.collect_list("hash")), ",").alias(f"h{i}"))

    both = side(0).join(side(1), ["archive", "offset"], "full_outer").where(~F.col("h0").eqNullSafe(F.col("h1")))
    status = F.when(F.col("h1").isNull(), "missing").when(F.col("h0").isNull(), "added").otherwise("changed")
    return both.select(
        "archive",
        "offset",
        F.when(F.col("h0").isNull(), F.col("p1")).otherwise(F.col("p0")).alias("page_id"),
        F.coalesce("l0", "l1").alias("length"),
        status.alias("status"),
        F.col("h0").alias("first_hash"),
        F.col("h1").alias("second_hash"),
    )


def damaged(archive: DataFrame) -> DataFrame:
    """A replica as a failing store would leave it: every 97th page altered, every 101st lost.

    A stated rule on the whole table, so that the records at fault are known.
    """
    n = F.octet_length("record")
    flipped = F.concat(F.expr("substring(record, 1, octet_length(record) - 5)"), F.lit("#").cast("binary"), F.expr("substring(record, octet_length(record) - 3, 4)"))
    bad = F.coalesce(F.col("page_id") % 97 == 3, F.lit(False)) & (n > 5)
    return archive.where(~F.coalesce(F.col("page_id") % 101 == 5, F.lit(False))).withColumn("record", F.when(bad, flipped).otherwise(F.col("record")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_warc(read(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return audit(archive, damaged(archive)).select("page_id", "length", "status")


ORACLE = """
SELECT page_id, CAST(length AS BIGINT) AS length, status FROM (
  SELECT page_id,
    octet_length(encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'))
    + 36 + octet_length(encode('>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html'
      || chr(13) || chr(10) || 'Content-Length: ' || CAST(octet_length(encode(html)) AS VARCHAR)))
    + 4 + octet_length(encode(html)) + 4 AS length,
    CASE WHEN page_id % 101 = 5 THEN 'missing' WHEN page_id % 97 = 3 THEN 'changed' END AS status
  FROM pages
) WHERE status IS NOT NULL
"""
