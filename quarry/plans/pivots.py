"""Exact search that skips what can't matter (V1): vectors stored by pivot and distance.

``write_pivots`` gives every vector the nearest of a few pivots (its cell) and the distance to it, and
stores the table sorted by both in small row groups. ``pivot_topk`` answers as ``search.vector_topk``
with L2 does, in two scans per block of queries:

1. a look around each query's own place gives an upper bound of its k-th distance, ``r``;
2. by the triangle inequality an answer ``v`` of cell ``c`` lies within ``r`` of the query's own
   distance to the pivot of ``c``, and in no cell whose border is farther than ``r``. These ranges
   reach the Parquet scan as filters on ``(cell, dist)``, so row groups outside are never read.

The ranges only leave out vectors that are farther than the k-th for sure, so the rows are those of
``vector_topk`` on any data; how much is skipped depends on how the vectors cluster
(``skipped_share``). Where nothing can be skipped a search costs one look more.

Pivots come from a bounded seeded look at the table (``LOOK`` rows) and decide the speed only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.vectors import is_valid_vector
from ..operators import search
from ..session import scratch_path

PIVOTS = 32
LOOK = 4096
#: slices of equal row counts that a cell's distances are described by
SLICES = 64
#: intervals of distances kept per cell; beyond, the smallest gaps are closed
INTERVALS = 8
ROW_GROUP_BYTES = 4 << 20

Ranges = dict[int, list[tuple[float, float]]]


def _choose(vectors: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those before it."""
    chosen = [0]
    near = ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(chosen) < pivots and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
    return vectors[chosen]


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((vectors - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def write_pivots(corpus: DataFrame, root: str, *, id_col: str, vec_col: str, dim: int, pivots: int = PIVOTS) -> None:
    """Store ``(id, vector, cell, dist)`` of the usable vectors, with the pivots and the spread of each cell.

    Vectors that are null, of another length or hold a null, NaN or infinity are left out, as in a search.
    """
    spark = corpus.sparkSession
    good = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(is_valid_vector("vec", dim))
    good = good.where(~F.exists("vec", lambda x: F.abs(x) == float("inf")))
    look = good.orderBy(F.xxhash64("id"), "id").limit(LOOK).select("vec").toArrow()
    P = _choose(search._matrix(look.column("vec"), look.num_rows, dim), pivots) if look.num_rows else np.zeros((0, dim))
    spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(P)], "cell int, vec array<double>").coalesce(1).write.parquet(f"{root}/pivots")

    def place(batches):
        for b in batches:
            if b.num_rows:
                D = _distances(search._matrix(b.column("vec"), b.num_rows, dim), P)
                cell = D.argmin(axis=1)
                cols = [b.column("id"), b.column("vec"), pa.array(cell, pa.int32()), pa.array(D[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "vec", "cell", "dist"])

    schema = T.StructType([*good.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType())])
    rows = good.mapInArrow(place, schema) if len(P) else spark.createDataFrame([], schema)
    rows = rows.repartitionByRange("cell", "dist").sortWithinPartitions("cell", "dist")
    rows.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{root}/rows")
    marks = [i / SLICES for i in range(SLICES + 1)]
    spread = spark.read.schema(schema).parquet(f"{root}/rows").groupBy("cell")
    spread = spread.agg(F.count("dist").alias("rows"), F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.percentile_approx("dist", marks).alias("marks"))
    spread.coalesce(1).write.parquet(f"{root}/cells")


def _inside(ranges: Ranges) -> Column:
    """Rows of the ranges, as a filter that Parquet's row-group statistics can answer."""
    out = F.lit(False)
    for cell, spans in ranges.items():
        for lo, hi in spans:
            out = out | ((F.col("cell") == cell) & (F.col("dist") >= lo) & (F.col("dist") <= hi))
    return out


def _union(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The spans put together, as at most ``INTERVALS`` that cover them."""
    out: list[list[float]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    while len(out) > INTERVALS:
        i = min(range(len(out) - 1), key=lambda i: out[i + 1][0] - out[i][1])
        out[i : i + 2] = [[out[i][0], out[i + 1][1]]]
    return [(lo, hi) for lo, hi in out]


def _first_look(D: np.ndarray, cells: list, k: int) -> Ranges:
    """Around each query's distance in its nearest cell: the slices that hold some four k rows."""
    spans: dict[int, list] = {}
    by_no = {c["cell"]: c for c in cells}
    nos = np.array(sorted(by_no))
    for d in D:
        no = int(nos[d[nos].argmin()])
        c = by_no[no]
        marks = [c["lo"], *c["marks"][1:-1], c["hi"]]
        wide = max(1, -(-4 * k * SLICES // c["rows"]))
        at = int(np.searchsorted(marks, d[no]))
        spans.setdefault(no, []).append((marks[max(0, min(at, SLICES) - wide)], marks[min(SLICES, at + wide)]))
    return {no: _union(s) for no, s in spans.items()}


def _needed(D: np.ndarray, r: np.ndarray, cells: list) -> Ranges:
    """Where the answers of queries at distances ``D`` to the pivots, within ``r``, can lie."""
    # nearness is compared with squared distances rounded to KEY_DECIMALS; and sums have rounding errors
    r = np.sqrt(r * r + 2 * 10.0**-search.KEY_DECIMALS)
    r = r + 1e-9 * (1 + r + D.max(axis=1, initial=0.0))
    home = D.min(axis=1)
    out = {}
    for c in cells:
        d = D[:, c["cell"]]
        ask = ((d - home) / 2 <= r) & (d - r <= c["hi"]) & (d + r >= c["lo"])
        spans = [(max(c["lo"], a), min(c["hi"], b)) for a, b in zip((d - r)[ask].tolist(), (d + r)[ask].tolist())]
        if spans:
            out[c["cell"]] = _union(spans)
    return out


def pivot_topk(
    spark: SparkSession, root: str, queries: DataFrame, *, query_id: str = "query_id", query_vec: str = "query_vec", k: int = K.TOP_K,
    max_block_bytes: int = 16 << 20, chunk_cells: int = 4_000_000, note: list | None = None,
) -> DataFrame:
    """The exact L2 top-k of ``search.vector_topk``: ``query_id, id, dist, rank``, ties to the smaller id.

    Each block of queries is answered here and written to the shared folder. ``note`` takes the ranges
    that each block's second scan had (for ``skipped_share``).
    """
    rows = spark.read.parquet(f"{root}/rows")
    P = np.array([p["vec"] for p in spark.read.parquet(f"{root}/pivots").orderBy("cell").collect()])
    cells = spark.read.parquet(f"{root}/cells").collect()
    qid_type = queries.schema[query_id].dataType
    schema = T.StructType([T.StructField(query_id, qid_type), rows.schema["id"], T.StructField("dist", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("_key").desc(), F.col("id").asc()))

    def best(part: DataFrame, block) -> DataFrame:
        found, _ = search._block_candidates(
            part, block, id_col="id", vec_col="vec", qid_name=query_id, qid_type=qid_type, group_col=None, k=k, metric="l2", chunk_cells=chunk_cells
        )
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select(query_id, "id", F.col("score").alias("dist"), "rank")

    path = scratch_path(spark, "pivot-topk")
    spark.createDataFrame([], schema).write.parquet(path)
    blocks = search.query_blocks(queries, query_id, query_vec, P.shape[1], max_block_bytes) if cells else []
    for block, _ in blocks:
        qids, Q, _ = block
        fine = np.isfinite(Q).all(axis=1)
        block = (qids[fine], Q[fine], block[2])
        if not fine.any():
            continue
        D = _distances(block[1], P)
        near = best(rows.where(_inside(_first_look(D, cells, k))), block).groupBy(query_id).agg(F.count("id").alias("n"), F.max("dist").alias("far"))
        bound = {x[query_id]: x["far"] for x in near.where(F.col("n") >= k).collect()}  # a block's queries, bounded
        r = np.array([bound.get(q, np.inf) for q in block[0].tolist()])
        ranges = _needed(D, r, cells)
        if note is not None:
            note.append(ranges)
        best(rows.where(_inside(ranges)), block).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def skipped_share(spark: SparkSession, root: str, ranges: Ranges) -> float:
    """The share of the stored vectors that a scan with these ranges leaves out."""
    rows = spark.read.parquet(f"{root}/rows")
    total, kept = rows.agg(F.count("cell"), F.count_if(_inside(ranges))).first()
    return 1 - kept / total if total else 0.0
