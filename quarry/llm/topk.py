"""Operator 3: exact top-k search by distributed histogram selection.

Every query is scored against every candidate; nothing is pruned. Instead of sorting the
scores, the value of the k-th best one is located with histograms:

* a pass scores all rows (a block of queries times a batch of vectors, one matrix product)
  and counts, per query, how many scores fall into each of ``BINS`` equal parts of the
  query's present interval; each task sends one count per (query, part) it met,
* the interval shrinks to the part that holds the k-th score, until no more than
  ``KEEP`` rows per query reach its lower end, or the interval is one integer wide,
* if more rows than that share the k-th score, the same selection goes on over ``vec_id``
  (smaller first) among the rows of that score,
* a last pass emits exactly the rows at or above the found (score, vec_id) bound, and one
  window over all blocks ranks them by query id.

Queries go through the driver in blocks of ``BLOCK`` rows, one block at a time, so what is
sent to executors has a fixed bound (``BLOCK`` x dimension numbers). Scores are integers:
products are made in double precision while they are exact there (below 2^53), otherwise
in Python integers (object arrays).

Defined cases: vectors that are null, hold a null or non-finite component take no part, as
query or as candidate; vectors of another length than the query's are no candidates of it;
with fewer than k candidates all are returned; ties go to the smaller ``vec_id``; repeated
rows (same ``vec_id`` twice) are separate candidates except that a query never meets rows with
its own ``vec_id``; all distinct vectors of a query id ask and their candidates are ranked
together (one found by two of them counts twice), exact copies of a query row ask once; empty tables
give an empty result; rows with null ``vec_id`` take no part; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

BLOCK = 1_024
BINS = 256
KEEP = 64
EXACT = 2.0**53


def usable(vec):
    """True for a vector without null, NaN or infinite components (an empty one included)."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False))


def quantised(df: DataFrame, scale: int = 1024, vec: str = "embedding") -> DataFrame:
    """``vec_id, v``: each component x becomes floor(scale * x), x as double."""
    v = F.transform(F.col(vec).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return df.where(usable(F.col(vec).cast("array<double>")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _scores(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    if not q.size or not m.size:
        return np.zeros((len(q), len(m)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(m).max()) * q.shape[1] < EXACT:
        return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    return q.astype(object) @ m.astype(object).T


def _batches(frames, ids, vecs, rows: int = 2_048):
    """(query ids x candidate ids) score blocks: yields (scores, candidate ids)."""
    width = vecs.shape[1]
    for pdf in frames:
        right = pdf["v"].map(len).to_numpy() == width
        cand, mats = pdf["vec_id"].to_numpy(np.int64)[right], pdf["v"][right].to_list()
        for a in range(0, len(mats), rows):
            m = np.array(mats[a : a + rows], dtype=np.int64).reshape(len(mats[a : a + rows]), width)
            yield _scores(vecs, m), cand[a : a + rows]


def _histogram(ids, vecs, lo, hi, bound, on_id):
    """Counts per (query, part) of the open intervals; ``on_id``: parts of vec_id at score ``bound``."""

    def count(frames):
        total = np.zeros((len(ids), BINS), np.int64)
        step = [max(1, -(-(h - l) // BINS)) for l, h in zip(lo, hi)]
        for s, cand in _batches(frames, ids, vecs):
            for i in range(len(ids)):
                x, own = s[i], cand != ids[i]
                x = cand[own & (x == bound[i])] if on_id[i] else x[own]
                x = x[(x >= lo[i]) & (x < hi[i])]
                if len(x):
                    total[i] += np.bincount(((x - lo[i]) // step[i]).astype(np.int64), minlength=BINS)
        at = np.nonzero(total)
        yield pd.DataFrame({"i": at[0].astype(np.int32), "part": at[1].astype(np.int32), "n": total[at]})

    return count


def _emit(ids, vecs, bound, id_bound):
    def emit(frames):
        for s, cand in _batches(frames, ids, vecs):
            for i in range(len(ids)):
                x = s[i]
                hit = (cand != ids[i]) & ((x > bound[i]) | ((x == bound[i]) & (cand <= id_bound[i])))
                if hit.any():
                    yield pd.DataFrame({"query_id": ids[i], "vec_id": cand[hit], "score": x[hit].astype(np.int64)})

    return emit


def _block(base: DataFrame, ids: list[int], vecs: np.ndarray, k: int, low_id: int, high_id: int) -> DataFrame:
    """At least the k best of every query of one block (all of one length), not ranked."""
    n = len(ids)
    top = base.where(F.size("v") == vecs.shape[1]).agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0
    reach = [int(np.abs(v.astype(object)).sum()) * int(top) + 1 if v.size else 1 for v in vecs]
    lo, hi = [-r for r in reach], [r + 1 for r in reach]
    bound, id_bound, on_id = [0] * n, [high_id] * n, [False] * n
    above = [0] * n  # rows surely among the k
    open_ = list(range(n))
    while open_:
        sub = np.array(open_)
        hist = np.zeros((len(open_), BINS), np.int64)
        args = [[x[i] for i in open_] for x in (ids, lo, hi, bound, on_id)]
        counted = base.mapInPandas(_histogram(args[0], vecs[sub], args[1], args[2], args[3], args[4]), "i int, part int, n bigint")
        seen = counted.groupBy("i", "part").agg(F.sum("n").alias("n")).toArrow()  # at most BLOCK x BINS rows
        hist[seen["i"].to_numpy(), seen["part"].to_numpy()] = seen["n"].to_numpy()
        still = []
        for row, i in zip(hist, open_):
            step, need = max(1, -(-(hi[i] - lo[i]) // BINS)), k - above[i]
            if row.sum() <= need and not on_id[i]:  # all that is there
                bound[i], id_bound[i] = lo[i], high_id
                continue
            run = np.cumsum(row if on_id[i] else row[::-1])
            p = int(np.searchsorted(run, need))
            p = min(p, BINS - 1)
            inside = int(run[p])
            if on_id[i]:
                new_lo, new_hi = lo[i] + p * step, min(hi[i], lo[i] + (p + 1) * step)
                if inside <= need or new_hi - new_lo == 1 or inside <= KEEP:
                    id_bound[i] = new_hi - 1
                    continue
                above[i] += inside - int(row[p])
                lo[i], hi[i] = new_lo, new_hi
                still.append(i)
                continue
            part = BINS - 1 - p
            new_lo, new_hi = lo[i] + part * step, min(hi[i], lo[i] + (part + 1) * step)
            if above[i] + inside <= max(KEEP, k):
                bound[i] = new_lo
                continue
            above[i] += inside - int(row[part])
            lo[i], hi[i] = new_lo, new_hi
            if new_hi - new_lo == 1:  # many rows share the k-th score: go on over their ids
                bound[i], on_id[i] = new_lo, True
                lo[i], hi[i] = low_id, high_id + 1
            still.append(i)
        open_ = still
    # rows above the bound all count; of the bound's own score those up to the id bound
    return base.mapInPandas(_emit(ids, vecs, bound, id_bound), "query_id bigint, vec_id bigint, score bigint")


def topk(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``base``/``queries``: ``vec_id, v`` (integers) -> ``query_id, rank, vec_id, score``."""
    spark = base.sparkSession
    ends = base.agg(F.min("vec_id"), F.max("vec_id")).first()
    result = None
    if ends[0] is not None:
        block: dict[int, list] = {}
        done = []

        def run(rows):
            return _block(base, [r.vec_id for r in rows], np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), -1), k, ends[0], ends[1])

        rows = queries.select("vec_id", "v").distinct()
        for r in rows.toLocalIterator():
            same = block.setdefault(len(r.v), [])
            same.append(r)
            if len(same) == BLOCK:
                done.append(run(same))
                block[len(r.v)] = []
        done += [run(rows) for rows in block.values() if rows]
        for d in done:
            result = d if result is None else result.unionByName(d)
    if result is None:
        result = spark.createDataFrame([], "query_id long, vec_id long, score long")
    # the vectors of one query id may stand in several blocks
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    result = result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return result.select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = quantised(read(spark, sf_dir, "embeddings"))
    return topk(base, base.where(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH e AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.w, d.w) AS BIGINT) AS score
  FROM e q JOIN e d ON len(q.w) = len(d.w) AND q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
