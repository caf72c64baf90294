"""Exact nearest-neighbour search (V1-V5, V9, A3, A10).

Plan shape, whatever the corpus size:

1. The query vectors are split into blocks whose size is checked against
   ``max_block_bytes``; one block at a time is collected and broadcast. The corpus is
   never broadcast and never shuffled.
2. The corpus streams through ``mapInArrow``: every Arrow batch is turned into a
   matrix, multiplied against the query block, and merged into the task's running
   *exact* top-k (ties broken by id), which is emitted once: ids, scores and keys, no
   payload. Cosines are multiplied in single precision once every query has k rows, and
   the cells that may reach a k-th key (error bound included) are scored in double.
3. ``row_number() over (partition by query[, group] order by key desc, id)`` keeps
   the global top-k. Catalyst plans a partial ``WindowGroupLimit`` before the
   shuffle, so only k rows per query per partition cross the network.
4. Payload columns are joined to the final rows by id.

Ranking key: the score rounded to 9 decimals (so that float noise cannot reorder
true ties), then the corpus id ascending. L2 distances of the best rows are computed from
the differences themselves, as |d|^2 + |q|^2 - 2dq loses them for long vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.vectors import is_valid_vector
from ..session import SENT_IDS, scratch_path, written

METRICS = ("l2", "cosine", "dot")
KEY_DECIMALS = 9
#: rows of one slice at most where single cells are scored, and cells scored at a time
SLICE_ROWS, CELL_STEP = 1024, 8192


def _matrix(col: pa.Array, n: int, dim: int) -> np.ndarray:
    """Dense ``(n, dim)`` float64 matrix from a list column or a sparse struct<idx, val>."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_struct(col.type):
        idx, val = col.field("idx"), col.field("val")
        lens = pc.fill_null(pc.list_value_length(idx), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        D = np.zeros((n, dim), dtype=np.float64)
        rows = np.repeat(np.arange(n, dtype=np.int64), lens)
        D[rows, pc.list_flatten(idx).to_numpy(zero_copy_only=False)] = pc.list_flatten(val).to_numpy(zero_copy_only=False)
        return D
    flat = pc.list_flatten(col)
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, dim)


def _valid_rows(col: pa.Array, dim: int) -> np.ndarray:
    """Rows whose vector is usable: dense of length ``dim``, or sparse with matching
    index/value lengths and indices inside ``[0, dim)``."""
    if pa.types.is_struct(col.type):
        idx, val = col.field("idx"), col.field("val")
        li = pc.fill_null(pc.list_value_length(idx), -1).to_numpy(zero_copy_only=False)
        lv = pc.fill_null(pc.list_value_length(val), -2).to_numpy(zero_copy_only=False)
        ok = (li == lv) & (li >= 0) & ~col.is_null().to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(idx).to_numpy(zero_copy_only=False)
        if len(flat) and (flat.min() < 0 or flat.max() >= dim):
            bad = np.repeat(np.arange(len(col)), np.maximum(li, 0))[(flat < 0) | (flat >= dim)]
            ok[bad] = False
        return ok
    lens = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    return lens == dim


def _keys(S: np.ndarray, metric: str) -> np.ndarray:
    """Ranking keys of scores (for l2: of squared distances); larger is nearer."""
    return -np.round(S, KEY_DECIMALS) if metric == "l2" else np.round(S, KEY_DECIMALS)


def _scores(D: np.ndarray, Q: np.ndarray, qsq: np.ndarray, metric: str) -> np.ndarray:
    """Score matrix (nd, nq); for l2 the squared distance up to rounding."""
    G = D @ Q.T
    if metric == "dot":
        return G
    dsq = np.einsum("ij,ij->i", D, D)
    if metric == "cosine":
        dn, qn = np.sqrt(dsq), np.sqrt(qsq)
        G /= np.where(dn > 0, dn, 1.0)[:, None]
        G /= np.where(qn > 0, qn, 1.0)[None, :]
        return G
    return np.maximum(dsq[:, None] + qsq[None, :] - 2.0 * G, 0.0)


def _true_l2(D: np.ndarray, Q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances of ``rows[:, j]`` to query j from the differences (16 MB at a time)."""
    out = np.empty(rows.shape)
    step = max(1, (2 << 20) // max(1, rows.shape[0] * Q.shape[1]))
    for a in range(0, rows.shape[1], step):
        diff = D[rows[:, a : a + step]] - Q[None, a : a + step]
        out[:, a : a + step] = np.einsum("ijk,ijk->ij", diff, diff)
    return out


def _best(D: np.ndarray, Q: np.ndarray, qsq: np.ndarray, ids: np.ndarray, metric: str, k: int):
    """(ids, scores, keys), each (k, nq): the best rows of one matrix for every query."""
    S = _scores(D, Q, qsq, metric)
    if metric != "l2":
        sel = _topk_rows(_keys(S, metric), ids, k)
        S = np.take_along_axis(S, sel, axis=0)
        return ids[sel], S, _keys(S, metric)
    n, nq = S.shape
    wide = min(n, k + 32)
    rows = np.argpartition(S, wide - 1, axis=0)[:wide] if wide < n else np.repeat(np.arange(n)[:, None], nq, axis=1)
    true = _true_l2(D, Q, rows)
    if wide < n:
        # rows left out are farther than the k-th for sure unless rounding could hide it
        slack = 8 * np.finfo(float).eps * D.shape[1] * (np.einsum("ij,ij->i", D, D).max() + qsq)
        edge = np.take_along_axis(S, rows, axis=0).max(axis=0) - slack
        unsure = np.nonzero(np.partition(true, k - 1, axis=0)[k - 1] >= edge)[0]
        sel = _topk_rows_2d(_keys(true, metric), ids[rows], k)
        out_rows, out_true = np.take_along_axis(rows, sel, axis=0), np.take_along_axis(true, sel, axis=0)
        for j in unsure:
            full = np.einsum("ij,ij->i", D - Q[j], D - Q[j])
            top = _topk_rows(_keys(full, metric)[:, None], ids, k)[:, 0]
            out_rows[:, j], out_true[:, j] = top, full[top]
    else:
        sel = _topk_rows_2d(_keys(true, metric), ids[rows], k)
        out_rows, out_true = np.take_along_axis(rows, sel, axis=0), np.take_along_axis(true, sel, axis=0)
    return ids[out_rows], out_true, _keys(out_true, metric)


def _topk_rows_2d(key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row indices of the best k per column by (key desc, id asc); ids per cell."""
    by_id = np.argsort(ids, axis=0, kind="stable")
    order = np.argsort(-np.take_along_axis(key, by_id, axis=0), axis=0, kind="stable")[:k]
    return np.take_along_axis(by_id, order, axis=0)


def _topk_rows(key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row indices (k_eff, nq) of the exact top-k per column by (key desc, id asc)."""
    nd, nq = key.shape
    if nd <= k:
        return np.repeat(np.arange(nd)[:, None], nq, axis=1)
    part = np.argpartition(-key, k - 1, axis=0)[:k]
    kth = np.take_along_axis(key, part, axis=0).min(axis=0)
    counts = (key >= kth[None, :]).sum(axis=0)
    for j in np.nonzero(counts > k)[0]:
        cand = np.nonzero(key[:, j] >= kth[j])[0]
        by_id = cand[np.argsort(ids[cand], kind="stable")]
        order = np.argsort(-key[by_id, j], kind="stable")[:k]
        part[:, j] = by_id[order]
    return part


def merge_best(best, S: np.ndarray, ids: np.ndarray, k: int):
    """``best`` (ids, scores, keys; up to k rows per query) with the rows of one more score matrix.

    Once every query has k rows, only cells that reach its k-th key are looked at again.
    """
    if best is None or len(best[0]) < k:
        sel = _topk_rows(_keys(S, ""), ids, k)
        S = np.take_along_axis(S, sel, axis=0)
        found = ids[sel], S, _keys(S, "")
        if best is None:
            return found
        found = tuple(np.concatenate([x, y], axis=0) for x, y in zip(best, found))
        sel = _topk_rows_2d(found[2], found[0], k)
        return tuple(np.take_along_axis(x, sel, axis=0) for x in found)
    edge = _edge(best)
    row, col = np.nonzero(S >= edge[None, :])
    return _merge_cells(best, col, ids[row], S[row, col], k) if len(row) else best


def _edge(best) -> np.ndarray:
    """What a score must reach to change a query's best rows (-inf, the key of no hit, never comes in again)."""
    return np.maximum(best[2].min(axis=0) - 10.0**-KEY_DECIMALS, np.finfo(float).min)


def _merge_cells(best, col: np.ndarray, name: np.ndarray, score: np.ndarray, k: int):
    """``best``, k rows per query, with single cells: query, id and score of each."""
    some = np.unique(col)
    score = np.concatenate([best[1][:, some].T.ravel(), score])
    key = np.concatenate([best[2][:, some].T.ravel(), _keys(score[k * len(some) :], "")])
    of = np.concatenate([np.repeat(some, k), col])
    name = np.concatenate([best[0][:, some].T.ravel(), name])
    order = np.argsort(name, kind="stable")
    order = order[np.argsort(-key[order], kind="stable")]
    order = order[np.argsort(of[order], kind="stable")]
    first = np.searchsorted(of[order], some)  # every query has its k rows of before at least
    at = order[first[None, :] + np.arange(k)[:, None]]
    for x, y in zip(best, (name, score, key)):
        x[:, some] = y[at]
    return best


def _plain(norms: np.ndarray) -> bool:
    """Whether vectors of these lengths can be scaled to length 1 (zero vectors stay)."""
    return bool((np.isfinite(norms) & ((norms == 0) | (norms > 1e-100))).all())


def _unit32(X: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return np.divide(X, np.where(norms > 0, norms, 1.0)[:, None], out=np.empty(X.shape, np.float32), casting="unsafe")


def _near_cells(D: np.ndarray, dn: np.ndarray, Q: np.ndarray, qn: np.ndarray, Q32: np.ndarray, edge: np.ndarray, cells: int):
    """(rows, queries, scores) of the cosines that reach their query's ``edge``.

    Products of single precision, ``cells`` at a time, say which cells may reach it: they are off by
    less than the slack. Only those are scored, in double precision.
    """
    n, dim = D.shape
    D32 = _unit32(D, dn)
    dn, qn = np.where(dn > 0, dn, 1.0), np.where(qn > 0, qn, 1.0)
    lim = (edge - (dim + 8) * 2.0**-23).astype(np.float32)
    found = []
    step = max(1, cells // n)
    for a in range(0, len(Q32), step):
        S = D32 @ Q32[a : a + step].T
        hot = np.nonzero(S.max(axis=0) >= lim[a : a + step])[0]
        if not len(hot):
            continue
        row, at = np.nonzero(S[:, hot] >= lim[a + hot])
        col = a + hot[at]
        if len(row) * 16 > n * len(hot):  # ties nearly everywhere: one product costs less than single cells
            score = (D @ Q[a + hot].T)[row, at]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", D[row[i : i + CELL_STEP]], Q[col[i : i + CELL_STEP]]) for i in range(0, len(row), CELL_STEP)])
        score /= dn[row]
        score /= qn[col]
        keep = score >= edge[col]
        found.append((row[keep], col[keep], score[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def _collect_block(block: DataFrame, qid: str, qvec: str, dim: int | None):
    tbl = block.select(qid, qvec).toArrow()
    n = tbl.num_rows
    if n == 0:
        return None
    col = tbl.column(qvec).combine_chunks()
    if dim is None:
        dim = len(col[0].as_py())
    ok = _valid_rows(col, dim)
    Q = _matrix(col.filter(pa.array(ok)), int(ok.sum()), dim)
    return tbl.column(qid).to_numpy()[ok], Q, dim


def query_blocks(queries: DataFrame, qid: str, qvec: str, dim: int | None = None, max_block_bytes: int = 64 << 20):
    """Split the query side into blocks of at most ``max_block_bytes`` each.

    The size check uses the row count and the vector width; above the limit the
    queries are hashed into as many blocks as needed. Yields ``(block, blocks)``; each block is
    collected when it is asked for, so the driver holds one at a time.
    """
    queries = queries.where(F.col(qvec).isNotNull())
    if dim is not None and not isinstance(queries.schema[qvec].dataType, T.StructType):
        queries = queries.where(is_valid_vector(qvec, dim))
    # the query side is read several times (count, then each block): keep it cached, without its texts
    queries = queries.select(qid, qvec).persist()
    try:
        n = queries.count()
        if n == 0:
            return
        if dim is None:
            dim = queries.select(F.size(qvec).alias("d")).first()["d"]
            queries = queries.where(is_valid_vector(qvec, dim))
        nblocks = max(1, math.ceil(n * (dim * 8 + 64) / max_block_bytes))
        bucket = F.pmod(F.xxhash64(F.col(qid)), F.lit(nblocks))
        for b in range(nblocks):
            blk = _collect_block(queries if nblocks == 1 else queries.where(bucket == b), qid, qvec, dim)
            if blk:
                yield blk, nblocks
    finally:
        queries.unpersist()


def _block_candidates(corpus: DataFrame, block, *, id_col, vec_col, qid_name, qid_type, group_col, k, metric, chunk_cells):
    """One task's best rows for one block of queries: ``query, [group], id, score, _key``."""
    spark = corpus.sparkSession
    qids, Q, dim = block
    qsq = np.einsum("ij,ij->i", Q, Q)
    bc = spark.sparkContext.broadcast((qids, Q, qsq))
    keep = ([group_col] if group_col else []) + [id_col]
    # vectors are validated inside the Arrow batch (length, null, NaN), not with a
    # native filter: a filter on a UDF-produced column would be pushed below the
    # UDF's exchange and make Spark evaluate the UDF twice
    src = corpus.select(*keep, vec_col)
    fields = [T.StructField(qid_name, qid_type), *[src.schema[c] for c in keep], T.StructField("score", T.DoubleType()), T.StructField("_key", T.DoubleType())]
    out_schema = T.StructType(fields)

    def run(batches):
        qids_, Q_, qsq_ = bc.value
        nq, dim_ = Q_.shape
        # a batch is worked on in slices, so neither its matrix nor its scores grow with it
        rows_per_chunk = max(1, chunk_cells // max(nq, dim_))
        most = max(rows_per_chunk, min(SLICE_ROWS, chunk_cells // dim_))
        qn = np.sqrt(qsq_)
        Q32 = _unit32(Q_, qn) if metric == "cosine" and nq and _plain(qn) else None
        best: dict = {}  # group -> (ids, scores, keys), each (up to k, nq)

        def slices():
            rows = rows_per_chunk
            for b in batches:
                a = 0
                while a < b.num_rows:
                    yield b.slice(a, rows)
                    a += rows
                    if Q32 is not None and best:  # slices widen as the k-th keys rise
                        rows = min(most, 2 * rows)

        def cosines(g, D, ids):
            """One group's rows of a slice, into its best."""
            dn, a = np.sqrt(np.einsum("ij,ij->i", D, D)), 0
            fast = Q32 is not None and _plain(dn)
            while a < len(D):
                have = best.get(g)
                if fast and have is not None and len(have[0]) == k:
                    row, col, score = _near_cells(D[a:], dn[a:], Q_, qn, Q32, _edge(have), chunk_cells)
                    if len(row):
                        _merge_cells(have, col, ids[a:][row], score, k)
                    return
                z = a + rows_per_chunk
                best[g] = merge_best(have, _scores(D[a:z], Q_, qsq_, metric), ids[a:z], k)
                a = z

        for rb in slices():
            ok = _valid_rows(rb.column(vec_col), dim_)
            rb = rb.filter(pa.array(ok))
            n = rb.num_rows
            if n == 0:
                continue
            D = _matrix(rb.column(vec_col), n, dim_)
            ids = rb.column(id_col).to_numpy(zero_copy_only=False)
            finite = ~np.isnan(D).any(axis=1)
            groups = np.array(rb.column(group_col).to_pylist(), dtype=object) if group_col else np.zeros(n, dtype=object)
            for g in dict.fromkeys(groups[finite]):
                r = np.nonzero(finite & (groups == g))[0]
                if metric == "cosine":
                    cosines(g, D[r], ids[r])
                    continue
                if metric == "dot":
                    best[g] = merge_best(best.get(g), _scores(D[r], Q_, qsq_, metric), ids[r], k)
                    continue
                found = _best(D[r], Q_, qsq_, ids[r], metric, k)
                if g in best:
                    found = tuple(np.concatenate([x, y], axis=0) for x, y in zip(best[g], found))
                    sel = _topk_rows_2d(found[2], found[0], k)
                    found = tuple(np.take_along_axis(x, sel, axis=0) for x in found)
                best[g] = found
        for g, (ids, score, key) in best.items():
            score = np.sqrt(score) if metric == "l2" else score
            cols = [pa.array(np.repeat(qids_, len(ids)))]
            if group_col:
                cols.append(pa.array([g] * ids.size, type=_arrow_type(out_schema[group_col].dataType)))
            cols += [pa.array(ids.T.ravel()), pa.array(score.T.ravel()), pa.array(key.T.ravel())]
            cols = [c.cast(_arrow_type(f.dataType)) for c, f in zip(cols, out_schema.fields)]
            yield pa.RecordBatch.from_arrays(cols, names=out_schema.names)

    return src.mapInArrow(run, out_schema), bc


def _arrow_type(dt):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(dt)


def vector_topk(
    corpus: DataFrame,
    queries: DataFrame,
    *,
    id_col: str,
    vec_col: str,
    query_id: str = "query_id",
    query_vec: str = "query_vec",
    k: int = K.TOP_K,
    metric: str = "l2",
    carry: tuple | list = (),
    group_col: str | None = None,
    dim: int | None = None,
    max_block_bytes: int = 64 << 20,
    chunk_cells: int = 2_000_000,
    stored: bool = False,
) -> DataFrame:
    """Exact top-k corpus rows per query.

    ``stored`` says that the corpus is read from a table: the hits are written first, and where their
    distinct ids are no more than ``SENT_IDS``, only rows with one of them are shuffled for the payload.

    Output: ``query_id, [group_col], id_col, carry…, score|dist, rank`` with rank
    1..k; ``id_col`` (with the group) names a corpus row. For ``l2`` the distance column is ``dist`` (smaller is nearer); for
    ``cosine`` and ``dot`` it is ``score`` (larger is nearer).
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    qid_type = queries.schema[query_id].dataType
    spark = corpus.sparkSession
    groups = [group_col] if group_col else []
    w = Window.partitionBy(query_id, *groups).orderBy(F.col("_key").desc(), F.col(id_col).asc())
    ranked = None
    for block, n in query_blocks(queries, query_id, query_vec, dim, max_block_bytes):
        cands, bc = _block_candidates(
            corpus, block, id_col=id_col, vec_col=vec_col, qid_name=query_id, qid_type=qid_type, group_col=group_col, k=k, metric=metric, chunk_cells=chunk_cells
        )
        top = cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_key")
        if n > 1:  # the block's answers are written before the next block is collected
            path = scratch_path(spark, "topk")
            top.write.parquet(path)
            top = spark.read.schema(top.schema).parquet(path)
            bc.destroy()
        ranked = top if ranked is None else ranked.unionByName(top)
    if ranked is None:
        fields = [T.StructField(query_id, qid_type), *[corpus.schema[c] for c in [*groups, id_col]], T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]
        ranked = spark.createDataFrame([], T.StructType(fields))
    more = [c for c in carry if c not in (id_col, *groups)]
    if more:
        payload = corpus.select(*groups, id_col, *more)
        if stored:
            ranked = written(ranked, "ranked")
            ids = ranked.select(*groups, id_col).distinct()
            if ids.count() <= SENT_IDS:
                payload = payload.join(F.broadcast(ids), [*groups, id_col], "left_semi")
        ranked = ranked.join(payload, [*groups, id_col])
    ranked = ranked.select(query_id, *groups, id_col, *more, "score", "rank")
    if metric == "l2":
        ranked = ranked.withColumnRenamed("score", "dist")
    return ranked


def multi_table_search(tables: dict[str, DataFrame], queries: DataFrame, *, id_col: str, vec_col: str, k: int = K.TOP_K, metric: str = "l2", carry=(), **kw) -> DataFrame:
    """V9: the same queries against several tables in one pass; ranks are per table.

    Tables are unioned with a ``kind`` column and searched once, ranked per
    ``(query, kind)``.
    """
    union = None
    for kind, t in tables.items():
        t = t.select(F.lit(kind).alias("kind"), id_col, vec_col, *[c for c in carry if c not in (id_col, vec_col)])
        union = t if union is None else union.unionByName(t)
    return vector_topk(union, queries, id_col=id_col, vec_col=vec_col, k=k, metric=metric, carry=carry, group_col="kind", **kw)


def prefiltered_topk(corpus: DataFrame, queries: DataFrame, predicate, **kw) -> DataFrame:
    """A3: metadata filter first (pushed to the scan), then exact search."""
    return vector_topk(corpus.where(predicate), queries, **kw)


def text_search(corpus: DataFrame, queries: DataFrame, embedder, *, id_col: str, text_col: str, query_id: str, query_text: str, k: int = K.TOP_K, metric: str = "cosine", carry=(), **kw) -> DataFrame:
    """A10 / M0: embed both sides with one embedder, then exact top-k."""
    docs = embedder.embed(corpus.select(id_col, text_col, *[c for c in carry if c not in (id_col, text_col)]), text_col, "_vec")
    qs = embedder.embed(queries.select(query_id, query_text), query_text, "query_vec")
    return vector_topk(docs, qs, id_col=id_col, vec_col="_vec", query_id=query_id, query_vec="query_vec", k=k, metric=metric, carry=carry, dim=getattr(embedder, "dim", None), **kw)
