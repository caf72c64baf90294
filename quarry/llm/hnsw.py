"""Operator 6: approximate nearest neighbours by one small-world graph per shard.

Distinct directions are hashed to shards of about ``SHARD`` vectors. A shard becomes one row:
its vectors and a hierarchical navigable small-world graph as flat neighbour arrays. A node
is on layer l with probability ``M``^-l; on each layer it is linked to at most ``2 M`` (layer 0)
or ``M`` nodes, chosen from its nearest ones on the layer and on the layer above by the rule
that a candidate nearer to an already chosen neighbour than to the node is passed over
while others are left; links go both ways.

A search enters at the top layer and keeps the ``EF`` best nodes found on every layer, all
queries of a block together. Every query meets every shard: blocks of queries are sent to
the shards by a join, and the shards' answers are merged by a window. The scores returned
are cosines of the original vectors in double precision.

Vectors of one direction (equal after scaling to length one, to twelve places) are one node that
carries their k + 1 smallest ids: more can never be among the k answers of a query, as
equal scores go to the smaller id. A shard hands on every node found that ties with its k-th.

Defined cases: vectors that are null, zero or hold null or non-finite components take no
part; rows with null vec_id take no part; vectors of different length never meet; with
fewer than k candidates all found are returned; a repeated row counts once; empty tables
give an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, staged
from .topk import usable

SHARD = 8_192
BLOCK = 4_096
M = 16
WIDE = 64
EF = 96
SEED = 11


def _nearest(a: np.ndarray, b: np.ndarray, k: int, block: int = 1_024) -> np.ndarray:
    """For each row of ``a`` its ``k`` most similar rows of ``b``, best first."""
    k = min(k, len(b))
    out = np.empty((len(a), k), np.int32)
    for i in range(0, len(a), block):
        s = a[i : i + block] @ b.T
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[i : i + block] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def _choose(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, m: int) -> np.ndarray:
    """The diversity rule for many nodes at once: (nodes x m) chosen candidates, -1 where none."""
    n = len(nodes)
    if n > 2_048:  # bounds the gathered vectors
        return np.concatenate([_choose(x, nodes[a : a + 2_048], cand[a : a + 2_048], m) for a in range(0, n, 2_048)])
    chosen, count = np.full((n, m), -1, np.int32), np.zeros(n, np.int64)
    sims = np.einsum("nd,ncd->nc", x[nodes], x[np.maximum(cand, 0)])
    sims[(cand < 0) | (cand == nodes[:, None])] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    for j in range(cand.shape[1]):
        c, s = cand[:, j], sims[:, j]
        to = np.einsum("nd,nmd->nm", x[np.maximum(c, 0)], x[np.maximum(chosen, 0)])
        to[chosen < 0] = -np.inf
        ok = np.isfinite(s) & (count < m) & (to.max(axis=1) < s) & ~(chosen == c[:, None]).any(axis=1)
        at = np.nonzero(ok)[0]
        chosen[at, count[at]] = c[at]
        count[at] += 1
    for j in range(cand.shape[1]):  # free places go to the nearest that were passed over
        c = cand[:, j]
        at = np.nonzero(np.isfinite(sims[:, j]) & (count < m) & ~(chosen == c[:, None]).any(axis=1))[0]
        chosen[at, count[at]] = c[at]
        count[at] += 1
    return chosen


def build(x: np.ndarray, m: int = M, wide: int = WIDE, seed: int = SEED) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(nodes of each layer, neighbours of each layer as node numbers); ``x`` has unit rows."""
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(rng.random(len(x)) + 1e-300) / np.log(m)).astype(int)
    layers = [np.nonzero(level >= i)[0].astype(np.int32) for i in range(int(level.max()) + 1)] if len(x) else []
    links = []
    for i, nodes in enumerate(layers):
        most = 2 * m if i == 0 else m
        cand = nodes[_nearest(x[nodes], x[nodes], wide)]
        if i + 1 < len(layers):
            cand = np.concatenate([cand, layers[i + 1][_nearest(x[nodes], x[layers[i + 1]], m // 2)]], axis=1)
        out = _choose(x, nodes, cand, m)
        # links back, then the rule again over what a node has and what links to it
        place = np.full(len(x), -1, np.int64)
        place[nodes] = np.arange(len(nodes))
        frm, to = np.repeat(nodes, out.shape[1]), out.ravel()
        frm, to = frm[to >= 0], to[to >= 0]
        near = np.concatenate([np.zeros(0, x.dtype), *(np.einsum("nd,nd->n", x[frm[a : a + 32_768]], x[to[a : a + 32_768]]) for a in range(0, len(to), 32_768))])
        order = np.lexsort((-near, place[to]))  # the nearest of those that link to a node stay
        frm, to = frm[order], place[to[order]]
        count = np.bincount(to, minlength=len(nodes))
        slot = np.arange(len(to)) - np.repeat(np.cumsum(count) - count, count)
        keep = slot < 4 * m
        back = np.full((len(nodes), 4 * m), -1, np.int32)
        back[to[keep], slot[keep]] = frm[keep]
        both = np.concatenate([out, back], axis=1)
        if both.shape[1] > most:
            sorted_ = np.sort(both, axis=1)[:, ::-1]
            width = int((sorted_ >= 0).sum(axis=1).max()) if len(sorted_) else 0
            both = _choose(x, nodes, np.ascontiguousarray(sorted_[:, : max(1, width)]), most)
        links.append(both)
    return layers, links


def search(x: np.ndarray, layers: list[np.ndarray], links: list[np.ndarray], q: np.ndarray, ef: int = EF) -> tuple[np.ndarray, np.ndarray]:
    """Per query the ``ef`` best nodes found (-1: none) and their similarity; unit rows."""
    n, rows = len(q), np.arange(len(q))
    best = np.full((n, ef), -1, np.int32)
    sims = np.full((n, ef), -np.inf, np.float32)
    for i in range(len(layers) - 1, -1, -1):
        place = np.full(len(x), -1, np.int64)
        place[layers[i]] = np.arange(len(layers[i]))
        seen = np.zeros((n, len(x) + 1), bool)
        if i == len(layers) - 1:  # entries: the first nodes of the top layer
            entry = layers[i][: min(ef, len(layers[i]))]
            best[:, : len(entry)] = entry
            sims[:, : len(entry)] = q @ x[entry].T
        seen[rows[:, None], best] = True
        done = best < 0
        while True:
            open_ = np.where(done, -np.inf, sims)
            at = open_.argmax(axis=1)
            live = np.nonzero(np.isfinite(open_[rows, at]))[0]
            if not len(live):
                break
            done[live, at[live]] = True
            near = links[i][place[best[live, at[live]]]]
            new = (near >= 0) & ~seen[live[:, None], near]
            near = np.where(new, near, -1)
            seen[live[:, None], near] = True
            s = np.einsum("qd,qmd->qm", q[live], x[np.maximum(near, 0)])
            s[near < 0] = -np.inf
            all_s, all_n = np.concatenate([sims[live], s], axis=1), np.concatenate([best[live], near], axis=1)
            all_d = np.concatenate([done[live], near < 0], axis=1)
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            sims[live], best[live], done[live] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_n, top, 1), np.take_along_axis(all_d, top, 1)
    return best, sims


def _unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(axis=1, keepdims=True)
    w = v / big
    return w / np.sqrt((w * w).sum(axis=1, keepdims=True))


GRAPH = "dim int, shard int, keep int, vectors binary, ids binary, n_ids binary, layers binary, layer_sizes binary, links binary"


def _graph(pdf: pd.DataFrame) -> pd.DataFrame:
    v = np.array(pdf["v"].to_list(), np.float64)
    layers, links = build(_unit(v).astype(np.float32))
    return pd.DataFrame(
        [
            {
                "dim": pdf["dim"].iloc[0],
                "shard": pdf["shard"].iloc[0],
                "keep": pdf["keep"].iloc[0],
                "vectors": v.tobytes(),
                "ids": np.concatenate(pdf["ids"].to_list()).astype(np.int64).tobytes(),
                "n_ids": pdf["ids"].map(len).to_numpy(np.int32).tobytes(),
                "layers": np.concatenate(layers).tobytes(),
                "layer_sizes": np.array([len(x) for x in layers], np.int32).tobytes(),
                "links": np.concatenate([x.ravel() for x in links]).astype(np.int32).tobytes(),
            }
        ]
    )


def _open(row) -> tuple:
    v = np.frombuffer(row["vectors"], np.float64).reshape(-1, int(row["dim"]))
    sizes = np.frombuffer(row["layer_sizes"], np.int32)
    layers = np.split(np.frombuffer(row["layers"], np.int32), np.cumsum(sizes)[:-1])
    flat, links, a = np.frombuffer(row["links"], np.int32), [], 0
    for i, n in enumerate(sizes):
        width = 2 * M if i == 0 else M
        links.append(flat[a : a + n * width].reshape(n, width))
        a += n * width
    return v, layers, links


def vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """``vec_id, v``: the vectors that take part, in double precision."""
    v = F.col(vec).cast("array<double>")
    some = F.exists(v, lambda x: x != 0)
    return df.where(usable(v) & F.coalesce(some, F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def directions(base: DataFrame) -> DataFrame:
    """``vec_id, v, key``: the vectors with their direction, rounded so that parallel ones agree."""

    def run(batches):
        for b in batches:
            lists = b.column("v")
            flat, off = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
            first, size = off[:-1] - off[0], np.diff(off)
            if len(size):
                w = flat / np.repeat(np.maximum.reduceat(np.abs(flat), first), size)
                w = w / np.repeat(np.sqrt(np.add.reduceat(w * w, first)), size)
            else:
                w = flat
            key = pa.ListArray.from_arrays(pa.array((off - off[0]).astype(np.int32)), pa.array(np.round(w, 12) + 0.0))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), lists, key], names=["vec_id", "v", "key"])

    return base.mapInArrow(run, "vec_id bigint, v array<double>, key array<double>")


def index(base: DataFrame, *, k: int = 5, shard: int = SHARD) -> DataFrame:
    """``base(vec_id, v)`` -> one row per shard (see ``GRAPH``), written to the shared folder; serves up to ``k`` answers."""
    first = Window.partitionBy("key").orderBy("vec_id")  # a rank limit: cut before the shuffle
    one = directions(base).groupBy("key", "vec_id").agg(F.min("v").alias("v"))
    ranked = one.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    nodes = staged(ranked.groupBy("key").agg(F.min_by("v", "vec_id").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "hnsw-nodes")
    shards = max(1, -(-nodes.count() // shard))
    nodes = nodes.select("v", "ids", F.size("v").alias("dim"), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), F.lit(k + 1).alias("keep"))
    return staged(nodes.groupBy("dim", "shard").applyInPandas(_graph, GRAPH), "hnsw-index")


def neighbours(graphs: DataFrame, queries: DataFrame, *, k: int = 5, ef: int = EF, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of ``queries(vec_id, v)`` against an index made for ``k`` answers or more."""
    kept = graphs.agg(F.min("keep")).first()[0]
    if kept is not None and kept < k + 1:
        raise ValueError(f"the index keeps {kept} ids of a direction; {k} answers need {k + 1}")
    blocks = max(1, -(-queries.count() // block))
    asked = queries.distinct().withColumns({"dim": F.size("v"), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")})
    places = graphs.select(F.col("dim").alias("of_dim"), F.col("shard").alias("to"))  # one row per shard
    sent = asked.join(places, asked["dim"] == F.col("of_dim")).select("dim", F.col("to").alias("shard"), "block", "vec_id", "v")
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(shard) and len(asked):
            row = shard.iloc[0]
            v, layers, links = _open(row)
            x64 = _unit(v)
            x = x64.astype(np.float32)
            n_ids = np.frombuffer(row["n_ids"], np.int32)
            ids, begin = np.frombuffer(row["ids"], np.int64), np.cumsum(n_ids) - n_ids
            for a in range(0, len(asked), 256):
                part = asked.iloc[a : a + 256]
                q = np.array(part["v"].to_list(), np.float64)
                unit, own = _unit(q), part["vec_id"].to_numpy(np.int64)
                best, _ = search(x, layers, links, unit.astype(np.float32), max(ef, 2 * (k + 1)))
                # what was found is ranked again in double precision
                exact = np.where(best >= 0, np.einsum("qd,qcd->qc", unit, x64[np.maximum(best, 0)]), -2.0)
                # a node other than the query's own gives an answer at least: k + 1 nodes hold k, and all that tie with the last
                last = -np.sort(-exact, axis=1)[:, min(k, exact.shape[1] - 1)]
                best = np.where(exact >= last[:, None], best, -1)
                for i in range(len(part)):
                    for node, s in zip(best[i], exact[i]):
                        if node >= 0:
                            own_ids = ids[begin[node] : begin[node] + n_ids[node]]
                            own_ids = own_ids[own_ids != own[i]][:k]
                            out["query_id"].append(np.full(len(own_ids), own[i]))
                            out["vec_id"].append(own_ids)
                            out["score"].append(np.full(len(own_ids), min(1.0, max(-1.0, s))))
        if not out["query_id"]:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return pd.DataFrame({c: np.concatenate(x) for c, x in out.items()})

    key = ["dim", "shard", "block"]
    found = held.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(find, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(read(spark, sf_dir, "embeddings"))
    return neighbours(index(base), base.where(F.col("vec_id") % 50 == 0))
