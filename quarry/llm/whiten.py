"""Operator 13: whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries become integers x = floor(scale * c). The fit list holds each distinct x vector
once. Its scatter is summed centred: every task subtracts the integer vector nearest the mean,
multiplies what is left with itself and sends one row per pair of dimensions; sums stay
whole numbers, and the distance of that integer vector to the true mean is taken off at the
end, also in whole numbers. So the scatter is exact, whatever the partitions.

The scatter (dimension x dimension, the only thing that reaches the driver) is factored by
Cholesky with diagonal pivoting, A = L Lᵀ, and one-sided Jacobi rotations make the columns of
the triangular factor L orthogonal: their squared norms are the eigenvalues, the normalised
columns the components (the sign makes the largest entry positive). Factoring stops where the
rest of the diagonal is rounding error, so a component of no variance is not returned.

A last pass over the fit list measures the covariance of the whitened vectors; then every row
is projected where it lies.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are dropped;
x beyond 64 bits becomes the nearest 64-bit number; a vector shorter than the longest is
continued with zeros; repeated rows and rows of null ``vec_id`` are returned each; fewer
components than asked for are returned when the variance has fewer directions (none when
all vectors are equal); an empty table gives an empty result; a ``deviation`` beyond 64 bits is
null; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, staged

SCALE, COMPONENTS = 256, 4
#: sums travel as two parts of at most 60 bits below and the rest above
LIMB = 60
_EXACT = 2.0**53
_TOP = 2**63 - 1


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = np.floor(values * float(scale))
    inside = np.abs(v) < 2.0**63
    return np.where(inside, np.where(inside, v, 0.0).astype(np.int64), np.where(v > 0, _TOP, -_TOP - 1))


def quantised(df: DataFrame, scale: int = SCALE, vec: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``vec_id, x``: the usable rows with their integer vectors."""

    def run(batches):
        for b in batches:
            lists = b.column("v")
            flat, off = lists.flatten(), np.asarray(lists.offsets)
            whole = np.concatenate([[0], np.cumsum(flat.is_valid().to_numpy(zero_copy_only=False))])
            values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
            fine = np.concatenate([[0], np.cumsum(np.isfinite(values))])
            first = off - off[0]
            good = (np.diff(fine[first]) == np.diff(first)) & (np.diff(whole[first]) == np.diff(first))
            x = np.where(np.isfinite(values), values, 0.0)
            out = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(_integers(x, scale)))
            yield pa.RecordBatch.from_arrays([b.column("id"), out], names=["vec_id", "x"]).filter(pa.array(good))

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("v is not null")
    return rows.mapInArrow(run, "vec_id bigint, x array<bigint>")


def _matrix(column, dim: int) -> np.ndarray:
    """A list column as rows x dim; shorter lists go on with zeros."""
    off = np.asarray(column.offsets)
    size = np.diff(off)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _gram(y: np.ndarray) -> np.ndarray:
    """yᵀ y in whole numbers: by double products while these are exact, else by Python's integers."""
    top = float(np.abs(y.astype(np.float64)).max(initial=0.0))
    if top * top * max(1, len(y)) < _EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    big = y.astype(object)
    return big.T.dot(big)


def _deviations(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x - centre; plain 64-bit integers where that can't overflow."""
    if x.size and max(int(x.max()), max(centre)) - min(int(x.min()), min(centre)) > _TOP:
        return x.astype(object) - np.array(centre, object)[None, :]
    return x - np.array(centre, np.int64)[None, :]


def _scatter(vectors: DataFrame, dim: int, n: int, sums: list[int]) -> list[list[int]]:
    """n² times the scatter about the mean, in whole numbers."""
    centre = [max(-_TOP - 1, min(_TOP, (2 * s + n) // (2 * n))) for s in sums]

    def run(batches):
        total = None
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                g = _gram(_deviations(_matrix(b.column("x").slice(a, 4096), dim), centre))
                total = g if total is None else total + g
        if total is not None:
            i, j = np.triu_indices(dim)
            v = total[i, j]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(i.astype(np.int32)),
                    pa.array(j.astype(np.int32)),
                    pa.array([str(int(t) >> LIMB) for t in v]),
                    pa.array([int(t) & ((1 << LIMB) - 1) for t in v], pa.int64()),
                ],
                names=["i", "j", "above", "below"],
            )

    parts = vectors.select("x").mapInArrow(run, "i int, j int, above string, below bigint")
    total = parts.groupBy("i", "j").agg(F.sum(F.col("above").cast("decimal(38,0)")).alias("above"), F.sum(F.col("below").cast("decimal(38,0)")).alias("below"))
    off = [s - n * c for s, c in zip(sums, centre)]  # n times the mean's distance from the centre
    out = [[0] * dim for _ in range(dim)]
    for r in total.collect():  # one row per pair of dimensions
        y = (int(r["above"]) << LIMB) + int(r["below"])
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = n * n * y - n * off[r["i"]] * off[r["j"]]
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (rows in the order of ``a``) with a = L Lᵀ and as many columns as a has directions."""
    d = len(a)
    rest, columns = a.astype(np.float64).copy(), []
    floor = d * np.finfo(float).eps * float(np.diag(rest).max(initial=0.0))
    for _ in range(d):
        p = int(np.diag(rest).argmax())
        if rest[p, p] <= floor:
            break
        column = rest[:, p] / np.sqrt(rest[p, p])
        rest = rest - np.outer(column, column)
        rest[p, :] = rest[:, p] = 0.0
        columns.append(column)
    return np.array(columns).T.reshape(d, len(columns))


def jacobi_columns(l: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Rotate the columns of ``l`` until all are orthogonal (one-sided Jacobi).

    Each round rotates disjoint pairs, all at once; the rounds of a sweep meet every pair.
    """
    u = l.copy()
    r = u.shape[1]
    order = list(range(r)) + ([None] if r % 2 else [])
    half = len(order) // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(0, len(order) - 1)):
            pairs = [(p, q) for p, q in zip(order[:half], order[:half - 1 : -1]) if p is not None and q is not None]
            p, q = np.array(pairs, np.int64).reshape(-1, 2).T
            x, y = u[:, p], u[:, q]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            scale = np.sqrt(a * b)
            off = np.where(scale > 0, np.abs(c) / np.where(scale > 0, scale, 1.0), 0.0)
            worst = max(worst, float(off.max(initial=0.0)))
            turn = off > 1e-17
            zeta = (b - a) / np.where(turn, 2.0 * c, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = np.where(turn, 1.0 / np.hypot(1.0, t), 1.0)
            sin = np.where(turn, cos * t, 0.0)
            u[:, p], u[:, q] = cos * x - sin * y, sin * x + cos * y
            order = [order[0], order[-1], *order[1:-1]]
        if worst < 1e-15:
            break
    return u


def fit(vectors: DataFrame, *, components: int = COMPONENTS) -> dict | None:
    """The whitening of a table of distinct integer vectors ``x``; None without rows."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim")).first()
    n, dim = int(size["n"]), int(size["dim"] or 0)
    if not n or not dim:
        return None
    per = vectors.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    sums = [0] * dim
    for r in per.collect():  # one row per dimension
        sums[r["i"]] = int(r["s"])
    scatter = _scatter(vectors, dim, n, sums)
    # covariance = whole numbers / n³, each entry rounded once
    cov = np.array([[scatter[i][j] / n**3 for j in range(dim)] for i in range(dim)])
    u = jacobi_columns(pivoted_cholesky(cov))
    value = (u * u).sum(axis=0)
    best = np.argsort(-value, kind="stable")[:components]
    axes = u[:, best] / np.sqrt(value[best])
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(best))] < 0, -1.0, 1.0) if len(best) else axes
    trace = sum(scatter[i][i] for i in range(dim)) / n**3
    return {"n": n, "sums": sums, "dim": dim, "axes": axes, "values": value[best], "trace": trace}


def _whitened(model: dict, x: np.ndarray) -> tuple[np.ndarray, list]:
    """(rows x components, exact sums of (n x - S)² as Python's integers)."""
    n, sums = model["n"], model["sums"]
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    bound = n * top + max(map(abs, sums))
    if bound * bound * model["dim"] <= _TOP:
        d = n * x - np.array(sums, np.int64)[None, :]
        deviation = (d * d).sum(axis=1).tolist()
        centred = d / n
    else:
        d = n * x.astype(object) - np.array(sums, object)[None, :]
        deviation = [int(v) for v in (d * d).sum(axis=1)]
        centred = (d / n).astype(np.float64)
    return (centred @ model["axes"]) / np.sqrt(model["values"])[None, :], deviation


def identity_error(vectors: DataFrame, model: dict) -> float:
    """Largest absolute entry of (covariance of the whitened vectors - identity)."""
    k, dim = len(model["values"]), model["dim"]

    def run(batches):
        total, gram = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w, _ = _whitened(model, _matrix(b.column("x"), dim))
            total, gram = total + w.sum(axis=0), gram + w.T @ w
        values = np.concatenate([total, gram.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["at", "value"])

    got = np.zeros(k + k * k)
    for r in vectors.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        got[r["at"]] = r["value"]
    # the whitened vectors' own mean is zero but for rounding: taking it off again keeps them centred
    mean = got[:k] / model["n"]
    return float(np.abs(got[k:].reshape(k, k) / model["n"] - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(rows: DataFrame, model: dict | None, error: float | None = None) -> DataFrame:
    """One row per vector of ``quantised`` and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None or not len(model["values"]):
        return rows.limit(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in schema.split(", "))])
    k = len(model["values"])

    def run(batches):
        for b in batches:
            w, deviation = _whitened(model, _matrix(b.column("x"), model["dim"]))
            m = b.num_rows
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model["n"], np.int64)),
                    pa.array([v if v <= _TOP else None for v in deviation], pa.int64()).take(pa.array(each)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(model["values"] / model["trace"], m)),
                    pa.array(np.full(m * k, np.nan if error is None else error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(read(spark, sf_dir, "embeddings"))
    # equal vectors meet before they are shuffled; the list is written once and read three times
    vectors = staged(rows.select("x").distinct(), "whitening-fit")
    model = fit(vectors)
    return whiten(rows, model, None if model is None else identity_error(vectors, model))
