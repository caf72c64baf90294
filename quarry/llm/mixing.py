"""Operator 10: mix sources to target weights by subset-sum budget fitting.

1. Documents are counted by exact length in words: one row per (source, size).
2. Sources by code point (null last) weigh 5, 2, 1, repeating. They share all words by
   weight; a source is filled up to ``max_repeats`` times its own words at most and the
   excess is shared again by weight (``targets``).
3. Per source, every document is taken ``floor(target / source_size)`` times; the rest of
   the target is a subset-sum problem over the lengths. ``fit_counts`` takes the same
   share of every length (what is over whole documents is drawn by a seeded hash of the
   length) and fits the last ``window`` words by bounded-knapsack dynamic programming over
   the counts that are left, to the sum nearest the target on either side. Where that
   misses, a window four times as large is tried, up to the whole target, so a few long
   documents are fitted exactly. The programme holds at most ``CELLS`` sums: reaching
   further (more than about two million words left to fit) it keeps one exact sum per cell of equal
   width, and only there a nearer sum can be missed.
4. ``select_documents`` picks, for every (source, size), as many documents as the plan says
   by a seeded hash. Groups are split into hash ranges of about ``group_rows`` rows; only the
   range in which the boundary falls is ranked, so a length shared by a third of all
   documents is no single task.

Defined cases: null or wordless text has size 0 and is never taken; a source of only such
documents has target 0; an empty table gives an empty result; repeated rows are separate
documents; ties of the hash go to the smaller ``doc_id``, then to a hash of the text; null
``doc_id`` counts as a document; every other column is kept whatever its name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, read, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20
#: words of the budget that dynamic programming fits at first, most sums it holds, rows of one hash range
WINDOW = 16_384
CELLS = 2**21
GROUP_ROWS = 4_096


def word_count(text):
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def fill(sizes: np.ndarray, weights: np.ndarray, most: float) -> np.ndarray:
    """Share ``sum(sizes)`` by weight; none gets more than ``most`` times its size."""
    target, left, open_ = np.zeros(len(sizes)), float(sizes.sum()), np.ones(len(sizes), bool)
    while open_.any():
        share = np.where(open_, left * weights / weights[open_].sum(), 0.0)
        over = open_ & (share > most * sizes)
        if not over.any():
            target[open_] = share[open_]
            break
        target[over] = most * sizes[over]
        left -= float(target[over].sum())
        open_ &= ~over
    return target


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """``sources(source, source_size)``, one row per source -> the same with ``target``."""

    def fit(frames):
        rows = pd.concat(list(frames), ignore_index=True)
        if not len(rows):
            return
        key = [(s is None, [] if s is None else [ord(c) for c in s]) for s in rows["source"]]
        order = sorted(range(len(rows)), key=key.__getitem__)
        rows = rows.iloc[order].reset_index(drop=True)
        w = np.array([weights[i % len(weights)] for i in range(len(rows))], float)
        yield rows.assign(target=fill(rows["source_size"].to_numpy(float), w, most))

    return sources.coalesce(1).mapInPandas(fit, "source string, source_size bigint, target double")


def _hash(values: np.ndarray, seed: int) -> np.ndarray:
    """Seeded hash of whole numbers as numbers in (0, 1] (splitmix64)."""
    x = values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54


def _share(lengths: np.ndarray, counts: np.ndarray, goal: int, over: int, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same share of every length, ``goal`` words and at most ``over`` more: (documents taken, order of the lengths).

    What is over whole documents is drawn: one more of a length with the chance of its
    fraction, in the order of ``draw / fraction`` (sequential Poisson sampling).
    """
    exact = counts * (max(goal, 0) / int((lengths * counts).sum()))
    take = np.minimum(exact.astype(np.int64), counts)
    left = goal - int((lengths * take).sum())
    order = np.argsort(draw / np.maximum(exact - take, 1e-9), kind="stable")
    for i in order:
        if left <= 0:
            break
        if lengths[i] <= left + over and take[i] < counts[i]:
            take[i] += 1
            left -= int(lengths[i])
    return take, order


def _subset_sum(words: list[int], goal: int, met: int, most: int, step: int, cells: int) -> list[int]:
    """The items whose sum comes nearest ``goal`` among the sums up to ``most`` (ties: the smaller sum).

    All sums are multiples of ``step``; ``met`` is the one nearest the goal. One pass over the
    items: a cell holds the item that first made its sum. With more than ``cells`` sums a cell
    is several steps wide, but the sum in it stays exact.
    """
    unit = step * (most // step // cells + 1)
    by = np.full(most // unit + 1, -1, np.int32)
    made, by[0] = np.zeros(1, np.int64), len(words)
    picked, at = [], 0
    for j, w in enumerate(words):
        new = made[made <= most - w] + w
        if (new == met).any():
            picked, at = [j], met - w
            break
        new = new[by[new // unit] < 0]
        if unit > step:
            new = new[np.unique(new // unit, return_index=True)[1]]
        by[new // unit] = j
        made = np.concatenate([made, new])
    else:
        off = np.abs(made - goal)
        at = int(made[off == off.min()].min())
    while at:
        picked.append(int(by[at // unit]))
        at -= words[picked[-1]]
    return picked


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW, *, above: bool = False, seed: int = SEED, cells: int = CELLS) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest ``budget``.

    Sums over the budget count with ``above`` only. The same share of every length fills all
    but the last ``window`` words, dynamic programming over the documents left the rest; the
    window grows until the budget is met or it covers the whole budget.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if total <= 0 or budget <= 0:
        return take
    if budget >= total:
        return counts.astype(np.int64).copy()
    step = int(np.gcd.reduce(lengths[counts > 0]))
    met = budget // step * step + (step if above and budget % step * 2 > step else 0)
    draw, best = _hash(lengths, seed), None
    while True:
        base, order = _share(lengths, counts, budget - window, window // 2, draw)
        held = int((lengths * base).sum())
        most = left = max(0, budget - held)
        if above:  # a sum of twice as much is no nearer than 0, one over by more than a document no nearer than without it
            most += min(left, int(lengths[counts > base].max(initial=0)))
        items: list[tuple[int, int]] = []  # (index, documents), counts split by powers of two
        for i in order:
            spare, k = min(int(counts[i] - base[i]), most // int(lengths[i])), 1
            while spare > 0:
                items.append((i, min(k, spare)))
                spare, k = spare - min(k, spare), 2 * k
        for j in _subset_sum([n * int(lengths[i]) for i, n in items], budget - held, met - held, most, step, cells):
            base[items[j][0]] += items[j][1]
        held = int((lengths * base).sum())
        if best is None or abs(budget - held) < best:
            take, best = base, abs(budget - held)
        if held == met or window >= budget:
            return take
        window = 4 * max(1, window)


def plan(counts: DataFrame, targets_: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``(source, size, n)`` and the targets -> ``(source, size, repeats, extra, source_size, target)``."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        own, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        source = pdf["source"].iloc[0]
        own_seed = seed + (0 if source is None else 1 + zlib.crc32(source.encode()))  # sources draw apart from each other
        base = int(min(target // own, MAX_REPEATS)) if own else 0
        extra = np.zeros(len(pdf), np.int64)
        size, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        some = size > 0
        if base < MAX_REPEATS:
            extra[some] = fit_counts(size[some], n[some], int(round(target - base * own)), window, above=True, seed=own_seed)
        return pdf.assign(repeats=np.where(some, base, 0).astype(np.int64), extra=extra)[["source", "size", "n", "repeats", "extra", "source_size", "target"]]

    joined = counts.join(targets_, counts["source"].eqNullSafe(targets_["source"])).select(counts["source"], "size", "n", "source_size", "target")
    return joined.groupBy("source").applyInPandas(fit, "source string, size bigint, n bigint, repeats bigint, extra bigint, source_size bigint, target double")


def _cell(rank, n, group_rows: int):
    """The hash range of a row: ``n`` rows fall into ranges of about ``group_rows``."""
    ranges = F.greatest(F.lit(1), F.ceil(n / group_rows))
    return F.least(F.floor((rank / F.lit(2.0**64) + 0.5) * ranges), ranges - 1).cast("long")


def mix(docs: DataFrame, *, out: str = "mix", seed: int = SEED, window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` with the struct column ``out``: ``size, source_size, target, repeats`` (0 to 3).

    A column of that name that ``docs`` already has is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    docs = docs.select(*kept)
    size, rank, src, tie, cell, p_src, p_size, fit, c_src, c_size, c_cell, before = (
        fresh(docs, x) for x in ("size", "rank", "src", "tie", "cell", "p_src", "p_size", "fit", "c_src", "c_size", "c_cell", "before")
    )
    rows = docs.withColumns(
        {
            size: word_count(F.col("text")),
            src: F.col("source").cast("string"),
            tie: F.xxhash64(F.col("text")),
            rank: F.xxhash64(F.col("doc_id"), F.lit(seed)),
        }
    )
    counts = staged(rows.groupBy(F.col(src).alias("source"), F.col(size).alias("size")).agg(F.count("*").alias("n")), "mix-counts")
    goal = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")))
    lengths = staged(plan(counts, goal, window, seed), "mix-plan")
    fits = lengths.select(F.col("source").alias(p_src), F.col("size").alias(p_size), F.struct("n", "repeats", "extra", "source_size", "target").alias(fit))
    # only groups of several ranges need to know how many rows the earlier ranges hold
    large = fits.where(F.col(f"{fit}.n") > group_rows)
    narrow = rows.select(src, size, rank)
    cells = (
        narrow.join(large, narrow[src].eqNullSafe(large[p_src]) & (narrow[size] == large[p_size]))
        .groupBy(F.col(src).alias(c_src), F.col(size).alias(c_size), _cell(F.col(rank), F.col(f"{fit}.n"), group_rows).alias(c_cell))
        .agg(F.count("*").alias(before))
    )
    earlier = F.sum(before).over(Window.partitionBy(c_src, c_size).orderBy(c_cell).rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn(before, F.coalesce(earlier, F.lit(0)))
    found = rows.join(fits, rows[src].eqNullSafe(fits[p_src]) & (rows[size] == fits[p_size])).withColumn(cell, _cell(F.col(rank), F.col(f"{fit}.n"), group_rows))
    found = found.join(cells, found[src].eqNullSafe(cells[c_src]) & (found[size] == cells[c_size]) & (found[cell] == cells[c_cell]), "left")
    place = F.row_number().over(Window.partitionBy(src, size, cell).orderBy(rank, F.col("doc_id"), tie))
    more = (F.coalesce(F.col(before), F.lit(0)) + place <= F.col(f"{fit}.extra")).cast("long")
    result = F.struct(F.col(size).alias("size"), F.col(f"{fit}.source_size"), F.col(f"{fit}.target"), (F.col(f"{fit}.repeats") + more).alias("repeats"))
    return found.withColumn(out, result).select(*kept, out)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", F.col("mix.size").alias("size"), F.col("mix.source_size").alias("source_size"), F.col("mix.target").alias("target"), (F.col("mix.size") * F.col("mix.repeats")).alias("taken"))
