"""Operator 11: runs (maximal periodic stretches) of words, by suffix trees and Lyndon roots.

A run is a stretch of consecutive words with smallest period q and length at least
``max(min_length, min_periods * q)`` that no neighbouring word extends with period q.

Every run of two or more periods holds, as its first full period from some place on, the longest
Lyndon word that begins there, for the order of the words or the order reversed. So each
place of a text gives two candidates (place, length of its longest Lyndon word); the longest
common extensions of two places q apart, to the right in the suffix tree of the text and to
the left in the tree of the reversed text, tell how far period q reaches. Ukkonen's
algorithm builds the trees, an Euler tour and a sparse table answer an extension in constant
time, and the Lyndon words follow from the order of the suffixes.

Before the trees are built, stretches that cannot lie in a run are set aside: in a run of at
least six words and four periods every three consecutive words of it occur three times or more, so
only stretches of words whose triples all do (counted by a hash, which can only count too many)
go on, and are counted again by themselves until nothing changes. A neighbour that could extend a
run would be part of its stretch, so nothing is lost. With less than that asked for
(``min_periods`` below 4, ``min_length`` below 6) the whole text goes on.

Rows are independent: map only, one row's trees at a time.

Defined cases: a null or empty text has no words and no run; a text without a run keeps all its
words; repeated rows and rows of null id are returned each; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_slices
from .suffix_tree import Tree

MIN_LENGTH, MIN_PERIODS = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place: the distance to the next smaller suffix."""
    r = rank.tolist()
    n = len(r) - 1  # the last suffix is the empty one, the smallest
    out, stack = [0] * n, [n]
    for i in range(n - 1, -1, -1):
        x = r[i]
        while r[stack[-1]] > x:
            stack.pop()
        out[i] = stack[-1] - i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(words: list[int], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Runs of a sequence of positive integers: rows (start, length, period), in order."""
    n = len(words)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    ahead, back = Tree(words), Tree(words[::-1])
    place = np.arange(n)
    found = []
    for rank in (ahead.rank, ahead.backward_rank()):
        period = lyndon_lengths(rank)
        right = ahead.lce(place, place + period)
        left = back.lce(n - place, n - place - period)
        length = left + period + right
        keep = (length >= 2 * period) & (length >= min_length) & (length >= min_periods * period)
        found.append(np.stack([place - left, length, period], axis=1)[keep])
    return np.unique(np.concatenate(found), axis=0)


def _codes_compact(codes: np.ndarray) -> list[int]:
    return (np.unique(codes, return_inverse=True)[1] + 1).tolist()


def stretches(codes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Stretches (begin, end) that may hold a run of six or more words and four or more periods.

    ``group`` numbers the texts whose words follow each other in ``codes``; no stretch crosses
    from one to the next.
    """
    place, group = np.arange(len(codes)), group.astype(np.uint64)
    word = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mix = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
    while True:
        if len(place) < MIN_LENGTH:
            return np.zeros((0, 2), np.int64)
        whole = np.nonzero((place[2:] == place[:-2] + 2) & (group[2:] == group[:-2]))[0]
        w = word[place]
        with np.errstate(over="ignore"):
            h = ((w[whole] * mix[0] ^ w[whole + 1]) * mix[1] ^ w[whole + 2]) * mix[2] + group[whole] * mix[1]
            h = (h ^ (h >> np.uint64(29))) * mix[0]
        bits = max(10, int(8 * len(place)).bit_length())
        h = (h >> np.uint64(64 - bits)).astype(np.int64)
        often = whole[np.bincount(h, minlength=1 << bits)[h] >= 3]
        covered = np.zeros(len(place), bool)
        for d in range(3):
            covered[often + d] = True
        # neighbouring words are of one stretch where a frequent triple holds both
        joined = np.zeros(len(place), bool)
        joined[often + 1] = joined[often + 2] = True
        first = np.nonzero(covered & ~joined)[0]
        kept = np.nonzero(covered)[0]
        number = np.cumsum(covered & ~joined)[kept] - 1
        size = np.bincount(number, minlength=len(first))
        stay = size[number] >= MIN_LENGTH if len(kept) else np.zeros(0, bool)
        last = len(place)
        place, group = place[kept[stay]], number[stay].astype(np.uint64)
        if len(place) == last or not len(place):
            break
    if not len(place):
        return np.zeros((0, 2), np.int64)
    edge = np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0]
    return np.stack([place[edge], place[np.concatenate([edge[1:], [len(place)]]) - 1] + 1], axis=1)


def _slice_runs(codes: np.ndarray, size: np.ndarray, min_length: int, min_periods: int):
    """Runs of all texts of a slice: (text, start, length, period) rows in order."""
    text = np.repeat(np.arange(len(size)), size)
    if min_length >= MIN_LENGTH and min_periods >= MIN_PERIODS:
        spans = stretches(codes, text)
    else:
        z = np.cumsum(size)
        spans = np.stack([z - size, z], axis=1)[size > 0]
    first = np.cumsum(size) - size
    out = [np.zeros((0, 4), np.int64)]
    for a, z in spans:
        r = runs_of(_codes_compact(codes[a:z]), min_length, min_periods)
        if len(r):
            t = int(text[a])
            r[:, 0] += a - first[t]
            out.append(np.concatenate([np.full((len(r), 1), t), r], axis=1))
    found = np.concatenate(out)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", word: str = WORD, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Per row: its id, number of words, runs (by start, then period) and the text with every run
    cut down to its first period, words joined by one blank."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        words_of = re.compile(word).findall
        for batch in batches:
            for b, texts in text_slices(batch):
                words = [words_of(t) if t else [] for t in texts]
                size = np.array([len(x) for x in words], np.int64)
                flat = pa.array([x for some in words for x in some], pa.string()).dictionary_encode()
                codes = flat.indices.to_numpy().astype(np.int64)
                found = _slice_runs(codes, size, min_length, min_periods)
                # +1 where the part of a run to be dropped begins, -1 where it ends
                first = np.cumsum(size) - size
                step = np.zeros(len(codes) + 1, np.int64)
                at = first[found[:, 0]] + found[:, 1]
                np.add.at(step, at + found[:, 3], 1)
                np.add.at(step, at + found[:, 2], -1)
                dropped = np.cumsum(step)[:-1] > 0
                n = np.bincount(found[:, 0], minlength=len(size))
                collapsed = []
                for i, some in enumerate(words):
                    if n[i]:
                        gone = dropped[first[i] : first[i] + size[i]].tolist()
                        some = [x for x, g in zip(some, gone) if not g]
                    collapsed.append(" ".join(some))
                items = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], names=["start", "length", "period"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(size), pa.ListArray.from_arrays(offsets, items), pa.array(collapsed, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return rows.mapInArrow(run, SCHEMA)


def with_planted_tails(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fixed rule of the query: a tenth of the documents, by the crc32 h of the id, go on
    from word a = h div 10 mod n on with the p words from there again and again."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), h.alias("h"), g.alias("g"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), 0)
    rows = rows.withColumn("w", F.when((F.col("h") % 10 == 0), words))
    n = F.size("w")
    rows = rows.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int")))
    p = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    rows = rows.withColumn("p", p)
    cycle = F.slice("w", F.col("a") + 1, F.col("p"))
    rest = n - F.col("a")
    # as many whole cycles as fit, then the words left over
    whole = F.concat(F.slice("w", F.lit(1), F.col("a")), F.flatten(F.array_repeat(cycle, F.floor(rest / F.col("p")).cast("int"))), F.slice(cycle, F.lit(1), F.pmod(rest, F.col("p"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_tails(read(spark, sf_dir, "documents")))
    # greatest length / period by whole numbers; ties to the smallest start, then period
    order = """(x, y) -> case
        when x.length * y.period != y.length * x.period then case when x.length * y.period > y.length * x.period then -1 else 1 end
        when x.start != y.start then case when x.start < y.start then -1 else 1 end
        when x.period != y.period then case when x.period < y.period then -1 else 1 end
        else 0 end"""
    best = F.get(F.expr(f"array_sort(runs, {order})"), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
