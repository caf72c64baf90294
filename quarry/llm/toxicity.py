"""Operator 2: toxicity by a counterfactual-regularised classifier.

Features are the words of a text (lower case) and the character n-grams inside each word,
hashed; a text has a feature or not. ``fit``:

1. a sample of about ``sample_rows`` labelled rows (a documented bound; the rows with the
   smallest hashes of their id) is written once;
2. tasks count, per hashed feature, the toxic and the other texts that have it; features
   that speak for toxicity (likelihood ratio above ``MIN_G2``) are kept, the strongest
   ``MAX_FEATURES``, and named by the grams of toxic texts that have these hashes;
3. every sentence of the sample that names a group (``IDENTITY_GROUPS``) is written again
   with the other terms of its group. Logistic regression is fitted on the texts with an
   L2 penalty and with ``penalty`` x (score of the sentence - score of its counterfactual)^2, so
   weight that only a group's name would carry goes to what is said about it.

Scoring reads whole texts once and keeps a memo of words; the model is at most four times
``MAX_FEATURES`` grams and weights. ``labels.toxic`` is the only label used; lang, source and doc_id are
never inputs of a score.

Defined cases: a null text is scored like an empty one (the score of no feature); several
labels of one doc_id count as toxic if one is; null labels are ignored; without labels of
both kinds every score is the smoothed share of toxic rows; null doc_id has held_out false
and is never trained on; further columns are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, read, staged, text_slices

SAMPLE_ROWS = 20_000
BITS = 20
GRAMS = (3, 4, 5, 6)
MAX_FEATURES = 8_192
MIN_G2 = 10.83
PENALTY = 4.0
CUT = 0.3
MEMO_WORDS = 200_000
#: fixed values: terms that name groups of people; a swap stays inside its list
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("old", "young", "elderly"),
    ("deaf", "blind", "disabled"),
)

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def grams_of(word: str) -> set[str]:
    """A word in lower case with its edges, and the n-grams inside."""
    s = f"<{word}>"
    return {s, *(s[i : i + n] for n in GRAMS for i in range(len(s) - n + 1))}


def hashed(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram) & ((1 << BITS) - 1)


class Vocabulary:
    """word -> numbers of its features, with a bounded memo.

    ``grams``: the features of a model (gram -> number); without it every gram counts, by
    its hash.
    """

    def __init__(self, grams: dict[str, int] | None = None):
        self.grams, self.memo = grams, {}

    def of(self, words: set[str]) -> np.ndarray:
        """Features of a text with these words."""
        memo, grams = self.memo, self.grams
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in words.difference(memo):
            if grams is None:
                memo[w] = np.array([hashed(g) for g in grams_of(w)], np.int32)
            else:
                s = f"<{w}>"
                n = len(s)
                found = {grams[s]} if s in grams else set()
                for k in GRAMS:
                    for i in range(n - k + 1):
                        g = s[i : i + k]
                        if g in grams:
                            found.add(grams[g])
                memo[w] = np.array(list(found), np.int32) if found else None
        found = [x for x in map(memo.__getitem__, words) if x is not None]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def counterfactuals(text: str, groups=IDENTITY_GROUPS):
    """(words of a sentence, words of it with a group's term swapped) for each swap."""
    other = {t: [o for o in g if o != t] for g in groups for t in g}
    if not any(t in text for t in other):
        return
    for sentence in _SENTENCE.findall(text):
        words = _WORD.findall(sentence)
        for t in sorted(set(words) & other.keys()):
            for o in other[t]:
                yield set(words), (set(words) - {t}) | {o}


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``text, y`` of about ``rows`` labelled training rows."""
    known = labels.where("toxic is not null and doc_id is not null").where(fold("doc_id", 4) != 2)
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    share = rows / max(1, known.count())
    unit = F.xxhash64("id", F.lit(2)) / F.lit(2.0**64) + 0.5
    some = known.where(unit < share)  # about ``rows`` rows of two numbers: a bounded broadcast
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "id").select("text", "y")


def _counter(batches):
    vocabulary, n = Vocabulary(), np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for part, texts in text_slices(batch):
            for t, y in zip(texts, part.column("y").to_pylist()):
                n[y, vocabulary.of(set(_WORD.findall(t.lower())))] += 1
    at = np.nonzero(n.sum(axis=0))[0]
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[1, at].astype(np.int64)), pa.array(n[0, at].astype(np.int64))], names=["feature", "pos", "neg"])


def _gram_counter(features: list[int]):
    """Texts per class of every gram whose hash is among ``features``."""

    def count(batches):
        among, memo, n = set(features), {}, {}
        for batch in batches:
            for part, texts in text_slices(batch):
                for t, y in zip(texts, part.column("y").to_pylist()):
                    found = set()
                    for w in set(_WORD.findall(t.lower())):
                        got = memo.get(w)
                        if got is None:
                            if len(memo) >= MEMO_WORDS:
                                memo.clear()
                            memo[w] = got = tuple(g for g in grams_of(w) if hashed(g) in among)
                        found.update(got)
                    for g in found:
                        n.setdefault(g, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([x[1] for x in n.values()], pa.int64()), pa.array([x[0] for x in n.values()], pa.int64())], names=["gram", "pos", "neg"])

    return count


def _g2(pos: int, neg: int):
    """G2 of a feature that ``p`` of ``pos`` toxic and ``n`` of ``neg`` other texts have."""
    p, n, all_ = F.col("p").cast("double"), F.col("n").cast("double"), float(pos + neg)
    seen = p + n

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    return 2 * (part(p, seen * (pos / all_)) + part(n, seen * (neg / all_)) + part(pos - p, (all_ - seen) * (pos / all_)) + part(neg - n, (all_ - seen) * (neg / all_)))


def strongest(rows: DataFrame, features: list[int], pos: int, neg: int, most: int) -> list[str]:
    """The grams of toxic texts behind the chosen hashes, those that tell most for toxic first, at most ``most``."""
    counts = rows.mapInArrow(_gram_counter(features), "gram string, pos bigint, neg bigint").groupBy("gram").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).where("p > 0")
    g2 = _g2(pos, neg)
    signed = F.when(F.col("p") / pos > F.col("n") / neg, g2).otherwise(-g2)
    return [r["gram"] for r in counts.withColumn("g2", signed).orderBy(F.col("g2").desc(), "gram").limit(most).collect()]


def _rows_of(grams: dict[str, int], groups):
    def rows(batches):
        vocabulary = Vocabulary(grams)
        for batch in batches:
            for part, texts in text_slices(batch):
                kinds, ys, xs, cs = [], [], [], []
                for t, y in zip(texts, part.column("y").to_pylist()):
                    low = t.lower()
                    kinds.append(0), ys.append(y), xs.append(vocabulary.of(set(_WORD.findall(low)))), cs.append([])
                    seen = set()
                    for a, b in counterfactuals(low, groups):
                        x, c = vocabulary.of(a), vocabulary.of(b)
                        if (pair := (x.tobytes(), c.tobytes())) not in seen and pair[0] != pair[1]:
                            seen.add(pair)
                            kinds.append(1), ys.append(y), xs.append(x), cs.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(ys, pa.int32()), pa.array(xs, pa.list_(pa.int32())), pa.array(cs, pa.list_(pa.int32()))], names=["kind", "y", "x", "c"])

    return rows


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of an Arrow column as views of one array."""
    whole = column.combine_chunks()
    end = np.cumsum(pc.list_value_length(whole).to_numpy(zero_copy_only=False))
    return np.split(whole.flatten().to_numpy(), end[:-1]) if len(end) else []


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return row, np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)


def train(x: list, y: np.ndarray, pairs: list[tuple], n_features: int, penalty: float = PENALTY, l2: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the whole (bounded) sample."""
    row, col = _flat(x)
    n, m = len(x), max(1, len(pairs))
    arow, acol = _flat([p[0] for p in pairs])
    brow, bcol = _flat([p[1] for p in pairs])
    w, b = np.zeros(n_features), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    mom, vel = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col], n) + b
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(col, e[row], n_features) + l2 * w
        if pairs:
            change = np.bincount(arow, w[acol], m) - np.bincount(brow, w[bcol], m)
            g += 2 * penalty * (np.bincount(acol, change[arow], n_features) - np.bincount(bcol, change[brow], n_features))
        g = np.append(g, e.sum())
        mom, vel = 0.9 * mom + 0.1 * g, 0.999 * vel + 0.001 * g * g
        move = 0.1 * (mom / (1 - 0.9**step)) / (np.sqrt(vel / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, penalty: float = PENALTY, groups=IDENTITY_GROUPS) -> dict:
    """The model: ``grams`` (gram -> number), ``weights`` by number, ``intercept``."""
    rows = staged(sample(docs, labels, sample_rows), "toxic-sample")
    per = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = per.get(1, 0), per.get(0, 0)
    flat = {"grams": {}, "weights": np.zeros(0), "intercept": float(np.log((pos + 1) / (neg + 1)))}
    if not pos or not neg:
        return flat
    counts = rows.mapInArrow(_counter, "feature int, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).where("p >= 2")
    best = counts.where(F.col("p") / pos > F.col("n") / neg).withColumn("g2", _g2(pos, neg)).where(F.col("g2") > MIN_G2).orderBy(F.col("g2").desc(), "feature").limit(MAX_FEATURES)
    features = [r["feature"] for r in best.collect()]
    if not features:
        return flat
    grams = {g: i for i, g in enumerate(strongest(rows, features, pos, neg, 4 * MAX_FEATURES))}
    got = rows.mapInArrow(_rows_of(grams, groups), "kind int, y int, x array<int>, c array<int>").toArrow()  # the bounded sample
    text = got["kind"].to_numpy() == 0
    x, c = _lists(got["x"]), _lists(got["c"])
    pairs = [(x[i], c[i]) for i in np.nonzero(~text)[0]]
    w, b = train([x[i] for i in np.nonzero(text)[0]], got["y"].to_numpy()[text].astype(float), pairs, len(grams), penalty)
    return {"grams": grams, "weights": w, "intercept": b}


def scorer(model: dict):
    """texts -> scores"""
    w, b = np.asarray(model["weights"]), model["intercept"]
    vocabulary = Vocabulary(model["grams"])

    def scores(texts) -> np.ndarray:
        z = np.array([b + (w[vocabulary.of(set(_WORD.findall(t.lower())))].sum() if t else 0.0) for t in texts])
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    return scores


def _score_batches(model: dict):
    def run(batches):
        scores = scorer(model)
        for batch in batches:
            for part, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(texts), pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_score_batches(model), "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: dict, cut: float = CUT) -> DataFrame:
    """``docs`` without the rows that score ``cut`` or more."""

    def run(batches):
        scores = scorer(model)
        for batch in batches:
            for part, texts in text_slices(batch):
                yield part.filter(pa.array(scores(texts) < cut))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
