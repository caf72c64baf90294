"""Operator 7: language of words and texts by a linear-chain conditional random field.

Words (runs of letters, lower case) have affix, n-gram, word and lexicon features; the
weights of the features and of the transitions between neighbouring words are fitted
together by maximum likelihood (forward-backward, AdaGrad) on chains made of pieces of the
sampled texts, some of them switching language. A text is one chain, however long: the
windows of ``CHAIN`` words of all texts of a slice run forward and backward together as arrays, and
messages pass the borders exactly: the product of a window's potentials takes the message at
its begin to its end, so a short pass over windows gives every window the messages that come
in from both sides. The language of a text is the one with the largest sum of word
marginals (by letters); its score is that share.

Words of a slice are told apart by Arrow, and the features of the distinct ones are found
together: 64-bit hashes of affixes and n-grams from arrays of code points, looked up in one
table.

``fit`` takes about ``PER_LANG`` whole texts of every language (a documented bound, by a
hash of doc_id) from the training fold; lang, source and doc_id are never inputs of a
prediction.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any
training row every text is ``und`` (and ``keep_known`` keeps all rows); ties go to the first language by code point; rows with
null lang or null doc_id are never trained on; repeated rows are predicted each; further
columns are ignored by ``predict`` and kept by ``keep_known``.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, read, staged, text_slices

PER_LANG = 250
PIECE_WORDS = 24
CHAIN = 64
MIN_FEATURE, MIN_LEXICON = 3, 5
EPOCHS = 2
SEED = 7
#: text labelled at a time: a slice's words, potentials and messages take some fifty times its size
SLICE_CHARS = 1_000_000
#: least share of a text's letters in words of which the model knows a feature
KNOWN = 0.5

_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str, lexicon: dict[str, str]) -> list[str]:
    """The word, its affixes of up to four letters, all its two- and three-letter parts, its lexicon entry."""
    s = f"<{word}>"
    out = ["w" + word]
    out += ["p" + word[:n] for n in range(1, min(4, len(word)) + 1)]
    out += ["s" + word[-n:] for n in range(1, min(4, len(word)) + 1)]
    out += [f"{n}" + s[i : i + n] for n in (2, 3) for i in range(len(s) - n + 1)]
    if word in lexicon:
        out.append(lexicon[word])
    return out


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_KIND = {k: np.uint64(ord(k)) for k in "wps23"}


def _fold(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ c) * _MIX[1]
    return (h ^ (h >> np.uint64(31))) * _MIX[2]


def _seed(kind: str, n: int) -> np.ndarray:
    return np.full(n, _KIND[kind] * _MIX[0], np.uint64)


def feature_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash) of every feature of the words but the lexicon's."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.cumsum(size) - size
    number, out = [], []
    with np.errstate(over="ignore"):
        # whole words and affixes: letter by letter over all words long enough
        whole = _seed("w", len(words))
        for i in range(int(size.max(initial=0))):
            on = np.nonzero(size > i)[0]
            whole[on] = _fold(whole[on], points[begin[on] + i])
        number.append(np.arange(len(words)))
        out.append(whole)
        for kind in "ps":
            for n in (1, 2, 3, 4):
                on = np.nonzero(size >= n)[0]
                at = begin[on] if kind == "p" else begin[on] + size[on] - n
                h = _seed(kind, len(on))
                for i in range(n):
                    h = _fold(h, points[at + i])
                number.append(on)
                out.append(h)
        # parts of <word>: its letters with the two signs around them
        wide = size + 2
        first = np.cumsum(wide) - wide
        text = np.empty(int(wide.sum()), np.uint64)
        inner = np.ones(len(text), bool)
        inner[first] = inner[first + wide - 1] = False
        text[first], text[first + wide - 1], text[inner] = ord("<"), ord(">"), points
        of = np.repeat(np.arange(len(words)), wide)
        for n in (2, 3):
            at = np.nonzero(of[: len(of) - n + 1] == of[n - 1 :])[0]
            h = _seed(str(n), len(at))
            for i in range(n):
                h = _fold(h, text[at + i])
            number.append(of[at])
            out.append(h)
    return np.concatenate(number), np.concatenate(out)


class FeatureTable:
    """Feature numbers by 64-bit hash, in an open table of fixed probes."""

    def __init__(self, names: list[str]):
        some = [x for x in names if x[0] in _KIND]
        keys = np.array([self._hash(x) for x in some], np.uint64)
        number = np.array([i for i, x in enumerate(names) if x[0] in _KIND], np.int64)
        self.mask = np.uint64((1 << max(4, int(4 * len(some) + 1).bit_length())) - 1)
        self.keys, self.number = np.zeros(int(self.mask) + 1, np.uint64), np.full(int(self.mask) + 1, -1, np.int64)
        left, self.probes = np.arange(len(some)), 0
        while len(left):
            slot = ((keys[left] + np.uint64(self.probes)) & self.mask).astype(np.int64)
            free = self.number[slot] < 0
            chosen, first = np.unique(slot[free], return_index=True)
            taken = left[free][first]
            self.keys[chosen], self.number[chosen] = keys[taken], number[taken]
            left = np.setdiff1d(left, taken)
            self.probes += 1

    @staticmethod
    def _hash(name: str) -> np.uint64:
        points = np.frombuffer(name[1:].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        with np.errstate(over="ignore"):
            h = _seed(name[0], 1)
            for c in points:
                h = _fold(h, c)
        return h[0]

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        open_ones = np.arange(len(h))
        for k in range(self.probes):
            slot = ((h[open_ones] + np.uint64(k)) & self.mask).astype(np.int64)
            there = self.number[slot] >= 0
            hit = there & (self.keys[slot] == h[open_ones])
            out[open_ones[hit]] = self.number[slot[hit]]
            open_ones = open_ones[there & ~hit]
            if not len(open_ones):
                break
        return out


def build_lexicon(pieces: list[tuple[list[str], int]], langs: list[str]) -> dict[str, str]:
    """word -> feature: the language it is commonest in, and how clearly."""
    n = [Counter() for _ in langs]
    for words, y in pieces:
        n[y].update(words)
    total = [max(1, sum(c.values())) for c in n]
    out = {}
    for w in set().union(*n):
        if sum(c[w] for c in n) >= MIN_LEXICON:
            rate = np.array([c[w] / t for c, t in zip(n, total)])
            share = rate.max() / rate.sum()
            out[w] = f"l{langs[int(rate.argmax())]}{int(share * 4)}"
    return out


def forward_backward(emit: np.ndarray, start: np.ndarray, trans: np.ndarray, length: np.ndarray):
    """Marginals (chains x words x labels) and summed marginals of neighbouring pairs.

    ``emit``: log potentials; words at or beyond ``length`` are padding.
    """
    b, n, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    live = np.arange(n)[None, :] < length[:, None]
    e = np.where(live[:, :, None], e, 1.0)
    t = np.exp(trans)
    alpha, beta = np.empty((n, b, k)), np.ones((n, b, k))
    alpha[0] = np.exp(start) * e[:, 0]
    alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
    for i in range(1, n):
        a = (alpha[i - 1] @ t) * e[:, i]
        alpha[i] = np.where(live[:, i, None], a / a.sum(axis=1, keepdims=True), alpha[i - 1])
    pair = np.zeros((k, k))
    for i in range(n - 2, -1, -1):
        inner = e[:, i + 1] * beta[i + 1]
        on = live[:, i + 1]
        if on.any():
            joint = alpha[i][:, :, None] * t[None] * inner[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pair += joint[on].sum(axis=0)
        back = inner @ t.T
        beta[i] = np.where(on[:, None], back / back.sum(axis=1, keepdims=True), 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    return gamma.transpose(1, 0, 2) * live[:, :, None], pair


def marginals(emit: np.ndarray, start: np.ndarray, trans: np.ndarray, size: np.ndarray, window: int = CHAIN) -> np.ndarray:
    """Word marginals of several chains; ``emit`` holds their words one after the other, ``size`` their lengths.

    The chains are cut into windows that run side by side. The product of the potentials of a
    window carries a message from one border to the other, whatever it is, so after one
    pass over the borders every window has the messages of the one chain that it is part of.
    """
    k = emit.shape[1]
    if not len(emit):
        return np.zeros((0, k))
    per = -(-size // window)
    chain = np.repeat(np.arange(len(size)), per)
    place = np.arange(len(chain)) - np.repeat(np.cumsum(per) - per, per)
    begin = (np.cumsum(size) - size)[chain] + place * window
    length = np.minimum(window, size[chain] - place * window)
    order = np.argsort(-length, kind="stable")  # windows that end drop out at the end
    begin, length, first = begin[order], length[order], place[order] == 0
    n, b = int(length[0]), len(order)
    on = np.searchsorted(-length, -np.arange(n), side="left")  # windows longer than i
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    t = np.exp(trans - trans.max())
    tt, begin_message = np.ascontiguousarray(t.T), np.exp(start - start.max())
    came, back_in = np.empty((b, k)), np.ones((b, k))
    came[:] = begin_message
    many = per[chain[order]] > 1
    if many.any():
        at = np.nonzero(many)[0]  # stays sorted by length
        m_on = np.searchsorted(-length[at], -np.arange(n), side="left")
        p = np.repeat(np.eye(k)[None], len(at), axis=0)
        for i in range(n):
            m = m_on[i]
            x = p[:m] if i == 0 else p[:m] @ t
            if i == 0:
                x = np.where(first[at[:m], None, None], x, x @ t)
            x = x * e[begin[at[:m]] + i][:, None, :]
            p[:m] = x / x.max(axis=(1, 2), keepdims=True)
        where = np.full(b, -1, np.int64)
        where[order[at]] = np.arange(len(at))  # by original window number
        slot = np.empty(b, np.int64)
        slot[order] = np.arange(b)
        head = np.cumsum(per) - per
        long = np.nonzero(per > 1)[0]
        long = long[np.argsort(-per[long], kind="stable")]
        rounds = np.searchsorted(-per[long], -np.arange(int(per[long[0]])), side="left")
        a = np.repeat(begin_message[None], len(long), axis=0)
        for r in range(len(rounds) - 1):  # messages to the right
            m = rounds[r + 1]
            w = head[long[:m]] + r
            x = np.einsum("ij,ijk->ik", a[:m], p[where[w]])
            a[:m] = x / x.sum(axis=1, keepdims=True)
            came[slot[w + 1]] = a[:m]
        for r in range(len(rounds) - 1, 0, -1):  # and to the left
            m = rounds[r]
            w = head[long[:m]] + r
            x = np.einsum("ijk,ik->ij", p[where[w]], back_in[slot[w]])
            back_in[slot[w - 1]] = x / x.sum(axis=1, keepdims=True)
    alpha = np.zeros((n, b, k))
    ahead = np.where(first[:, None], came, came @ t)
    for i in range(n):
        m = on[i]
        a = (ahead if i == 0 else alpha[i - 1, :m] @ t) * e[begin[:m] + i]
        alpha[i, :m] = a / a.sum(axis=1, keepdims=True)
    out = np.empty((len(emit), k))
    beta = back_in
    for i in range(n - 1, -1, -1):
        m = on[i]
        if i + 1 < n:
            q = on[i + 1]
            back = (e[begin[:q] + i + 1] * beta[:q]) @ tt
            beta[:q] = back / back.sum(axis=1, keepdims=True)
        g = alpha[i, :m] * beta[:m]
        out[begin[:m] + i] = g / g.sum(axis=1, keepdims=True)
    return out


def train(pieces: list[tuple[list[str], int]], langs: list[str], *, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Fit the field on pieces (words, label); chains join one to three pieces."""
    rng = np.random.default_rng(seed)
    lexicon = build_lexicon(pieces, langs)
    k = len(langs)
    seen = Counter(f for words, _ in pieces for w in words for f in word_features(w, lexicon))
    features = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= MIN_FEATURE))}
    memo: dict[str, np.ndarray] = {}

    def of(word):
        if word not in memo:
            memo[word] = np.array([features[f] for f in word_features(word, lexicon) if f in features], np.int64)
        return memo[word]

    w, start, trans = np.zeros((len(features) + 1, k)), np.zeros(k), np.zeros((k, k))
    sq = [np.full_like(w, 1e-6), np.full(k, 1e-6), np.full((k, k), 1e-6)]
    by = [[p for p in pieces if p[1] == y] for y in range(k)]
    for _ in range(epochs):
        order, chains, at = rng.permutation(len(pieces)), [], 0
        while at < len(order):
            n = int(rng.integers(1, 4))
            if n == 1:
                chains.append([pieces[order[at]]])
            else:  # a switch: pieces of languages drawn evenly
                others = [by[int(y)] for y in rng.integers(0, k, n - 1)]
                extra = [o[int(rng.integers(0, len(o)))] for o in others if o]
                chains.append([pieces[order[at]], *extra])
            at += 1
        for a in range(0, len(chains), 128):
            group = chains[a : a + 128]
            words = [[x for p in c for x in p[0]] for c in group]
            gold = [np.concatenate([np.full(len(p[0]), p[1]) for p in c]) for c in group]
            length = np.array([len(x) for x in words])
            b, n = len(group), int(length.max())
            lists = [of(x) for c in words for x in c]
            sizes = np.array([len(x) for x in lists])
            cols = np.concatenate(lists)
            flat_row = np.repeat(np.arange(len(lists)), sizes)
            emit_flat = np.stack([np.bincount(flat_row, w[cols, j], len(lists)) for j in range(k)], axis=1)
            live = np.arange(n)[None, :] < length[:, None]
            emit = np.zeros((b, n, k))
            emit[live] = emit_flat
            gamma, pair = forward_backward(emit, start, trans, length)
            y = np.concatenate(gold)
            err = gamma[live]
            err[np.arange(len(y)), y] -= 1.0
            gw = np.stack([np.bincount(cols, err[flat_row, j], len(w)) for j in range(k)], axis=1) / b + 1e-4 * w
            first = gamma[:, 0].copy()
            first[np.arange(b), [g[0] for g in gold]] -= 1.0
            gt = pair.copy()
            for g in gold:
                np.add.at(gt, (g[:-1], g[1:]), -1.0)
            for x, g, s, rate in ((w, gw, sq[0], 0.2), (start, first.sum(axis=0) / b, sq[1], 0.1), (trans, gt / b + 1e-3 * trans, sq[2], 0.1)):
                s += g * g
                x -= rate * g / np.sqrt(s)
    return {"langs": langs, "features": features, "weights": w.astype(np.float32), "start": start, "trans": trans, "lexicon": lexicon}


class Labeller:
    def __init__(self, model: dict):
        self.m, self.k = model, len(model["langs"])
        names = [""] * len(model["features"])
        for x, i in model["features"].items():
            names[i] = x
        self.table = FeatureTable(names)

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log potentials, whether any feature is known) of distinct words."""
        f, lex, w = self.m["features"], self.m["lexicon"], self.m["weights"]
        row, h = feature_hashes(words)
        col = self.table.find(h)
        row, col = row[col >= 0], col[col >= 0]
        known = [(i, f[lex[x]]) for i, x in enumerate(words) if x in lex and lex[x] in f]
        if known:
            r, c = np.array(known, np.int64).T
            row, col = np.concatenate([row, r]), np.concatenate([col, c])
        emit = np.stack([np.bincount(row, w[col, j], len(words)) for j in range(self.k)], axis=1)
        return emit, np.bincount(row, minlength=len(words)) > 0

    def _words(self, texts: list[str]):
        found = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
        n = np.array([len(x) for x in found], np.int64)
        if not self.k or not n.sum():
            z = int(n.sum())
            return found, n, np.zeros((z, self.k)), np.zeros(z), np.zeros(z, bool)
        told = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
        words = told.dictionary.to_pylist()
        at = told.indices.to_numpy()
        emit, known = self.emissions(words)
        p = marginals(emit[at], self.m["start"], self.m["trans"], n[n > 0])
        return found, n, p, np.fromiter(map(len, words), np.float64, len(words))[at], known[at]

    def words(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """(words per text, number of words per text, marginals of all words in order)."""
        return self._words(texts)[:3]

    def texts(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, share of letters in words that the model knows a feature of) per text."""
        if not self.k:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        _, n, p, letters, known = self._words(texts)
        text = np.repeat(np.arange(len(n)), n)
        mass = np.stack([np.bincount(text, p[:, j] * letters, len(n)) for j in range(self.k)], axis=1)
        best, total = mass.argmax(axis=1), mass.sum(axis=1)
        some = np.where(total > 0, total, 1.0)
        score = np.where(n > 0, mass.max(axis=1) / some, 0.0)
        share = np.bincount(text, letters * known, len(n)) / some
        return [self.m["langs"][b] if c else "und" for b, c in zip(best, n)], np.clip(score, 0.0, 1.0), share


def fit(docs: DataFrame, *, per_lang: int = PER_LANG, seed: int = SEED) -> dict:
    """Train on a bounded sample of the training fold (crc32 mod 3 is not 1)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("id is not null and text is not null and lang is not null").where(fold("id", 3) != 1)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return {"langs": [], "features": {}, "weights": np.zeros((1, 0), np.float32), "start": np.zeros(0), "trans": np.zeros((0, 0)), "lexicon": {}}
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_lang / n)))])
    some = rows.where(F.xxhash64("id", F.lit(seed)) / F.lit(2.0**64) + 0.5 < share[F.col("lang")]).select("text", "lang")

    def cut(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                out, langs = [], []
                for t, lang in zip(texts, part.column("lang").to_pylist()):
                    words = _LETTERS.findall(t.lower())
                    for a in range(0, len(words), PIECE_WORDS):
                        out.append(words[a : a + PIECE_WORDS])
                        langs.append(lang)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), pa.array(langs, pa.string())], names=["words", "lang"])

    got = some.mapInArrow(cut, "words array<string>, lang string").toArrow().to_pydict()
    langs = sorted(counts)
    index = {lang: i for i, lang in enumerate(langs)}
    pieces = sorted((w, index[lang]) for w, lang in zip(got["words"], got["lang"]) if w)
    return train(pieces, langs, seed=seed)


_LABELLER: tuple | None = None


def _labeller(shared) -> Labeller:
    """One per worker and model: words of earlier batches stay known."""
    global _LABELLER
    if _LABELLER is None or _LABELLER[0] != shared.value["id"]:
        _LABELLER = (shared.value["id"], Labeller(shared.value))
    return _LABELLER[1]


def share_model(spark: SparkSession, model: dict):
    """The model as a broadcast; its size is bounded by the training sample."""
    ident = xxhash.xxh3_64_intdigest(model["weights"].tobytes() + model["trans"].tobytes())
    return spark.sparkContext.broadcast(model | {"id": ident})


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    shared = share_model(docs.sparkSession, model)

    chars = SLICE_CHARS

    def run(batches):
        labeller = _labeller(shared)
        for batch in batches:
            for part, texts in text_slices(batch, chars=chars):
                langs, score, _ = labeller.texts(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def word_languages(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, pos, word, lang, prob``: every word of every text with its label (code-switching)."""
    shared = share_model(docs.sparkSession, model)

    chars = SLICE_CHARS

    def run(batches):
        labeller = _labeller(shared)
        for batch in batches:
            for part, texts in text_slices(batch, chars=chars):
                found, n, p = labeller.words(texts)
                ids = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n)))
                pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                lang = [labeller.m["langs"][j] for j in p.argmax(axis=1)] if labeller.k else ["und"] * int(n.sum())
                prob = p.max(axis=1) if labeller.k else np.zeros(int(n.sum()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(pos), pa.array([w for x in found for w in x], pa.string()), pa.array(lang, pa.string()), pa.array(prob)], names=["doc_id", "pos", "word", "lang", "prob"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, pos bigint, word string, lang string, prob double")


def keep_known(docs: DataFrame, model: dict, known: float = KNOWN) -> DataFrame:
    """``docs`` without rows of no language (``und``) or of none that the model knows.

    The evidence is the share of a text's letters in words that have any feature of the
    model; it doesn't depend on the number of languages, and texts that switch between
    known ones stay. Where nothing could be learned, all rows stay.
    """
    if not model["langs"]:
        return docs
    shared = share_model(docs.sparkSession, model)

    chars = SLICE_CHARS

    def run(batches):
        labeller = _labeller(shared)
        for batch in batches:
            for part, texts in text_slices(batch, chars=chars):
                langs, _, share = labeller.texts(texts)
                yield part.filter(pa.array((np.array(langs) != "und") & (share >= known)))

    return docs.mapInArrow(run, docs.schema)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
