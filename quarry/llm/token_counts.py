"""Operator 12: token counts by a two-tier lookup of pre-token lengths, without any shuffle.

A byte-level BPE tokenizer cuts a text into pre-tokens and merges within each one, so the
token count of a text is the sum of its pre-tokens' lengths in tokens.

* Tier one: the lengths of the commonest pre-tokens, a compact table (one text of all keys, one
  byte for each key's size and one for its tokens) that is broadcast; a worker opens it as a hash table once. It is filled
  from a bounded look at the corpus: at most ``SAMPLE_PARTS`` partitions count the pre-tokens of
  their first ``SAMPLE_ROWS`` rows and hand on the ``PER_PART`` commonest, of which ``FREQUENT`` stay.
  It decides how fast a count is found, never what is counted.
* Tier two: what the first lacks is encoded by the library, all misses of a slice of texts in
  one call, and remembered in a cache of the worker, bounded in keys and in characters.

No pre-token ever leaves its task. Where the library's Unicode tables class a code point
otherwise than the pattern here does (found out by asking the library about every code point
while the job is planned), the stretch of text around it goes to the library whole; stretches end where
a blank stands between two ASCII letters, a place that no pre-token crosses.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a special token's string inside
a text is one token, as the library has it by default; repeated rows and rows of null
``doc_id`` are returned each; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_slices

LIMIT = 1024
FREQUENT, PER_PART = 65_536, 16_384
SAMPLE_PARTS, SAMPLE_ROWS = 32, 128
#: bounds of a worker's cache; longer pre-tokens are encoded each time they come
CACHE_KEYS, CACHE_KEY_CHARS = 400_000, 64

#: the byte-level pre-tokenizer's pattern (fixed by the tokenizer file)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECE = regex.compile(PATTERN)
_WIDE = re.compile(r"[^\x00-\x7f]+")
_SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
#: the classes that the pattern tells apart, each with one member
_CLASSES = ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\n"), (r"[^\s\p{L}\p{N}]", "!"))
_OPEN: dict = {}


def odd_points(tokenizer) -> str:
    """Code points that the library's tables class otherwise than the pattern here.

    A run of code points of one class is one pre-token; where the library cuts it, its tables
    differ, and each piece of the cut is of one class there: it either joins a known member
    of the class or is odd as a whole.
    """

    def cut(text):
        return [text[a:z] for _, (a, z) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    every = "".join(chr(p) for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000)
    odd = []
    for pattern, member in _CLASSES:
        run = "".join(regex.findall(f"{pattern}+", every))
        for a in range(0, len(run), 8192):
            odd += [x for x in cut(run[a : a + 8192]) if len(cut(member + x)) > 1]
    return "".join(sorted("".join(odd)))


def _load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _byte_level(tokenizer) -> bool:
    """Whether the file is of the kind whose pre-tokens are counted one by one."""
    import json

    spec = json.loads(tokenizer.to_str())
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = all(not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) for a in spec["added_tokens"])
    return (
        plain and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        and model["type"] == "BPE" and not model.get("dropout")
    )


def _library(tokenizer, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Counts:
    """Token counts of texts: the broadcast tier, the worker's cache, then the library."""

    def __init__(self, path: str, plan: dict):
        self.tokenizer = _load(path)
        ends = list(accumulate(plan["sizes"]))
        self.keys = [plan["keys"][z - n : z] for z, n in zip(ends, plan["sizes"])]
        self.lengths: dict[str, int] = dict(zip(self.keys, plan["lengths"]))
        self.frequent = len(self.lengths)
        self.special = re.compile("|".join(map(re.escape, plan["special"]))) if plan["special"] else None
        self.odd = frozenset(plan["odd"])

    def _forget(self) -> None:
        """Back to the first tier once the cache is full."""
        self.lengths = {k: self.lengths[k] for k in self.keys}

    def _odd_in(self, text: str) -> bool:
        return not (text.isascii() or self.odd.isdisjoint("".join(_WIDE.findall(text))))

    def _split(self, text: str) -> tuple[list[str], list[str], int]:
        """(pre-tokens, stretches for the library, special tokens) of a text."""
        if self.special is None:
            parts, specials = [text], 0
        else:
            parts = self.special.split(text)
            specials = len(parts) - 1
        if not self._odd_in(text):
            return [x for p in parts for x in _PIECE.findall(p)] if specials else _PIECE.findall(text), [], specials
        pieces, whole = [], []
        for p in parts:
            for stretch in _SAFE.split(p):
                if self._odd_in(stretch):
                    whole.append(stretch)
                else:
                    pieces.extend(_PIECE.findall(stretch))
        return pieces, whole, specials

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.lengths) - self.frequent > CACHE_KEYS:
            self._forget()
        known = self.lengths
        split = [self._split(t) if t else ([], [], 0) for t in texts]
        misses = set()
        for pieces, _, _ in split:
            misses.update(pieces)
        misses.difference_update(known)
        long = {}
        new = sorted(misses)
        for x, n in zip(new, _library(self.tokenizer, new)):
            (known if len(x) <= CACHE_KEY_CHARS else long)[x] = n
        if long:
            of = lambda x: known[x] if x in known else long[x]
        else:
            of = known.__getitem__
        return [sum(map(of, pieces)) + specials + (sum(_library(self.tokenizer, whole)) if whole else 0) for pieces, whole, specials in split]


class WholeCounts:
    """Token counts by the library alone, for tokenizers of another kind."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.of = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            tokenizer = _load(path)
            self.of = lambda texts: _library(tokenizer, texts)

    def count(self, texts: list[str | None]) -> list[int]:
        return self.of([t or "" for t in texts])


def _opened(path: str, plan: dict | None):
    """One per worker process: later tasks know the pre-tokens of earlier ones."""
    key = (path, None if plan is None else plan["name"])
    if key not in _OPEN:
        _OPEN[key] = WholeCounts(path) if plan is None else Counts(path, plan)
    return _OPEN[key]


def frequent(docs: DataFrame, *, text: str = "text", parts: int = SAMPLE_PARTS, rows: int = SAMPLE_ROWS, keep: int = FREQUENT) -> list[str]:
    """The commonest pre-tokens in a bounded look: the first ``rows`` rows of at most ``parts`` partitions.

    Each of these hands on a list of bounded length, the others nothing; the lists are merged
    on the driver (at most ``parts * PER_PART`` short strings).
    """
    some = docs.select(F.col(text).cast("string").alias("text"))
    step = max(1, -(-some.rdd.getNumPartitions() // parts))

    def look(batches):
        from pyspark import TaskContext

        if TaskContext.get().partitionId() % step:
            return
        seen, left = Counter(), rows
        for b in batches:
            for part, texts in text_slices(b.slice(0, left)):
                for t in texts:
                    seen.update(_PIECE.findall(t or ""))
                if len(seen) > 20 * PER_PART:
                    seen = Counter(dict(seen.most_common(2 * PER_PART)))
            left -= min(left, b.num_rows)
            if not left:
                break
        best = [(x, n) for x, n in seen.most_common(PER_PART) if len(x) <= CACHE_KEY_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["x", "n"])

    total = Counter()
    for r in some.mapInArrow(look, "x string, n bigint").toLocalIterator():
        total[r["x"]] += r["n"]
    return [x for x, _ in sorted(total.items(), key=lambda e: (-e[1], e[0]))[:keep]]


def plan_counts(docs: DataFrame, path: str, **look) -> dict | None:
    """What is broadcast: the first tier, special strings, odd code points; None for tokenizers
    that don't count by pre-tokens."""
    if path.endswith(".model"):
        return None
    tokenizer = _load(path)
    if not _byte_level(tokenizer):
        return None
    keys = frequent(docs, **look)
    odd = set(odd_points(tokenizer))
    keys = [k for k in keys if odd.isdisjoint(k)]
    counted = [(k, n) for k, n in zip(keys, _library(tokenizer, keys)) if n < 256]
    special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    return {
        "name": hash((path, tuple(counted))),
        "keys": "".join(k for k, _ in counted),
        "sizes": bytes(len(k) for k, _ in counted),
        "lengths": bytes(n for _, n in counted),
        "special": special,
        "odd": "".join(sorted(odd)),
    }


def count_tokens(docs: DataFrame, path: str, *, limit: int = LIMIT, plan: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``; map only."""
    if plan is None:
        plan = plan_counts(docs, path, text=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(plan)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        counter = _opened(path, sent.value)
        for batch in batches:
            for b, texts in text_slices(batch):
                n = np.array(counter.count(texts), np.int64)
                size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
