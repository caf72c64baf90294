"""Token counts and clipping by byte-level BPE (P7, P8), with the merges run once per distinct word.

A text is cut into words by the vocabulary's pattern (a JVM regex); the words put together are the
text. The distinct words become a table ``(word, rows, n, ends)`` on which the ranked merges run,
whatever the number of texts. Counts and cut positions come from joining that table back:
frequent words by broadcast (bounded: ``FREQUENT`` words of at most ``SHORT`` bytes) right behind the
explode, the others by a join on the word. So no hot word is ever shuffled. A count names a long word by
its digest, so that it may be among the frequent ones.

Texts are told apart by 16 bytes of their SHA-256, so rows need no id, equal rows are worked on once where that
saves a shuffle, and other columns may have any name but the new one. A null text has a
null result, an empty one no tokens. Java's tables of letters and digits decide the words:
code points that its Unicode version does not know yet count as neither.
"""

from __future__ import annotations

import base64
import heapq
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: words of the broadcast tier; they only decide how a length is found, not which
FREQUENT = 100_000
SHORT = 64
#: words that are summed up together on the way to a cut
STRETCH = 32
#: a rank file is broadcast whole, so its size is checked
MAX_RANK_BYTES = 64 << 20

_WORDS = "word string, rows bigint, n int, ends array<struct<chars:int,broken:boolean>>"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base64 and its rank on each line."""
    if os.path.getsize(path) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is too large to be sent to every worker")
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Where the tokens of a word end: the neighbours of lowest rank merge first, the leftmost of equals.

    A word that is a token itself stays whole. A heap of pairs and links between neighbours make
    this n log n for a word of n bytes.
    """
    n = len(word)
    if n < 2 or word in ranks:
        return [n] if n else []
    after, before, starts = list(range(1, n + 1)), list(range(-1, n)), bytearray([1]) * n
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, j = heapq.heappop(heap)
        mid = after[i]
        if not starts[i] or mid >= n or after[mid] != j:
            continue  # one of the two has merged with another since
        starts[mid], after[i], before[j] = 0, j, i
        for a, b in ((i, after[j] if j < n else None), (before[i], j)):
            if b is not None and a >= 0 and word[a:b] in ranks:
                heapq.heappush(heap, (ranks[word[a:b]], a, b))
    return [after[i] for i in range(n) if starts[i]]


def _cuts(word: str, ranks: dict[bytes, int]) -> list[dict]:
    """Per token: the whole characters up to its end, and whether it ends inside the next one."""
    data = word.encode("utf-8")
    out, at, chars = [], 0, 0
    for end in merged(data, ranks):
        chars += sum((b & 0xC0) != 0x80 for b in data[at:end])  # characters that begin in the token
        broken = end < len(data) and (data[end] & 0xC0) == 0x80
        out.append({"chars": chars - broken, "broken": broken})
        at = end
    return out


def _words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))


def word_table(words: DataFrame, ranks_path: str) -> DataFrame:
    """``words(word)``, one row per occurrence → ``(word, rows, n, ends)``, written to the shared folder.

    ``n`` is the number of tokens, ``ends`` where each of them ends.
    """
    spark = words.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    ends = pa.list_(pa.struct([("chars", pa.int32()), ("broken", pa.bool_())]))

    def encode(batches):
        for b in batches:
            cuts = [_cuts(w, ranks.value) for w in b.column("word").to_pylist()]
            n = pa.array([len(c) for c in cuts], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("rows"), n, pa.array(cuts, ends)], names=["word", "rows", "n", "ends"])

    path = scratch_path(spark, "bpe-words")
    counted = words.where(F.col("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
    counted.mapInArrow(encode, _WORDS).write.parquet(path)
    return spark.read.schema(_WORDS).parquet(path)


def _name(word: Column) -> Column:
    """A word of at most ``SHORT`` bytes, or the digest of a longer one (65 bytes, so never a short word)."""
    return F.when(F.octet_length(word) <= SHORT, word).when(word.isNotNull(), F.concat(F.sha2(word, 256), F.lit("#")))


def _digest(text: Column) -> Column:
    """16 bytes of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _tiers(table: DataFrame, by: str = "word") -> tuple[DataFrame, DataFrame]:
    """The most frequent names of at most ``SHORT`` + 1 bytes (``FREQUENT`` or fewer), and all others."""
    short = F.octet_length(by) <= SHORT + 1
    top = table.where(short).select("rows").orderBy(F.desc("rows")).limit(FREQUENT).agg(F.count("rows").alias("c"), F.min("rows").alias("m")).first()
    often = short & (F.col("rows") > (top["m"] if top["c"] == FREQUENT else 0))
    return table.where(often).drop("rows"), table.where(~often).drop("rows")


def add_token_counts(
    df: DataFrame, ranks_path: str, *, pattern: str, text_col: str = "text", out_col: str = "tokens"
) -> DataFrame:
    """Add ``out_col``, the number of BPE tokens of a text (no special tokens)."""
    text, key = F.col(text_col), _fresh()
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "bpe-texts")
    df.where(text.isNotNull()).select(_digest(text).alias("key"), _words(text, pattern).alias("words")).write.parquet(path)
    texts = spark.read.schema("key binary, words array<string>").parquet(path)
    table = word_table(texts.select(F.explode("words").alias("word")), ranks_path)
    often, rare = _tiers(table.select(_name(F.col("word")).alias("name"), "rows", "n"), by="name")
    # a null stands for the row itself: equal texts add up, and are divided by their number
    every = texts.select("key", F.explode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("word"))
    tagged = every.select("key", _name(F.col("word")).alias("name")).join(F.broadcast(often), "name", "left")
    known = tagged.groupBy("key").agg(F.sum("n").alias("known"), F.count(F.when(F.col("name").isNull(), 1)).alias("copies"))
    others = tagged.where(F.col("name").isNotNull() & F.col("n").isNull()).select("key", "name").join(rare, "name").groupBy("key").agg(F.sum("n").alias("others"))
    counts = known.join(others, "key", "left").select(F.col("key").alias(key), F.expr("(coalesce(known, 0) + coalesce(others, 0)) div copies").alias(out_col))
    return _joined(df, text, key, counts)


def clip_to_tokens(
    df: DataFrame, ranks_path: str, max_tokens: int, *, pattern: str, text_col: str = "text", out_col: str = "clipped"
) -> DataFrame:
    """Add ``out_col``, the first ``max_tokens`` tokens of a longer text, or the text as it is.

    The cut falls behind a token; where that is inside a character, U+FFFD stands for the part
    that is kept, as in decoding those tokens.

    A word has a token or more and a token a byte or more, so texts of at most ``max_tokens`` bytes
    are never looked at, nor is any word beyond the first ``max_tokens`` of a text.
    """
    if max_tokens < 1:
        raise ValueError("max_tokens must be positive")
    text, key = F.col(text_col), _fresh()
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "bpe-first")
    long = df.where(F.octet_length(text) > max_tokens).select(_digest(text).alias("key"), _words(text, pattern).alias("words"))
    long.select("key", F.size("words").alias("n_words"), F.slice("words", 1, max_tokens).alias("words")).write.parquet(path)
    texts = spark.read.schema("key binary, n_words int, words array<string>").parquet(path)
    table = word_table(texts.select(F.explode("words").alias("word")), ranks_path)
    often, rare = _tiers(table)

    # tokens and characters per stretch of words; equal texts add up, and are divided by their number
    every = texts.select("key", F.posexplode("words").alias("pos", "word"))
    hit = every.join(F.broadcast(often.select("word", "n")), "word", "left")
    rest = hit.where(F.col("n").isNull()).drop("n").join(rare.select("word", "n"), "word")
    both = hit.where(F.col("n").isNotNull()).unionByName(rest)
    parts = both.groupBy("key", (F.col("pos") / STRETCH).cast("int").alias("part")).agg(
        F.sum("n").alias("tokens"), F.sum(F.length("word")).alias("chars"), F.count_if(F.col("pos") % STRETCH == 0).alias("copies")
    )
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "part", F.expr("tokens div copies").alias("tokens"), F.expr("chars div copies").alias("chars"))
    for c in ("tokens", "chars"):
        parts = parts.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(before), F.lit(0)))
    parts = parts.where((F.col("tokens_before") < max_tokens) & (F.col("tokens_before") + F.col("tokens") >= max_tokens)).drop("tokens", "chars")

    # the words of the stretch that holds the last token, one row per text
    start = F.col("part") * STRETCH
    found = texts.join(parts, "key").select("key", F.struct("n_words", start.alias("start"), "tokens_before", "chars_before", F.slice("words", start + 1, STRETCH).alias("words")).alias("s"))
    found = found.groupBy("key").agg(F.first("s").alias("s")).select("key", "s.n_words", "s.start", "s.tokens_before", "s.chars_before", F.posexplode("s.words").alias("i", "word"))
    found = found.withColumn("pos", F.col("start") + F.col("i"))
    hit = found.join(F.broadcast(often), "word", "left")
    found = hit.where(F.col("n").isNotNull()).unionByName(hit.where(F.col("n").isNull()).drop("n", "ends").join(rare, "word"), allowMissingColumns=True)
    upto = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("tokens", F.col("tokens_before") + F.sum("n").over(upto)).withColumn("chars", F.col("chars_before") + F.sum(F.length("word")).over(upto))
    left = F.lit(max_tokens) - (F.col("tokens") - F.col("n"))  # tokens that this word may still keep
    here = (left >= 1) & (F.col("tokens") >= max_tokens) & ((F.col("tokens") > max_tokens) | (F.col("pos") + 1 < F.col("n_words")))
    end = F.element_at("ends", left.cast("int"))
    cut = found.where(here).select(
        F.col("key").alias(key), F.struct((F.col("chars") - F.length("word") + end["chars"]).cast("int").alias("chars"), end["broken"].alias("broken")).alias(out_col)
    )
    out = _joined(df, text, key, cut)
    mark = F.when(F.col(out_col)["broken"], F.lit("\ufffd")).otherwise("")
    kept = F.when(F.col(out_col).isNotNull(), F.concat(F.substring(text, F.lit(1), F.col(out_col)["chars"]), mark)).otherwise(text)
    return out.withColumn(out_col, kept)


def clipper(ranks_path: str, *, pattern: str):
    """P8 in place: ``clip(df, col, max_tokens)`` for ``plans.index.vector_tables``."""

    def clip(df: DataFrame, col: str, max_tokens: int) -> DataFrame:
        out = _fresh()
        return clip_to_tokens(df, ranks_path, max_tokens, pattern=pattern, text_col=col, out_col=out).withColumn(col, F.col(out)).drop(out)

    return clip


def _fresh() -> str:
    return f"_key_{uuid.uuid4().hex[:8]}"


def _joined(df: DataFrame, text: Column, key: str, found: DataFrame) -> DataFrame:
    clash = set(found.columns) & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    return df.withColumn(key, _digest(text)).join(found, key, "left").drop(key)
