"""Operator 9: token ids as Parquet list columns.

``write_tokens`` range-partitions the documents by id, sorts each partition, encodes the
whole texts with the ``tokenizers`` library and writes one row per document
(``doc_id``, ``part``, ``local_start``, ``n_tokens``, ``tokens``). The writer's settings are
parameters: row-group size, page size and rows per page, and the encoding of the ids
(``dictionary``, or ``delta``: DELTA_BINARY_PACKED of the version-2 pages). Parquet keeps
column and offset indexes per page, rows are in ascending ``doc_id`` order, so

* ``read_metadata`` touches only the small columns,
* ``read_tokens(ids=(lo, hi))`` reads only the pages whose ``doc_id`` range matches.

The position of a document (``start``: ids of all documents before it) is the running
count inside its file plus the total of the files before it; only one row per file is
summed in order.

Defined cases: a null text is encoded as the empty text (just the end id); an empty table
gives empty files; null ``doc_id`` sorts first; rows with an equal ``doc_id`` are ordered by a
hash of their text; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parallelism, read, scratch_path, text_slices
from .runs import RunEncoder

END_ID = 2
#: distinct chunks and words kept per worker
MEMO_CHUNKS = 1_000_000
MEMO_WORDS = 300_000
WRITTEN = "doc_id bigint, part int, local_start bigint, n_tokens int, tokens array<int>"

#: the pre-tokenizer's pattern (fixed by the tokenizer file), applied to lower case
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_TOKENIZERS: dict = {}


class ChunkEncoder(RunEncoder):
    """Encodes texts chunk by chunk, between blanks and line feeds.

    The pre-tokenizer never joins text across a blank or a line feed, and neither the
    normaliser nor an added token looks past one, so the ids of a text are those of its
    chunks. New chunks fall into words by the pre-tokenizer's own pattern; the library
    encodes the words not seen before in one call, and the end-of-word ids tell them apart.
    Chunks whose lower case or composed form could depend on more than that (not in
    composed form, capital sigma, dotted capital i, added tokens) go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.last[i] = piece.endswith("</w>")
        self.words: dict[str, bytes] = {}
        super().__init__(MEMO_CHUNKS)

    def prepare(self, text: str) -> str:
        return text.replace("\n", " ")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def ids_of(self, runs: list[str]) -> list[bytes]:
        find, composed = _PIECE.findall, unicodedata.is_normalized
        pieces = [find(c.lower()) if "<|" not in c and (c.isascii() or (composed("NFC", c) and "\u03a3" not in c and "\u0130" not in c)) else None for c in runs]
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        words = self.words
        new = list(set(chain.from_iterable(filter(None, pieces))).difference(words))
        for a in range(0, len(new), 20_000):
            block = new[a : a + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.nonzero(self.last[ids])[0] + 1
            if len(ends) == len(block) and ends[-1] == len(ids):
                flat, ends = ids.tobytes(), (4 * ends).tolist()
                words.update((w, flat[x:z]) for w, x, z in zip(block, [0, *ends], ends))
            else:
                words.update(zip(block, self._whole(block)))
        odd = iter(self._whole([c for c, p in zip(runs, pieces) if p is None]))
        of = words.__getitem__
        return [next(odd) if p is None else of(p[0]) if len(p) == 1 else b"".join(map(of, p)) for p in pieces]


def encoder(path: str) -> ChunkEncoder:
    """One per worker process: later tasks know the words of earlier ones."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkEncoder(path)
    return _TOKENIZERS[path]


def _with_end(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(n), end_id), n + 1


def _encoder(path: str, end_id: int):
    def encode(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        enc = encoder(path)
        for batch in batches:
            for b, texts in text_slices(batch):
                ids, n = _with_end(*enc.encode([t or "" for t in texts]), end_id)
                offsets = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        pa.array(np.full(len(n), part, np.int32)),
                        pa.array(seen + offsets[:-1]),
                        pa.array(n.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                    ],
                    names=["doc_id", "part", "local_start", "n_tokens", "tokens"],
                )
                seen += int(offsets[-1])

    return encode


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    end_id: int = END_ID,
    encoding: str = "dictionary",
    row_group_mb: int = 64,
    page_kb: int = 256,
    page_rows: int = 2000,
    partitions: int | None = None,
) -> None:
    """Encode ``docs(doc_id, text)`` and write the token files in ascending ``doc_id`` order."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be dictionary or delta, not {encoding!r}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(partitions or parallelism(docs.sparkSession), F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    (
        rows.mapInArrow(_encoder(tokenizer, end_id), WRITTEN)
        .write.option("compression", "zstd")
        .option("parquet.block.size", row_group_mb << 20)
        .option("parquet.page.size", page_kb << 10)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "v1" if encoding == "dictionary" else "v2")
        .parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, part, local_start, n_tokens, start`` without reading a token page."""
    meta = spark.read.schema(WRITTEN).parquet(path).select("doc_id", "part", "local_start", "n_tokens")
    files = meta.groupBy("part").agg(F.sum("n_tokens").alias("__ids"))
    before = F.coalesce(F.sum("__ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("part", before.alias("__before"))  # one row per file
    return meta.join(F.broadcast(files), "part").withColumn("start", F.col("__before") + F.col("local_start")).drop("__before")


def read_tokens(spark: SparkSession, path: str, ids: tuple[int, int] | None = None) -> DataFrame:
    """``doc_id, tokens``; ``ids=(lo, hi)`` reads only pages that hold ``lo <= doc_id < hi``."""
    df = spark.read.schema(WRITTEN).parquet(path)
    if ids is not None:
        df = df.where((F.col("doc_id") >= ids[0]) & (F.col("doc_id") < ids[1]))
    return df.select("doc_id", "tokens")


def _crc(batches):
    for b in batches:
        tokens = b.column("tokens")
        flat, off = tokens.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.asarray(tokens.offsets)
        off = off - off[0]
        crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(off[:-1], off[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("part"), b.column("local_start"), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
        )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: ``doc_id, start, n_tokens, ids_crc32``."""
    df = spark.read.schema(WRITTEN).parquet(path)
    crc = df.select("doc_id", "part", "local_start", "tokens").mapInArrow(_crc, "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    files = df.groupBy("part").agg(F.sum("n_tokens").alias("__ids"))
    before = F.coalesce(F.sum("__ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("part", before.alias("__before"))
    return crc.join(F.broadcast(files), "part").select("doc_id", (F.col("__before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_digest(spark, path)
