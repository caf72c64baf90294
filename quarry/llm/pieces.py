"""Operator 8: SentencePiece encoding and decoding by a weighted finite-state transducer.

``compile_model`` turns a model file into three machines over characters:

* the normaliser (blank to U+2581, a U+2581 in front of the text),
* the pieces: an arc reads the characters of a piece and writes its id,
* the byte fallback: an arc reads one character without a piece and writes its bytes' ids.

Composed with a text they give a lattice over its positions; the encoding is its shortest
path in the tropical semiring (weights add along a path, the smaller one wins). In a
unigram model an arc weighs minus the piece's score. A BPE model has no weight per piece
that would give its merges, so there the machine remembers the last piece, and going on
with a piece costs nothing or, if the merges would not leave the two side by side,
infinity. A sequence of pieces is the result of the merges exactly if every two neighbours
are the result of the merges of their own text: merges cross a border in the whole text if
and only if they do so in the text of the two pieces next to it. So exactly one path of a
BPE lattice is finite, and every prefix has one finite path of its own, which is all the
shortest-path search needs to keep.

No piece reads a U+2581 after another character, and none of several characters reads a
line feed; texts are therefore composed run by run between such places, and the paths of
runs seen before are kept in a bounded memo.

Defined cases: a null text has null ids in ``encode`` and counts as the empty text in the
query; an empty text has no ids; U+2581 in a text decodes to a blank; ids that are no
pieces decode to nothing, bytes that are no UTF-8 to U+FFFD; repeated rows are encoded each;
further columns are kept by ``encode``.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, text_slices
from .runs import RunEncoder

SPACE = "▁"
MEMO_RUNS = 600_000
MEMO_PAIRS = 250_000
_RUN = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
INF = float("inf")


class Transducer(RunEncoder):
    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser with escaped blanks is compiled")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.bpe = kind == 2
        types = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.text: dict[str, int] = {}
        self.score: list[float] = []
        self.byte_id = [0] * 256
        self.out: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            self.score.append(p.score)
            if types.is_byte(i):
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.out.append(bytes([int(p.piece[3:5], 16)]))
            elif types.is_unknown(i) or types.is_control(i) or types.is_unused(i):
                self.out.append(b"")
            else:
                self.text[p.piece] = i
                self.out.append(p.piece.replace(SPACE, " ").encode())
        self.unknown = 10.0 - min(self.score[i] for i in self.text.values())
        # the pieces as a tree of characters; under "" the piece that ends there
        self.tree: dict = {}
        for p in self.text:
            node = self.tree
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.by_blank = bool(self.prefix) and not any(SPACE in p.lstrip(SPACE) for p in self.text) and not any("\n" in p and len(p) > 1 for p in self.text)
        self.beside: dict[tuple[str, str], bool] = {}
        self.id_bytes = {p: np.int32(i).tobytes() for p, i in self.text.items()}
        self.byte_ids = [np.int32(i).tobytes() for i in self.byte_id]
        size = np.array([len(x) for x in self.out], np.int64)
        self.out_flat, self.out_size, self.out_begin = np.frombuffer(b"".join(self.out), np.uint8), size, np.cumsum(size) - size
        super().__init__(MEMO_RUNS)

    def normalise(self, text: str) -> str:
        return (self.prefix + text.replace(" ", SPACE)) if text else ""

    def merges(self, text: str) -> list[str]:
        """The merges of a (short) text: best score first, leftmost on ties."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                j = self.text.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.score[j] > best[0]):
                    best = (self.score[j], i)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]

    def _side_by_side(self, a: str, b: str) -> bool:
        if len(self.beside) > MEMO_PAIRS:
            self.beside.clear()
        ok = self.beside[a, b] = self.merges(a + b) == ([a, b] if a else [b])
        return ok

    def shortest_path(self, text: str) -> list[str]:
        """Pieces (or characters without one) on the shortest path through the lattice."""
        return self._free_path(text) if self.bpe else self._light_path(text)

    def _arcs(self, text: str, i: int) -> list[str]:
        """Pieces that begin at ``i``, short to long; the character itself if it is none."""
        node, z, n = self.tree.get(text[i]), i + 1, len(text)
        if node is None:
            return [text[i]]
        out = [node.get("") or text[i]]
        while z < n:
            node = node.get(text[z])
            if node is None:
                break
            z += 1
            piece = node.get("")
            if piece is not None:
                out.append(piece)
        return out

    def _free_path(self, text: str) -> list[str]:
        """The one path without an infinite arc, depth first, long arcs first.

        A position is entered at most once: its prefix has one finite path only.
        """
        n, beside = len(text), self.beside
        path, at = [""], [0]
        open_ = [self._arcs(text, 0)] if n else []
        while at[-1] < n:
            arcs, last, i = open_[-1], path[-1], at[-1]
            while arcs:
                piece = arcs.pop()
                ok = beside.get((last, piece))
                if ok is None:
                    ok = self._side_by_side(last, piece)
                if ok:
                    z = i + len(piece)
                    path.append(piece)
                    at.append(z)
                    if z < n:
                        open_.append(self._arcs(text, z))
                    break
            else:
                path.pop(), at.pop(), open_.pop()
        return path[1:]

    def _light_path(self, text: str) -> list[str]:
        n = len(text)
        weight, back = [INF] * (n + 1), [""] * (n + 1)
        weight[0] = 0.0
        for i in range(n):
            for piece in self._arcs(text, i):
                j = self.text.get(piece)
                to, z = weight[i] + (self.unknown if j is None else -self.score[j]), i + len(piece)
                if to < weight[z]:
                    weight[z], back[z] = to, piece
        path = []
        while n:
            path.append(back[n])
            n -= len(back[n])
        return path[::-1]

    def prepare(self, text: str) -> str:
        """The runs of a text, between which no piece can reach, with blanks between them.

        A word stands for itself with a U+2581 in front, one after a line feed for the line
        feed and itself; what follows ``\0`` is taken as it is, ``\1`` has no ids.
        """
        if not text:
            return "\1"
        if not self.by_blank or "  " in text or text[0] == " " or SPACE in text or "\0" in text or "\1" in text:
            text = self.normalise(text)
            return " ".join(["\0" + r for r in (_RUN.findall(text) if self.by_blank else [text])])
        return text.replace("\n", " \n")

    def ids_of(self, runs: list[str]) -> list[bytes]:
        out, known, path = [], self.id_bytes, self.shortest_path
        for run in runs:
            first = run[:1]
            if first == "\0":
                found = path(run[1:])
            elif first == "\1":
                found = []
            elif first == "\n":
                found = ["\n", *path(run[1:])]
            else:
                found = path(SPACE + run)
            out.append(b"".join([known.get(p) or b"".join([self.byte_ids[b] for b in p.encode()]) for p in found]))
        return out

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that a row of ids writes."""
        n = self.out_size[ids]
        total = np.cumsum(n)
        return self.out_flat[np.repeat(self.out_begin[ids] - (total - n), n) + np.arange(int(total[-1]) if len(n) else 0)]

    def decode(self, ids) -> str:
        known = np.array([i for i in ids if 0 <= i < len(self.out)], np.int64)
        text = self.decode_bytes(known).tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_COMPILED: dict[str, Transducer] = {}


def compile_model(path: str) -> Transducer:
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as ``out`` (a column of that name is replaced)."""
    docs = docs.select(*[c for c in docs.columns if c.lower() != out.lower()])
    if docs.schema[text].dataType != T.StringType():
        docs = docs.withColumn(text, F.col(text).cast("string"))

    def run(batches):
        fst = compile_model(model)
        for batch in batches:
            for part, texts in text_slices(batch, text):
                ids, n = fst.encode([t or "" for t in texts])
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, model: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids as ``out`` (null ids: null)."""

    @F.pandas_udf(T.StringType())
    def text(lists: pd.Series) -> pd.Series:
        fst = compile_model(model)
        return pd.Series([None if x is None else fst.decode(x) for x in lists], dtype=object)

    return rows.withColumn(out, text(F.col(ids)))


def digest(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, n_bytes, ids_crc32, round_trip`` for every row, without the ids.

    ``n_bytes``: ids of the byte fallback; ``round_trip``: the ids decode to the text (with
    U+2581 as a blank).
    """

    def run(batches):
        fst = compile_model(model)
        is_byte = np.zeros(len(fst.out), bool)
        is_byte[fst.byte_id] = True
        drop = len(fst.prefix)  # the blank that the normaliser put in front
        for batch in batches:
            for part, texts in text_slices(batch):
                ids, n = fst.encode([t or "" for t in texts])
                end = np.cumsum(n)
                begin = end - n
                raw = fst.decode_bytes(ids).tobytes()
                written = np.concatenate([[0], np.cumsum(fst.out_size[ids])])
                crc, same, fell = [], [], np.concatenate([[0], np.cumsum(is_byte[ids])])
                flat = ids.astype("<u4")
                for t, a, z in zip(texts, begin.tolist(), end.tolist()):
                    crc.append(zlib.crc32(flat[a:z]))
                    same.append(raw[written[a] + (drop if z > a else 0) : written[z]] == (t or "").replace(SPACE, " ").encode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(fell[end] - fell[begin]), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_tokens", "n_bytes", "ids_crc32", "round_trip"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_bytes bigint, ids_crc32 bigint, round_trip boolean")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
