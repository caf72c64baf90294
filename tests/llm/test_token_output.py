import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quarry.llm import token_output as O
from quarry.session import scratch_path

MODEL = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello World, don't!", "", None, "a b\tc\r\nd  e ", "<|endoftext|> x<|startoftext|>y", "É́ ﬁ 漢字 😀 ΟΔΟΣ ς", "1234 5.6", "word " * 50_000, "\n\n", "same", "same"]
DOCS = "doc_id long, text string, part int, tokens string, n_tokens string"


def expected(rows):
    t = Tokenizer.from_file(MODEL)
    out, start = [], 0
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_digest_and_selective_reads(spark, encoding):
    rows = [(10 * i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in reversed(rows)], DOCS)
    path = scratch_path(spark, "tokens")
    O.write_tokens(df, path, MODEL, encoding=encoding, partitions=3, row_group_mb=1, page_rows=2)
    got = sorted(O.token_digest(spark, path).collect())
    assert [tuple(r) for r in got] == expected(rows)
    meta = O.read_metadata(spark, path)
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in meta.collect()) == [(a, b, c) for a, b, c, _ in expected(rows)]
    assert "tokens:array" not in meta._jdf.queryExecution().executedPlan().toString()
    some = O.read_tokens(spark, path, ids=(20, 60))
    assert sorted(r.doc_id for r in some.collect()) == [20, 30, 40, 50]
    folder = path.removeprefix("file:")
    files = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    last = None
    for f in sorted(files):  # ascending over files and rows; encoding and page index as asked
        ids = pq.read_table(os.path.join(folder, f)).column("doc_id").to_pylist()
        assert ids == sorted(ids) and (last is None or not ids or last <= ids[0])
        last = ids[-1] if ids else last
        m = pq.ParquetFile(os.path.join(folder, f)).metadata
        if m.num_rows:
            column = next(m.row_group(0).column(i) for i in range(m.num_columns) if m.row_group(0).column(i).path_in_schema.startswith("tokens"))
            assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")
            assert m.row_group(0).column(0).has_column_index and m.row_group(0).column(0).has_offset_index


def test_odd_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b", 0, "", ""), (3, "c", 0, "", ""), (3, "d", 0, "", ""), (3, "c", 0, "", "")], DOCS)
    path = scratch_path(spark, "tokens")
    O.write_tokens(df, path, MODEL, partitions=2)
    got = O.token_digest(spark, path).collect()
    assert sorted(r.start for r in got) == [0, 3, 5, 7] and next(r for r in got if r.doc_id is None).start == 0
    path = scratch_path(spark, "tokens")
    O.write_tokens(df.limit(0), path, MODEL)
    assert O.token_digest(spark, path).collect() == [] and O.read_metadata(spark, path).collect() == []
    with pytest.raises(ValueError):
        O.write_tokens(df, path, MODEL, encoding="plain")


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(tuple(r) for r in O.op9_token_output(spark, sf).collect()) == expected(rows)


def test_memo_starts_again(monkeypatch):
    monkeypatch.setattr(O, "MEMO_CHUNKS", 3)
    monkeypatch.setattr(O, "MEMO_WORDS", 2)
    enc, t = O.ChunkEncoder(MODEL), Tokenizer.from_file(MODEL)
    for text in ("a b c d e", "f g a", "", "b\nc"):
        ids, n = enc.encode([text, "x"])
        assert ids.tolist() == t.encode(text).ids + t.encode("x").ids and n.sum() == len(ids)
