import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import token_counts as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, n_tokens string, x int, limit int"
TEXTS = [
    "", None, "Hello, world! don't we'll", "a  b\t\n c \n\n", "x<|endoftext|>y <|endoftext|>", "<|endoftext|>", " lead", "trail  ", "\r\n\x1c\x85᠎ z",
    "՘֋ abc ౜def ghi \U0001f9ff", "漢字かな交じり文 12345 ½ ²", "é é ﬁ ß", "a" * 3000, "ab " * 40_000, "same", "same", "'s 'S it's",
]


def expected(t):
    return len(LIB.encode(t or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("look", [{}, {"parts": 1, "rows": 1}, {"keep": 0}])
def test_equals_the_library(spark, look):
    rows = [(i, t, "clash", 1, 2) for i, t in enumerate(TEXTS)] + [(None, "null id", "", 0, 0), (3, TEXTS[3], "", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    plan = C.plan_counts(df, PATH, **look)
    got = C.count_tokens(df, PATH, plan=plan, limit=100).collect()
    want = [(i, len((t or "").encode()), expected(t), expected(t) > 100) for i, t, *_ in rows]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_every_odd_point_and_its_neighbours():
    odd = set(C.odd_points(C._load(PATH)))
    assert odd and not any(c.isascii() for c in odd)
    plan = {"name": 0, "keys": "", "sizes": b"", "lengths": b"", "special": ["<|endoftext|>"], "odd": "".join(sorted(odd))}
    counts = C.Counts(PATH, plan)
    rng = random.Random(2)
    points = [chr(p) for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000]
    some = sorted(odd)[::7] + rng.sample(points, 20_000)
    texts = [f"{rng.choice(['ab', '12', '?!', '  ', ' x'])}{c}{rng.choice(['ab', '7', '- ', ' q'])} end{c}" for c in some]
    assert counts.count(texts) == [expected(t) for t in texts]


def test_random_texts_and_full_cache(monkeypatch):
    monkeypatch.setattr(C, "CACHE_KEYS", 5)
    monkeypatch.setattr(C, "CACHE_KEY_CHARS", 3)
    plan = {"name": 1, "keys": "the and\n", "sizes": bytes([3, 4, 1]), "lengths": bytes([1, 1, 1]), "special": ["<|endoftext|>"], "odd": "՘"}
    counts = C.Counts(PATH, plan)
    rng = random.Random(1)
    pieces = ["the", " and", " ", "\n", "\t", "word", "Don't", "42", "€", "՘", "é", "<|endoftext|>", "  ", "<|", "|>"]
    for _ in range(300):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(4)]
        assert counts.count(texts) == [expected(t) for t in texts]
        assert len(counts.lengths) <= counts.frequent + 5 + 120


def test_other_tokenizers(spark):
    import sentencepiece

    df = spark.createDataFrame([(i, t, "", 0, 0) for i, t in enumerate(["Hello World", None, "a b"])], SCHEMA)
    word = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(word)
    assert C.plan_counts(df, word) is None
    assert sorted(r.n_tokens for r in C.count_tokens(df, word).collect()) == sorted(len(t.encode(x, add_special_tokens=False).ids) for x in ("Hello World", "", "a b"))
    piece = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=piece)
    assert sorted(r.n_tokens for r in C.count_tokens(df, piece).collect()) == sorted(len(sp.encode(x)) for x in ("Hello World", "", "a b"))


def test_no_shuffle_empty_and_given_documents(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.count_tokens(df, PATH).collect() == []
    got = C.op12_token_counts(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert sorted(map(tuple, got.collect())) == sorted((r.doc_id, len((r.text or "").encode()), expected(r.text), expected(r.text) > 1024) for r in docs)
