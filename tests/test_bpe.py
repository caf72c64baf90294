import base64
import random

import public_tokenizers
import pytest
import tiktoken

from quarry.operators import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def planted():
    rng = random.Random(5)
    letters = "abcdeé€😀中国 \n\t'.,09  \x1c"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    return made + ["", " ", "   x", "don't we'll", "a" * 5000, "中" * 700, "=" * 999, "the " * 400, "😀😀", "x" * 30 + "😀" * 9, "tail   ", "\r\n\r\n a", None, None, "the " * 400]


def test_merges_equal_the_library(library):
    ranks = bpe.read_ranks(PATH)
    for text in planted():
        if text:
            word = text.replace("\n", "x").encode()
            ends = bpe.merged(word, ranks)
            assert ends[-1] == len(word)
            if word not in ranks:
                assert [ranks[word[a:b]] for a, b in zip([0, *ends], ends)] == library._encode_single_piece(word)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "id int, text string, key string")


@pytest.mark.parametrize("frequent", [100_000, 3])
def test_counts_equal_the_library(spark, library, monkeypatch, frequent):
    monkeypatch.setattr(bpe, "FREQUENT", frequent)
    texts = planted() + ["w" * 90 + " ", "w" * 90] * 9 + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    got = bpe.add_token_counts(frame(spark, texts), PATH, pattern=public_tokenizers.PATTERN)
    assert got.columns == ["id", "text", "key", "tokens"]
    rows = {r.id: r.tokens for r in got.collect()}
    assert rows == {i: None if t is None else len(library.encode_ordinary(t)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("limit,frequent", [(1, 100_000), (7, 100_000), (50, 2), (400, 100_000)])
def test_clips_equal_the_library(spark, library, monkeypatch, limit, frequent):
    monkeypatch.setattr(bpe, "FREQUENT", frequent)
    texts = planted() + ["w" * 90 + " ", "w" * 90] * 9 + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]

    def plain(text):
        ids = library.encode_ordinary(text)
        return library.decode(ids[:limit]) if len(ids) > limit else text

    got = bpe.clip_to_tokens(frame(spark, texts), PATH, limit, pattern=public_tokenizers.PATTERN)
    rows = {r.id: r.clipped for r in got.collect()}
    assert rows == {i: None if t is None else plain(t) for i, t in enumerate(texts)}


def test_empty_table_and_clashing_names(spark):
    none = frame(spark, [])
    assert bpe.add_token_counts(none, PATH, pattern=public_tokenizers.PATTERN).collect() == []
    assert bpe.clip_to_tokens(none, PATH, 3, pattern=public_tokenizers.PATTERN).collect() == []
    with pytest.raises(ValueError):
        bpe.add_token_counts(none, PATH, pattern=public_tokenizers.PATTERN, out_col="key")


def test_frequent_words_are_not_shuffled(spark):
    texts = frame(spark, ["the cat and the dog"] * 50)
    plan = bpe.add_token_counts(texts, PATH, pattern=public_tokenizers.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_index_rows_are_clipped_by_these_tokens(spark, library):
    from quarry.operators.embed import HashingEmbedder
    from quarry.plans import index

    text = "def f(): return 'x'  # " + "naïve " * 40
    cols = "file_path string, class_name string, constructor_declaration string, method_declarations string, source_code string, references string"
    classes = spark.createDataFrame([("a.py", "C", "", "", text, "")], cols)
    methods = spark.createDataFrame([("a.py", "C", "f", "", text, "")], "file_path string, class_name string, name string, doc_comment string, source_code string, references string")
    special = spark.createDataFrame([("r.md", text)], "file_path string, content string")
    clip = bpe.clipper(PATH, pattern=public_tokenizers.PATTERN)
    mt, ct = index.vector_tables(classes, methods, HashingEmbedder(dim=8, max_tokens=30), special, clip=clip)
    kept = library.decode(library.encode_ordinary(text)[:30])
    assert {r.source_code for r in ct.collect()} == {f"File: a.py\n\nClass: C\n\nSource Code:\n{kept}\n\n", f"File: r.md\n\nContent:\n{kept}\n\n"}
    assert [r.code for r in mt.collect()] == [text]
