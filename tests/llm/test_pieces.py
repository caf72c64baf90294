import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quarry.llm import pieces as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "\n", "\n\n a\n", "▁", "▁▁a ▁b", "a  b   c    d", " lead", "trail  ", "\t\r\n\x00\x0b", "ﬁ ① ｆ é", "😀𓀀 漢字かな", "<s> </s> <unk> <0x0A>", "naïve café ÀÉÎ", "á​ b", "¿Qué? ñandú", "x" * 3000, "ab" * 700, "!!!???***%%%$$$", "don't we'll I'm", "1234567890 3.14"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_equals_the_library(library):
    rng = random.Random(5)
    alphabet = "aeinorst thdlcum\n .,!é漢😀▁0"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    words = [library.id_to_piece(i).replace("▁", " ") for i in range(300, 20000, 61)]
    texts += ["".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    fst = S.compile_model(MODEL)
    ids, n = fst.encode(texts)
    for t, got, want in zip(texts, np.split(ids, np.cumsum(n)), library.encode(texts)):
        assert got.tolist() == want, t
        assert fst.decode(want) == library.decode(want), t


def test_unigram_path_is_the_lightest():
    fst = S.compile_model(MODEL)
    free = object.__new__(S.Transducer)
    free.__dict__ = fst.__dict__ | {"bpe": False, "score": [-float(len(str(i)) + i % 7) for i in range(len(fst.score))]}

    def weight(path):
        return sum(-free.score[free.text[p]] if p in free.text else free.unknown for p in path)

    for t in ("▁there", "▁inter", "▁a漢b"):
        n = len(t)
        best = min(
            weight(path)
            for cuts in itertools.product((0, 1), repeat=n - 1)
            for path in [[t[a:z] for a, z in itertools.pairwise([0, *[i + 1 for i, c in enumerate(cuts) if c], n])]]
            if all(p in free.text or len(p) == 1 for p in path)
        )
        assert weight(free.shortest_path(t)) == pytest.approx(best)


def test_frames(spark, library):
    rows = [(i, t, 7) for i, t in enumerate(ODD)] + [(None, None, 7), (0, "again " * 40_000, 7), (1, ODD[1], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = S.encode(df, MODEL)
    assert got.columns == ["doc_id", "text", "n_tokens", "piece_ids"]
    for r in S.decode(got, MODEL).collect():
        if r.text is None:
            assert r.piece_ids is None and r.decoded is None
        else:
            assert r.piece_ids == library.encode(r.text) and r.decoded == r.text.replace("▁", " ")
    assert all(r.round_trip for r in S.digest(df, MODEL).collect())
    by = {(r.doc_id, r.n_tokens): r for r in S.digest(df, MODEL).collect()}
    for i, t, _ in rows:
        want = library.encode(t or "")
        assert by[i, len(want)].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
    assert S.digest(df.limit(0), MODEL).collect() == [] and S.encode(df.limit(0), MODEL).collect() == []
    again = S.encode(got.withColumnRenamed("n_tokens", "PIECE"), MODEL, out="piece_ids")
    assert again.columns.count("piece_ids") == 1


def test_memo_generations(monkeypatch, library):
    monkeypatch.setattr(S, "MEMO_RUNS", 4)
    monkeypatch.setattr(S, "MEMO_PAIRS", 3)
    fst = S.Transducer(MODEL)
    for text in ("a b c d e f", "a b", "g h a\nb", "", "a b c d e f") * 2:
        ids, n = fst.encode([text, "x y"])
        assert ids.tolist() == library.encode(text) + library.encode("x y") and n.sum() == len(ids)
