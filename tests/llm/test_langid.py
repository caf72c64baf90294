import itertools

import numpy as np

from quarry.llm import langid as L

DOCS = "doc_id long, text string, lang string, source string, score int, pos int"
EN = "the house of the king and the river that was with them this morning for all people".split()
DE = "das haus und der könig mit dem fluss der für die leute heute morgen nicht war".split()


def corpus(n=240):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        words, lang = (EN, "en") if i % 2 else (DE, "de")
        rows.append((i, " ".join(rng.choice(words, 30)) + ".", lang, "s", 0, 0))
    return rows


def enumerate_marginals(emit, start, trans):
    n, k = emit.shape
    out, pair, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for y in itertools.product(range(k), repeat=n):
        s = np.exp(start[y[0]] + sum(emit[i, y[i]] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += s
        for i in range(n):
            out[i, y[i]] += s
        for a, b in zip(y, y[1:]):
            pair[a, b] += s
    return out / total, pair / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    length = np.array([5, 3, 3, 1])
    emit, start, trans = rng.normal(size=(4, 5, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    gamma, pair = L.forward_backward(emit, start, trans, length)
    flat = np.concatenate([emit[i, :n] for i, n in enumerate(length)])
    begin = np.cumsum(length) - length
    quick = [L.marginals(flat, start, trans, length, window=w) for w in (1, 2, 64)]
    want_pair = np.zeros((3, 3))
    for i, n in enumerate(length):
        m, p = enumerate_marginals(emit[i, :n], start, trans)
        want_pair += p
        assert np.allclose(gamma[i, :n], m) and all(np.allclose(q[begin[i] : begin[i] + n], m) for q in quick)
        assert (gamma[i, n:] == 0).all()
    assert np.allclose(pair, want_pair)


def test_long_texts_are_one_chain():
    rng = np.random.default_rng(5)
    size = np.array([1, 1000, 64, 65, 3, 128, 640, 2])
    k = 4
    emit, start, trans = rng.normal(size=(int(size.sum()), k)) * 4, rng.normal(size=k), rng.normal(size=(k, k)) * 3
    got = L.marginals(emit, start, trans, size)
    at = np.cumsum(size) - size
    for a, n in zip(at, size):
        whole, _ = L.forward_backward(emit[None, a : a + n], start, trans, np.array([n]))
        assert np.allclose(got[a : a + n], whole[0], atol=1e-12)


def test_hashed_features_are_the_named_ones():
    words = ["a", "der", "könig", "banana", "straße", "日本語", "x" * 40, "𝔘𝔫𝔦"]
    row, h = L.feature_hashes(words)
    for i, w in enumerate(words):
        assert sorted(h[row == i].tolist()) == sorted(int(L.FeatureTable._hash(x)) for x in L.word_features(w, {}))
    names = sorted({x for w in words[:6] for x in L.word_features(w, {})})
    table = L.FeatureTable(names)
    found = table.find(h)
    for i, w in enumerate(words):
        assert sorted(found[(row == i) & (found >= 0)].tolist()) == sorted(names.index(x) for x in L.word_features(w, {}) if x in names)


def test_predicts_and_labels_switches(spark):
    rows = corpus()
    mixed = " ".join(EN[:12] + DE[:12] + EN[:12])
    extra = [(900, None, "en", "s", 0, 0), (901, "123 !!!", "en", "s", 0, 0), (902, "", None, "s", 0, 0), (903, "the king " * 60_000, None, "s", 0, 0), (None, "der könig", None, "s", 0, 0), (904, mixed, None, "s", 0, 0), (903, "das haus", None, "s", 0, 0)]
    docs = spark.createDataFrame(rows + extra, DOCS)
    model = L.fit(docs, per_lang=60)
    got = L.predict(docs, model).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(r.lang_pred == truth[r.doc_id] and r.score > 0.9 for r in held)
    by = {(r.doc_id, r.lang_pred): r for r in got}
    assert all((i, "und") in by and by[i, "und"].score == 0 for i in (900, 901, 902))
    assert (903, "en") in by and (903, "de") in by and (None, "de") in by and not by[None, "de"].held_out
    words = [r for r in L.word_languages(docs, model).where("doc_id = 904").orderBy("pos").collect()]
    assert [r.word for r in words] == mixed.split()
    right = sum(r.lang == want for r, want in zip(words, ["en"] * 12 + ["de"] * 12 + ["en"] * 12))
    assert right >= 34
    kept = L.keep_known(docs, model)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r.doc_id) for r in got if r.lang_pred != "und")
    strange = spark.createDataFrame([(1, "ΑΒΓ δεζ ηθι", None, "", 0, 0), (2, "the ΑΒΓ king", None, "", 0, 0), (3, "...", None, "", 0, 0)], DOCS)
    assert sorted(r.doc_id for r in L.keep_known(strange, model).collect()) == [2]
    four = L.Labeller(model | {"langs": model["langs"]}).texts([" ".join(EN + DE)])
    assert four[2][0] >= L.KNOWN  # an even mix of known languages stays


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s", 0, 0)], DOCS)
    model = L.fit(docs)
    assert [(r.lang_pred, r.score) for r in L.predict(docs, model).collect()] == [("und", 0.0)]
    assert L.keep_known(docs, model).count() == 1
    empty = docs.limit(0)
    assert L.predict(empty, L.fit(empty)).collect() == [] and L.word_languages(docs, model).count() == 1
    one = spark.createDataFrame([(i, "abc def ghi", "xx", "s", 0, 0) for i in range(9)], DOCS)
    assert {r.lang_pred for r in L.predict(one, L.fit(one)).collect()} == {"xx"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.op7_langid(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_a_batch_is_labelled_in_slices(spark, monkeypatch):
    """What a worker holds at a time follows ``SLICE_CHARS``, and the rows don't depend on it."""
    docs = spark.createDataFrame([(i, f"der hund {i} und die katze" if i % 2 else f"the dog {i} and the cat", "de" if i % 2 else "en") for i in range(120)], "doc_id long, text string, lang string").coalesce(1)
    model = L.fit(docs)
    want = sorted(L.predict(docs, model).collect())
    seen = []

    class Whole:
        sparkSession, schema = spark, docs.schema

        def mapInArrow(self, run, schema):
            list(run([docs.toArrow().combine_chunks().to_batches()[0]]))

    inner = L.Labeller.texts
    monkeypatch.setattr(L, "SLICE_CHARS", 300)
    monkeypatch.setattr(L.Labeller, "texts", lambda self, texts: seen.append(sum(map(len, texts))) or inner(self, texts))
    L.keep_known(Whole(), model)
    assert max(seen) <= 300 and len(seen) > 5
    assert sorted(L.predict(docs, model).collect()) == want
