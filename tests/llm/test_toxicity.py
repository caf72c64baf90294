import numpy as np

from quarry.llm import toxicity as X

DOCS = "doc_id long, text string, lang string, source string, score int"


def corpus(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        word = ("idiot", "moronic", "scummy")[i % 3]
        rows.append((i, f"the weather of day {i % 17} is fine. " + f"you are an {word if bad else 'artist'} for it.", "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_learns_and_scores_whole_texts(spark):
    rows, labels = corpus(spark)
    extra = [(9001, None, None, None, 1), (9002, "", None, None, 1), (9003, "fine " * 50_000 + "idiots!", None, None, 1), (None, "an idiot", None, None, 1), (9003, "IDIOTIC", None, None, 1)]
    docs = spark.createDataFrame(rows + extra, DOCS)
    model = X.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = X.score(docs, model).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 5 == 0) for r in held if r.doc_id < 9000)
    assert by[9001].score == by[9002].score < 0.3
    assert all(r.predicted == 1 for r in got if r.doc_id in (9003, None)) and not by[None].held_out
    kept = X.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.predicted)


def test_swaps():
    got = list(X.counterfactuals("the women sang. nothing here. a man ran", (("women", "men"), ("man", "boy"))))
    assert got == [({"the", "women", "sang"}, {"the", "men", "sang"}), ({"a", "man", "ran"}, {"a", "boy", "ran"})]


def test_counterfactuals_move_weight_off_the_group():
    """Mentions of a group that co-occur with abuse: the penalty keeps neutral ones low."""
    rng = np.random.default_rng(0)
    vocabulary = ["muslims", "christians", "awful", "nice", "today"]
    x, y, pairs = [], [], []
    for _ in range(400):
        bad = rng.random() < 0.5
        group = 0 if (bad and rng.random() < 0.9) or rng.random() < 0.1 else 1
        words = {group, 2 if bad and rng.random() < 0.9 else 3}
        x.append(sorted(words))
        y.append(float(bad))
        pairs.append((sorted(words), sorted((words - {group}) | {1 - group})))
    plain, _ = X.train(x, np.array(y), [], len(vocabulary))
    fair, _ = X.train(x, np.array(y), pairs, len(vocabulary), penalty=4.0)
    assert plain[0] - plain[1] > 1.0
    assert abs(fair[0] - fair[1]) < 0.3 and fair[2] - fair[3] > 1.0


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y", 0)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = X.fit(docs, none)
    assert X.score(docs, model).collect()[0].score == 0.5
    empty = docs.limit(0)
    assert X.score(empty, X.fit(empty, none)).collect() == [] and X.keep_clean(empty, model).collect() == []
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (1, 0, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert 0 <= X.score(docs, X.fit(docs, odd)).collect()[0].score <= 1


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = X.score(docs, X.fit(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / max(1, (got.predicted == 1).sum()) > 0.9
    assert got[got.toxic == 1].score.mean() > 5 * got[got.toxic == 0].score.mean()


def test_strongest_grams_are_kept_whatever_their_letters(spark):
    rows = [(f"aaa{i} bbb{i} злодей 坏蛋", 1) for i in range(20)] + [(f"aaa{i} ccc{i} мир", 0) for i in range(20)]
    df = spark.createDataFrame(rows, "text string, y int")
    features = sorted({X.hashed(g) for t, _ in rows for w in X._WORD.findall(t) for g in X.grams_of(w)})
    got = X.strongest(df, features, 20, 20, 12)
    assert len(got) == 12 and "<злодей>" in got and "<坏蛋>" in got and not any("aaa" in g for g in got)
    everything = X.strongest(df, features, 20, 20, 10_000)
    assert set(got) < set(everything) and "<мир>" not in everything and "<aaa3>" in everything
