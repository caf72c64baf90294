import corpus_pipeline as P
from quarry.llm import langid, minhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "language", "near-dedup", "mixing", "pieces"]
    seen = [docs]
    for _, stage in P.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    raw, clean, known, unique, mixed, coded = seen
    assert all(x.columns == columns for x in seen[:-1]) and coded.columns == [*columns, "piece_ids", "n_pieces"]

    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(clean) == ids(toxicity.score(docs, model).where("predicted = 0"))
    rows = clean.collect()
    langs, _, share = langid.Labeller(langid.fit(clean)).texts([r.text for r in rows])
    assert ids(known) == sorted(r.doc_id for r, lang, x in zip(rows, langs, share) if lang != "und" and x >= langid.KNOWN)
    assert ids(unique) == sorted({r.class_id for r in minhash.classes(known).collect()})
    assert set(ids(mixed)) <= set(ids(unique))
    assert coded.count() == mixed.count() and coded.where("size(piece_ids) <> n_pieces").isEmpty()


def test_run_agrees_with_itself(spark):
    a, b = (sorted((r.doc_id, r.n_pieces) for r in P.run(spark, SF).collect()) for _ in range(2))
    assert a and a == b


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "some words of a text that is long enough", "en", None, 3), (2, "some words of a text that is long enough", "en", None, 3), (3, "word " * 30_000, "en", "b", None)]
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for _, stage in P.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.columns[-2:] == ["piece_ids", "n_pieces"]
        docs.collect()
