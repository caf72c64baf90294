import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import enrich
from quarry.operators.embed import StoredEmbedder
from quarry.plugins import CallableEnricher, StoredGenerator
from quarry.sources import answers


def counting(folder, fails=()):
    """A model that notes every prompt it is sent as one line of a file of its own."""

    def call(prompts):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(p.replace("\n", " ") + "\n" for p in prompts)
        if any(p in fails for p in prompts):
            raise ConnectionError("line cut")
        return [f"<{p}>" for p in prompts]

    return call


def sent(folder):
    return sorted(line.rstrip("\n") for f in os.listdir(folder) for line in open(f"{folder}/{f}"))


def made(spark, prompts):
    return spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "key int, prompt string")


PROMPTS = [f"p{i % 60}" for i in range(150)] + ["hot"] * 80 + [None, None, ""]


def test_each_prompt_is_sent_once_after_a_failure(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    root, df = str(tmp_path / "store"), made(spark, PROMPTS)
    small = dict(model="m", batch=1, concurrency=2, task_rows=7, wave_tasks=4)  # nine tasks in three waves
    with pytest.raises(RuntimeError, match="2 prompts without an answer.*line cut"):
        answers.ask(df, root, counting(notes, fails={"p7", "hot"}), **small)
    assert sent(notes) == sorted({p for p in PROMPTS if p is not None})
    out = answers.ask(df, root, counting(notes), **small)
    assert out.columns == ["key", "prompt", "answer"]  # a clashing name stays as it is
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [(i, p, None if p is None else f"<{p}>") for i, p in enumerate(PROMPTS)]
    again = sent(notes)
    assert {p: again.count(p) for p in set(again)} == {p: 2 if p in ("p7", "hot") else 1 for p in set(PROMPTS) - {None}}
    answers.ask(df, root, counting(notes), **small)
    assert sent(notes) == again
    assert not [f for f in os.listdir(root) if f.startswith("pending")]


def test_finished_tasks_of_a_job_that_dies_are_kept(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    root, df = str(tmp_path / "store"), made(spark, [f"p{i}" for i in range(40)])
    good = counting(notes)

    def dies(prompts):
        import time

        if "p13" in prompts:
            time.sleep(3)  # the other tasks end first
            raise KeyboardInterrupt  # not an error of a request: the task and its job go down
        return good(prompts)

    small = dict(model="m", batch=1, concurrency=1, task_rows=5, wave_tasks=100)
    with pytest.raises(Exception):
        answers.ask(df, root, dies, **small)
    kept = {r.answer for r in answers.answers(spark, root).collect()}
    assert 20 <= len(kept) < 40 and "<p13>" not in kept
    before = sent(notes)
    out = answers.ask(df, root, good, **small)
    assert {(r.prompt, r.answer) for r in out.collect()} == {(f"p{i}", f"<p{i}>") for i in range(40)}
    later = sent(notes)
    assert all(later.count(k[1:-1]) == before.count(k[1:-1]) == 1 for k in kept)


def test_models_do_not_share_answers_and_compacting_loses_none(spark, tmp_path):
    root, df = str(tmp_path / "store"), made(spark, ["a", "b", "b", None])
    one = answers.ask(df, root, lambda ps: [f"1{p}" for p in ps], model="one")
    assert {r.answer for r in one.collect()} == {"1a", "1b", None}
    answers.compact(spark, root)
    two = answers.ask(df, root, lambda ps: [None if p == "a" else f"2{p}" for p in ps], model="two", strict=False)
    assert sorted((r.key, r.answer) for r in two.collect()) == [(0, None), (1, "2b"), (2, "2b"), (3, None)]
    answers.compact(spark, root)
    assert sorted(os.listdir(root)) == ["v=2"]
    assert {r.answer for r in answers.answers(spark, root).collect()} == {"1a", "1b", "2b"}

    def refuses(prompts):
        raise AssertionError("nothing is left to ask")

    assert {r.answer for r in answers.ask(df, root, refuses, model="one").collect()} == {"1a", "1b", None}


def test_empty_table_and_wrong_number_of_answers(spark, tmp_path):
    root = str(tmp_path / "store")
    assert answers.ask(made(spark, []), root, lambda ps: ps, model="m").collect() == []
    with pytest.raises(RuntimeError, match="1 answers to 2 prompts"):
        answers.ask(made(spark, ["a", "b"]), root, lambda ps: ["x"], model="m")
    with pytest.raises(ValueError):
        answers.ask(made(spark, ["a"]), root, lambda ps: ps, model="m", out_col="key")


def test_enricher_generator_and_embedder_use_a_store(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    rows = spark.createDataFrame([("C", "f", "x"), ("C", "f", "x"), ("D", None, "y")], "class_name string, name string, source_code string")
    enricher = CallableEnricher(counting(notes))
    plain = enrich.enrich(rows, enricher=CallableEnricher(lambda ps: [f"<{p}>" for p in ps]))
    for _ in range(2):
        got = enrich.enrich(rows, enricher=enricher, store=str(tmp_path / "e"))
        assert got.columns == plain.columns and sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)
    assert len(sent(notes)) == 2

    seen = tmp_path / "seen"
    seen.mkdir()
    note = counting(seen)
    gen = StoredGenerator(lambda system, user: note([f"{s}|{u}" for s, u in zip(system, user)]), store=str(tmp_path / "g"), model="chat")
    asked = spark.createDataFrame([(1, "q:1"), (2, "q:1"), (3, None)], "id int, q string")
    for _ in range(2):
        out = gen.generate(asked, "12:use {c}", {"c": F.lit("é€😀")}, F.col("q"), "r")
        assert sorted((r.id, r.r) for r in out.collect()) == [(1, "<12:use é€😀|q:1>"), (2, "<12:use é€😀|q:1>"), (3, "<12:use é€😀|>")]
    assert len(sent(seen)) == 2

    emb = StoredEmbedder(lambda texts: [[len(t), 1.0] for t in texts], dim=2, store=str(tmp_path / "v"), model="len")
    for _ in range(2):
        assert sorted((r.id, r.v) for r in emb.embed(asked, "q", "v").collect()) == [(1, [3.0, 1.0]), (2, [3.0, 1.0]), (3, [0.0, 1.0])]


def test_reranked_and_plain_turns_are_searched_together(spark, monkeypatch):
    """One search per pass for all turns; the rows are those of two separate runs."""
    from pyspark.sql import functions as F

    from quarry.operators import embed
    from quarry.plans import answer

    words = ["red", "blue", "green", "fast", "slow", "cat", "dog", "tree"]
    texts = [" ".join(words[(i * j + i) % 8] for j in range(1, 5)) for i in range(24)]
    emb = embed.HashingEmbedder(dim=64, sparse=True)
    base = spark.createDataFrame([(i, f"f{i}", t) for i, t in enumerate(texts)], "entity_id long, file_path string, text string")
    methods = emb.embed(base.withColumnRenamed("text", "code"), "code", "method_embeddings")
    classes = emb.embed(base.select("entity_id", "file_path", F.concat("text", F.lit(" class")).alias("source_code"), F.lit("").alias("references")), "source_code", "class_embeddings")
    turns = spark.createDataFrame([(u, 1, f"@codebase {words[u % 8]} {words[(3 * u) % 8]}", "true" if u % 2 else None) for u in range(8)], "user long, turn int, text string, rr string")
    seen = []
    inner = answer._search
    monkeypatch.setattr(answer, "_search", lambda *a, **kw: seen.append(1) or inner(*a, **kw))
    got = {r["user"]: r["context"] for r in answer.answer_log(turns, methods, classes, emb, user_col="user", order_col="turn", rerank_col="rr").collect()}
    assert len(seen) == 2
    want = {}
    for rerank in (False, True):
        qs = turns.where(F.col("rr").isNotNull() == rerank).select(F.col("user").alias("query_id"), F.trim(F.replace("text", F.lit("@codebase"), F.lit(""))).alias("query"))
        want |= {r["query_id"]: r["context"] for r in answer.two_pass_context(qs, methods, classes, emb, rerank=rerank).collect()}
    assert got == want and len(got) == 8
