import re

import pandas as pd
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import chat, chunk, rerank


def turns(spark, rows):
    return spark.createDataFrame(rows, "user_id string, turn long, query string, ctx string")


def carried(df, chunk_expr=None):
    out = chat.carry_context(df, user_col="user_id", order_cols=["turn"], is_setter=tx.has_directive("query"), value=F.col("ctx"), chunk=chunk_expr)
    return sorted((r.user_id, r.turn, r.context) for r in out.collect())


F7 = [
    ("u1", 1, "hello", "c1"),                 # no directive yet → ""
    ("u1", 2, "@codebase first", "ctx-A"),
    ("u1", 3, "follow", "x"),
    ("u1", 4, "@codebase second", "ctx-B"),   # second replaces
    ("u1", 5, "again", "y"),
    ("u2", 1, "plain", "z"),
]


def test_carry_context_cases(spark):
    got = carried(turns(spark, F7))
    assert got == [("u1", 1, ""), ("u1", 2, "ctx-A"), ("u1", 3, "ctx-A"), ("u1", 4, "ctx-B"), ("u1", 5, "ctx-B"), ("u2", 1, "")]


def test_chunked_scan_equals_single_scan(spark):
    rows = [("hot", t, "@codebase q" if t % 7 == 3 else "q", f"c{t}") for t in range(1, 200)] + [("cold", 1, "q", "x")]
    df = turns(spark, rows)
    assert carried(df) == carried(df, F.floor(F.col("turn") / 10))


def test_last_n_history_keeps_last_five_oldest_first(spark):
    rows = [("u", t, f"q{t}", f"r{t}") for t in range(1, 8)]
    df = spark.createDataFrame(rows, "u string, t long, query string, response string")
    h = chat.last_n_history(chat.append_history(df), user_col="u", order_col="t").first()
    entries = [e for e in h.history.split("\n")]
    assert h.entries == 5 and [e.split('"')[3] for e in entries] == ["q3", "q4", "q5", "q6", "q7"]


def test_pair_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2")]
    df = spark.createDataFrame(rows, "c long, t long, role string, text string")
    got = sorted(tuple(r) for r in chat.pair_turns(df, conv_col="c", turn_col="t", role_col="role", text_col="text").collect())
    assert got == [(1, 1, "u1", "a1"), (1, 3, "u2", None)]


def test_stream_equals_batch(spark, tmp_path):
    from quarry.streaming.context_stream import replay_events_context

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = replay_events_context(spark, ev)
    batch = chat.carry_context(ev, user_col="user_id", order_cols=["ts", "event_id"], is_setter=F.col("event_type") == "signup", value=F.col("props"))
    a = sorted((r.event_id, r.context) for r in stream.collect())
    b = sorted((r.event_id, r.context) for r in batch.collect())
    assert a == b and len(a) == ev.count()


def test_ranking_demo_reorders(spark):
    # F8: published bi-encoder vs cross-encoder scores; the cross-encoder moves Doc1 to the top
    rows = [(1, 0.77, 9.91), (2, 0.58, 3.74), (3, 0.97, 5.64), (4, 0.75, 1.67), (5, 0.54, -2.20)]
    df = spark.createDataFrame([(0, d, b, c) for d, b, c in rows], "q long, doc long, bi double, cross double")
    by_bi = rerank.rank_by(df, query_id="q", id_col="doc", score_col="bi").orderBy("rank")
    by_cross = rerank.rank_by(df, query_id="q", id_col="doc", score_col="cross").orderBy("rank")
    assert [r.doc for r in by_bi.collect()] == [3, 1, 4, 2, 5]
    assert [r.doc for r in by_cross.collect()] == [1, 3, 2, 4, 5]


def test_maxsim_counts_query_tokens_found(spark):
    df = spark.createDataFrame([(1, "alpha beta beta", 10, "beta gamma", 1), (1, "alpha beta beta", 11, "alpha beta", 2)],
                               "q long, qt string, d long, dt string, rank int")
    s = {r.d: r.maxsim for r in rerank.maxsim_scores(df, query_id="q", query_text="qt", id_col="d", doc_text="dt", dim=4096).collect()}
    assert s == {10: 2.0, 11: 3.0}
    top = rerank.maxsim_rerank(df, query_id="q", query_text="qt", id_col="d", doc_text="dt", keep=1, dim=4096).first()
    assert top.d == 11 and top.first_rank == 2


def py_recursive(text, size, seps=("\n\n", "\n", ". ", " ")):
    """Ends of the stretches by recursion over positions, then ends of the packed chunks."""

    def stretches(a, z, level):
        if z - a <= size:
            return [z]
        if level == len(seps):
            return [*range(a + size, z, size), z]
        out, at = [], a
        while at < z:
            i = text.find(seps[level], at, z)
            end = z if i < 0 else i + len(seps[level])
            out += stretches(at, end, level + 1)
            at = end
        return out

    chunks, begin, last = [], 0, 0
    for end in stretches(0, len(text), 0) if text else []:
        if end - begin > size:
            chunks.append(text[begin:last])
            begin = last
        last = end
    return chunks + [text[begin:last]] if text else []


def test_recursive_chunks_against_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, "aa\n\nbb\ncc dd"), (-2, ""), (-3, None), (-4, "x" * 1000 + "\n\n\n\ny. z. ")], "doc_id long, text string")
    for size in (6, 300):
        got = {}
        for r in chunk.recursive_chunks(docs.unionByName(odd), id_col="doc_id", text_col="text", size=size).collect():
            got.setdefault(r.doc_id, []).append((r.chunk_no, r.start, r.chunk))
        for r in docs.unionByName(odd).collect():
            own = sorted(got.get(r.doc_id, []))
            assert [c for _, _, c in own] == py_recursive(r.text or "", size)
            assert "".join(c for _, _, c in own) == (r.text or "") and all(len(c) <= size for _, _, c in own)
            assert all(r.text[s - 1 : s - 1 + len(c)] == c for _, s, c in own)


def test_fixed_and_token_chunks_cover_text(spark):
    df = spark.createDataFrame([(1, "abcdefghij")], "id long, text string")
    fc = [r.chunk for r in chunk.fixed_chunks(df, id_col="id", text_col="text", size=4, overlap=1).orderBy("chunk_no").collect()]
    assert fc == ["abcd", "defg", "ghij", "j"]
    df2 = spark.createDataFrame([(1, " a b  c d e")], "id long, text string")
    tc = [r.chunk for r in chunk.token_chunks(df2, id_col="id", text_col="text", n_tokens=2).orderBy("chunk_no").collect()]
    assert tc == ["a b", "c d", "e"]


def test_line_sections(spark):
    df = spark.createDataFrame([(1, "# T\nbody\n\npara two\nmore\n## U\nx")], "id long, text string")
    got = [(r.section, r.first_line, r.text) for r in chunk.line_sections(df, id_col="id", text_col="text").orderBy("section").collect()]
    assert got == [(1, 1, "# T\nbody"), (2, 4, "para two\nmore"), (3, 6, "## U\nx")]


def test_line_sections_fences_levels_and_ids(spark):
    text = "intro\n# A\n## B ##\n~~~~ x\n# no\n\n~~~\n~~~~\nafter\n\n#no\n### C\n# D\n\n\n```\nopen\n\n## no"
    rows = [(1, text), (1, text), (None, text), (None, "a\n\nb"), (None, "a\n\nb"), (2, None), (3, ""), (4, "\n \n")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = [tuple(r) for r in chunk.line_sections(df, id_col="id", text_col="text").collect()]
    one = [
        (1, 1, 1, "intro", 0, "", []),
        (2, 2, 1, "# A", 1, "A", ["A"]),
        (3, 3, 7, "## B ##\n~~~~ x\n# no\n\n~~~\n~~~~\nafter", 2, "B", ["A", "B"]),
        (4, 11, 1, "#no", 0, "", ["A", "B"]),
        (5, 12, 1, "### C", 3, "C", ["A", "B", "C"]),
        (6, 13, 1, "# D", 1, "D", ["D"]),
        (7, 16, 4, "```\nopen\n\n## no", 0, "", ["D"]),
    ]
    two = [(1, 1, 1, "a", 0, "", []), (2, 3, 1, "b", 0, "", [])]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted([(1, *r) for r in one] * 2 + [(None, *r) for r in one] + [(None, *r) for r in two] * 2, key=key)


def test_sections_of_several_texts_share_a_batch(spark):
    """Texts are cut in slices of a batch, one Arrow batch per slice instead of one per text."""
    import pyarrow as pa

    from quarry.operators import chunk

    rows = spark.createDataFrame([(i, f"# h{i}\nx\n\ny \x0b\n \t\n```\n#\n\n``` \nz") for i in range(30)] + [(99, ""), (98, None)], "d long, t string").coalesce(1)
    out = []

    class Whole:
        sparkSession, schema = spark, rows.schema

        def select(self, *cols):
            self.at = rows.select(*cols)
            self.schema = self.at.schema
            return self

        def where(self, cond):
            self.at = self.at.where(cond)
            return self

        def mapInArrow(self, run, schema):
            out.extend(run([self.at.toArrow().combine_chunks().to_batches()[0]]))
            return rows.withColumn("id", rows.d)

    chunk.line_sections(Whole(), id_col="d", text_col="t")
    assert len(out) == 1
    got = [(r["id"], r["section"], r["first_line"], r["text"]) for r in pa.Table.from_batches(out).to_pylist()]
    assert got == [x for i in range(30) for x in ((i, 1, 1, f"# h{i}\nx"), (i, 2, 4, "y \x0b"), (i, 3, 6, "```\n#\n\n``` \nz"))]
