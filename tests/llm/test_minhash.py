import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import minhash as M
from quarry.llm.components import components

DOCS = "doc_id long, text string, key string, class_key int, bucket int"


def bag(text):
    w = re.findall(r"\w+", text.lower())
    w += ["\0"] * (5 - len(w))
    return Counter(zip(*[w[k:] for k in range(5)]))


def brute(rows):
    """class of each row number: connected by similarity 0.8, or equal wordless texts"""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [bag(t) if t and re.search(r"\w", t) else None for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][1] is None or rows[b][1] is None:
                continue
            if bags[a] is None or bags[b] is None:
                same = bags[a] is None and bags[b] is None and rows[a][1] == rows[b][1]
            else:
                c = sum((bags[a] & bags[b]).values())
                same = c >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - c)
            if same:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]


def groups(pairs):
    out = {}
    for x, c in pairs:
        out.setdefault(c, []).append(x)
    return sorted(sorted(map(repr, v)) for v in out.values())


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = []
    template = [word() for _ in range(120)]
    passage = " ".join(word() for _ in range(70))
    for i in range(60):  # near copies of one text, few words changed
        t = list(template)
        for _ in range(i % 4):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    for _ in range(60):  # share a passage, are no copies
        texts.append(passage + " " + " ".join(word() for _ in range(50)))
    chain = [word() for _ in range(100)]
    for _ in range(8):  # each near the one before, the ends apart
        texts.append(" ".join(chain))
        a = rng.randrange(90)
        chain[a : a + 8] = [word() for _ in range(8)]
    texts += ["Hello, world!", "hello world", "one two", "", "", "...", "...", "!", None, None, "one two", "a b c d e f", "A b, c d e f?"]
    texts += ["x y z " * 400, "x y z " * 390, "x y z " * 100]  # counts matter
    texts += [texts[0]] * 30
    return [(i, t) for i, t in enumerate(texts)]


def test_classes_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], DOCS)
    want = brute(rows)
    for block in (M.BLOCK, 6, 0):  # one level; several levels; no block at all, down to single pairs
        got = M.classes(df, block=block).collect()
        assert len(got) == len(rows)
        assert groups((r.doc_id, r.class_id) for r in got) == groups(enumerate(want))
    size = Counter(r.class_id for r in got)
    assert all(r.class_rows == size[r.class_id] for r in got)
    kept = M.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_repeated_and_null_ids(spark):
    text = "some words that are long enough to make shingles of five words here"
    rows = [(1, text), (1, text), (1, text + " more"), (None, text), (None, None), (2, "other things altogether in this second text of ours")]
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], DOCS)
    got = sorted((repr(r.doc_id), repr(r.class_id), r.class_rows) for r in M.classes(df).collect())
    assert got == sorted([("1", "1", 4)] * 3 + [("None", "1", 4), ("None", "None", 1), ("2", "2", 1)])
    kept = sorted((repr(r.doc_id), r.text is None) for r in M.keep_one(df).collect())
    assert kept == [("1", False), ("2", False), ("None", True)]


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert M.classes(df).collect() == [] and M.keep_one(df).collect() == []


def test_signature_is_unbiased_for_weights():
    rng = np.random.default_rng(2)
    h = rng.integers(1, 2**63, 60).astype(np.uint64)
    h.sort()
    for spread in (1, 9, 100):
        a, b = rng.integers(1, spread + 1, 60), rng.integers(1, spread + 1, 60)
        doc = np.repeat([0, 1], 60)
        hits = []
        for seed in range(8):
            s = M.bag_minhash(doc, np.concatenate([h, h]), np.concatenate([a, b]), 2, 512, seed)
            hits.append((s[0] == s[1]).mean())
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs(np.mean(hits) - want) < 0.03
        assert abs(M.overlap((h, a), (h, b)) - want) < 1e-12


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 430)] + [(500, x) for x in range(501, 600)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    alone = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in parent if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = M.op5_minhash(spark, "/root/testdata/sf0.001").collect()
    want = brute(rows)
    assert groups((r.doc_id, r.class_id) for r in got) == groups((rows[i][0], c) for i, c in enumerate(want))


def test_a_task_holds_bounded_slices(spark, monkeypatch):
    """Pairs are compared in slices of a batch; rows without a text aren't read by Python to be kept."""
    import pyarrow as pa

    rng = random.Random(3)
    bags = [M.shingles(" ".join(rng.choice("abcdefg") for _ in range(200))) for _ in range(40)]
    raw = [(h.tobytes(), b"" if (c == 1).all() else c.astype("<u4").tobytes()) for h, c in bags]
    names = ["a", "ha", "ca", "b", "hb", "cb"]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*[(b"%d" % (i // 4), *raw[i // 4], b"%d" % i, *raw[i]) for i in range(40)])], names=names)
    whole = list(M._verify([batch]))
    monkeypatch.setattr(M, "SLICE_BYTES", 3 * (len(raw[0][0]) + len(raw[1][0])))
    parts = list(M._verify([batch]))
    assert len(whole) == 1 and len(parts) > 10
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches(whole).to_pylist()

    docs = spark.createDataFrame([(1, None), (1, None), (2, "a b c d e f g"), (3, "a b c d e f g"), (None, None), (4, "")], "doc_id long, text string")
    kept = M.keep_one(docs)
    assert kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.where("doc_id is null or doc_id <> 3").collect()))


def test_small_tables_are_written_in_few_files(spark, monkeypatch):
    """Tables that keep few of many rows don't take a file from each task; every file starts a process beside the executor."""
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(14)) for _ in range(1_200)]
    texts += [t + " more" for t in texts[:60]]
    docs = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in enumerate(texts)], DOCS)
    staged = M.staged

    class Written(Exception):
        pass

    def counted(df, name):
        out = staged(df, name)
        if name == "near-members":
            raise Written(len(out.inputFiles()))
        return out

    monkeypatch.setattr(M, "staged", counted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        with pytest.raises(Written) as found:
            M.near_duplicates(docs)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert found.value.args[0] <= 12
