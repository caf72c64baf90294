from pyspark.sql import functions as F

from quarry.operators import embed
from quarry.plans import index
from quarry.sources import files as src

TREE = {
    "a/b.py": "class C:\n    def m(self):\n        return C()\n",
    "node_modules/x.js": "class X { f() {} }\n",
    "src/build/y.rs": "fn y() {}\n",
    "a/B.PY": "x = 1\n",
    "a/.py": "x = 2\n",
    "a/n.md": "# notes\n",
    "node_modules/r.md": "readme\n",
    "docker-compose.yml": "v: 1\n",
}


def test_scan_rules(spark, tmp_tree):
    root = tmp_tree(TREE)
    kept = sorted(r.rel_path for r in src.scan_files(spark, root).collect())
    assert kept == ["a/b.py"]
    special = sorted(r.file_path.split(root)[-1] for r in src.scan_special_files(spark, root).collect())
    assert special == ["/a/n.md", "/node_modules/r.md"]


def test_invalid_utf8_is_flagged(spark, tmp_tree):
    root = tmp_tree({"ok.py": "x = 1\n", "bad.py": b"x = '\xff\xfe'\n"})
    rows = {r.rel_path: r.valid_utf8 for r in src.scan_files(spark, root).collect()}
    assert rows == {"ok.py": True, "bad.py": False}


def test_build_index_and_publish(spark, tmp_tree, tmp_path):
    root = tmp_tree(TREE)
    out = str(tmp_path / "index")
    emb = embed.HashingEmbedder(dim=32)
    paths = index.build_code_index(spark, root, out, emb)
    name = root.rstrip("/").split("/")[-1]
    mt = index.open_index(spark, out, name, "method")
    ct = index.open_index(spark, out, name, "class")
    m = mt.collect()
    assert [r.name for r in m] == ["m"] and m[0].class_name == "C" and len(m[0].method_embeddings) == 32
    cls = {r.file_path.split(root)[-1]: r for r in ct.collect()}
    assert cls["/a/b.py"].source_code.startswith("File: ") and "Class: C" in cls["/a/b.py"].source_code
    assert cls["/a/b.py"].references.endswith("a/b.py:3:16")
    assert cls["/node_modules/r.md"].class_name == "empty"  # special files in the class table
    assert paths["method"][0].startswith(out)


def test_placeholder_row_only_when_empty(spark):
    from quarry.operators import clean

    empty = spark.createDataFrame([], "a string, b string")
    assert [tuple(r) for r in clean.placeholder_row(empty).collect()] == [("empty", "empty")]
    full = spark.createDataFrame([("x", "y")], "a string, b string")
    assert [tuple(r) for r in clean.placeholder_row(full).collect()] == [("x", "y")]


def test_tag_files_paths(spark):
    df = spark.createDataFrame([(p,) for p in TREE], "rel_path string")
    kept = sorted(r.rel_path for r in src.tag_files(df).collect())
    assert kept == ["a/b.py"]


def test_every_way_to_write_the_root(spark, tmp_tree, tmp_path, monkeypatch):
    root = tmp_tree({"tree/build/proj/src/a.py": "x = 1\n", "tree/build/proj/src/tree/build/proj/b.py": "x = 2\n", "tree/build/proj/src/proj/c.py": "x = 3\n"})
    monkeypatch.chdir(root)
    want = ["a.py", "proj/c.py"]  # b.py lies in a denied folder below the root
    for r in ("tree/build/proj/src", "./tree/build/proj/src", f"{root}/tree/build/proj/src", f"{root}/tree/build/proj/src/", f"file://{root}/tree/build/proj/src"):
        r = r if r.startswith(("/", "file")) else f"{root}/{r}" if not r.startswith("./") else f"{root}/./{r[2:]}"
        assert sorted(x.rel_path for x in src.scan_files(spark, r).collect()) == want


def test_denied_files_are_not_opened(spark, tmp_tree):
    root = tmp_tree({"ok.py": "x = 1\n", "node_modules/big.py": "y" * 5000, "a b/c d.py": "z = 1\n"})
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert sorted(r.rel_path for r in src.scan_files(spark, root).select("rel_path", "content").collect()) == ["a b/c d.py", "ok.py"]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_index_life_cycle(spark, tmp_path):
    import pytest
    from pyspark.sql.utils import PythonException

    root = str(tmp_path / "index")
    one, two = spark.range(3).toDF("id"), spark.range(3, 5).toDF("id")
    with pytest.raises(FileNotFoundError):
        index.open_index(spark, root, "x", "method")
    index.publish({"method": one, "class": one}, root, "x")
    ids = lambda t: sorted(r.id for r in index.open_index(spark, root, "x", t).collect())

    def fail(batches):
        raise ValueError("no")
        yield from batches

    with pytest.raises(PythonException):  # the second table fails: the old pair stays
        index.publish({"method": two, "class": two.mapInPandas(fail, "id long")}, root, "x")
    with pytest.raises(ValueError):
        index.publish({"method": two, "class": two.limit(0)}, root, "x", required=("class",))
    assert ids("method") == ids("class") == [0, 1, 2]
    index.append_index({"method": two}, root, "x")
    assert ids("method") == [0, 1, 2, 3, 4] and ids("class") == [0, 1, 2]
    with pytest.raises(ValueError):
        index.append_index({"class": two.toDF("other")}, root, "x")
    index.publish({"method": two, "class": two}, root, "x")
    assert index.clean_up(spark, root, "x") >= 3
    assert ids("method") == ids("class") == [3, 4]


def test_appended_rows_replace_by_id(spark, tmp_path):
    import pytest

    from quarry.operators.search import vector_topk

    root = str(tmp_path / "index")
    schema = "entity_id long, text string, vec array<double>"
    rows = lambda some: spark.createDataFrame([(i, t, [float(len(t)), float(i)]) for i, t in some], schema)
    state = {i: f"a{i}" for i in range(20)}
    index.publish({"method": rows(state.items()), "plain": spark.range(3).toDF("id")}, root, "x")
    ask = spark.createDataFrame([(1, [3.0, 4.0]), (2, [2.0, 90.0])], "query_id long, query_vec array<double>")

    def same():
        got = index.open_index(spark, root, "x", "method")
        assert sorted((r.entity_id, r.text) for r in got.collect()) == sorted(state.items())
        find = lambda t: sorted(map(tuple, vector_topk(t, ask, id_col="entity_id", vec_col="vec", k=3, carry=["text"]).collect()))
        assert find(got) == find(rows(state.items()))

    def append(some, gone=()):
        index.append_index({"method": rows(some)}, root, "x", {"method": spark.createDataFrame([(i,) for i in gone], "entity_id long")} if gone else None)
        for i in gone:
            state.pop(i, None)
        state.update(dict(some))
        same()

    same()
    append([(3, "b"), (4, "bbbb"), (30, "new")])
    append([(3, "b"), (4, "bbbb"), (30, "new")])  # the same again changes nothing
    append([(4, "c")], gone=[3, 5, 4, 99])
    append([(5, "back")])
    for bad in ([(1, "x"), (1, "y")], [(None, "x")]):
        with pytest.raises(ValueError):
            index.append_index({"method": spark.createDataFrame([(i, t, [0.0, 0.0]) for i, t in bad], schema)}, root, "x")
    with pytest.raises(ValueError):
        index.append_index({}, root, "x", {"plain": spark.createDataFrame([(1,)], "entity_id long")})
    same()
    assert len(index.compact_index(spark, root, "x")["method"]) == 1
    same()
    index.append_index({"plain": spark.range(2).toDF("id")}, root, "x")
    assert sorted(r.id for r in index.open_index(spark, root, "x", "plain").collect()) == [0, 0, 1, 1, 2]
    assert index.clean_up(spark, root, "x") >= 4
    same()
