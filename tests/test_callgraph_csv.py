import random

from quarry.operators import callgraph, extract, refs
from quarry.sources import entities

CODE = '''class Shop:
    def total(self):
        return self.price() + tax()

    def price(self):
        return 3

def tax():
    return helper()

def helper():
    return 1
'''


def test_call_graph_edges_and_depth(spark):
    f = spark.createDataFrame([("s.py", "python", CODE)], "file_path string, language string, content string")
    lines, classes, methods = extract.extract_all(f)
    occ = refs.code_references(lines, classes, methods)
    edges = callgraph.call_edges(methods, occ)
    got = sorted((r.caller, r.callee) for r in edges.collect())
    assert got == [("tax", "helper"), ("total", "price"), ("total", "tax")]
    reach = {(r.caller, r.callee): r.hops for r in callgraph.expand(edges, depth=2).collect()}
    assert reach[("total", "helper")] == 2 and reach[("total", "tax")] == 1


def test_csv_round_trip_keeps_na_words_and_newlines(spark, tmp_path):
    rows = [("a.py", "NA", "None", "doc\nline", "def f():\n    return \"x, y\"", "")]
    df = spark.createDataFrame(rows, ",".join(f"{c} string" for c in entities.METHOD_FIELDS))
    path = str(tmp_path / "method_data")
    entities.write_entities_csv(df, path, entities.METHOD_FIELDS)
    back = entities.read_entities_csv(spark, path, entities.METHOD_FIELDS).collect()
    assert [tuple(r) for r in back] == [("a.py", "NA", "None", "doc\nline", "def f():\n    return \"x, y\"", None)]


def test_csv_round_trip_keeps_blanks_at_the_ends(spark, tmp_path):
    texts = ["  lead", "trail  ", "\ttab\t", " ", "a\r\nb\r\n", '"', '\\"', "x\n ", "null", ",;"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    path = str(tmp_path / "odd")
    entities.write_entities_csv(df, path)
    assert [r.text for r in entities.read_entities_csv(spark, path, ["id", "text"]).orderBy("id").collect()] == texts


FILES = [
    ("pkg/a.py", "python", "from pkg.b import work as job, Tool\nimport pkg.b as bb\n\ndef work():\n    return job() + bb.work() + only()\n\nclass A:\n    def work(self):\n        def work():\n            return 1\n        return work() + self.work() + obj.work()\n"),
    ("pkg/b.py", "python", "def work():\n    return work()\n\ndef only():\n    return Tool()\n\nclass Tool:\n    x: Tool\n"),
    ("Z.java", "java", "class Z {\n  void work() { work(); this.work(); other.work(); new Z().work(); }\n}\n"),
]


def test_names_are_resolved_by_scope_import_and_singleness(spark):
    f = spark.createDataFrame(FILES, "file_path string, language string, content string")
    parsed = extract.units(f)
    lines, classes, methods = extract.entities_of(parsed)
    found = refs.resolve_references(lines, classes, methods, extract.imports_of(parsed))
    got = sorted((r.file, r.line, r.column, r.name, r.target_file, r.target_line, r.scope) for r in found.collect())
    assert got == sorted([
        ("pkg/a.py", 5, 12, "work", "pkg/b.py", 1, "import"),
        ("pkg/a.py", 5, 23, "work", "pkg/b.py", 1, "import"),
        ("pkg/a.py", 5, 32, "only", "pkg/b.py", 4, "unique"),
        ("pkg/a.py", 11, 16, "work", "pkg/a.py", 9, "scope"),
        ("pkg/a.py", 11, 30, "work", "pkg/a.py", 8, "scope"),
        ("pkg/a.py", 11, 43, "work", None, None, None),
        ("pkg/b.py", 2, 12, "work", "pkg/b.py", 1, "scope"),
        ("pkg/b.py", 5, 12, "Tool", "pkg/b.py", 7, "scope"),
        ("pkg/b.py", 8, 8, "Tool", "pkg/b.py", 7, "scope"),
        ("Z.java", 2, 17, "work", "Z.java", 2, "scope"),
        ("Z.java", 2, 30, "work", "Z.java", 2, "scope"),
        ("Z.java", 2, 44, "work", "Z.java", 2, "unique"),
        ("Z.java", 2, 56, "Z", "Z.java", 1, "scope"),
        ("Z.java", 2, 60, "work", "Z.java", 2, "unique"),
    ], key=lambda r: r[:3])


def test_reach_ends_on_cycles(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "x"), ("x", None)] + [(f"c{i}", f"c{i + 1}") for i in range(20)]
    want = {p for p in pairs if None not in p}
    while True:
        more = {(a, d) for a, b in want for c, d in want if b == c} - want
        if not more:
            break
        want |= more
    got = callgraph.reach(spark.createDataFrame(pairs, "caller string, callee string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert callgraph.reach(spark.createDataFrame([], "caller string, callee string")).collect() == []
