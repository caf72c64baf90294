from pyspark.sql import functions as F

from quarry.operators import extract, refs

RECT = '''class Garden:
    def __init__(self, beds, rows):
        self.beds = beds
        self.rows = rows

    def plant_count(self):
        """How many plants fit."""
        return self.beds * self.rows

plot = Garden(5, 3)
n = plot.plant_count()
'''

JAVA = '''class A {
  int x;
  A(int x) { this.x = x; }
  int go(int y) {
    if (y > 0) { return y; }
    return x;
  }
}
'''

TRICKY_JAVA = '''class B {
  /** Docs { not a brace } */
  String s = "}{";
  char c = '}';
  // a comment with } brace
  void f() {
    /* block
       comment } */
    g("{");
  }
}
'''

RUST = '''pub struct Point {
    x: i32,
}
impl Point {
    /// make one
    pub fn new(x: i32) -> Self {
        Point { x }
    }
}
'''

JS = '''class Shape {
  area() {
    return 0;
  }
}
function helper() { return 1; }
const o = { m() { return 2; } };
'''

NESTED = '''class Outer:
    class Inner:
        def deep(self):
            return 1
    def top(self):
        def local():
            return 2
        return local()
'''


def files(spark, rows):
    return spark.createDataFrame(rows, "file_path string, language string, content string")


def run(spark, rows):
    c, m = extract.extract_definitions(files(spark, rows))
    return (
        sorted((r.file_path, r.class_name, r.start_line, r.end_line) for r in c.collect()),
        sorted((r.file_path, r.class_name, r.name, r.start_line, r.end_line) for r in m.collect()),
        c, m,
    )


def test_python_golden(spark):
    cs, ms, c, m = run(spark, [("r.py", "python", RECT)])
    assert cs == [("r.py", "Garden", 1, 8)]
    assert ms == [("r.py", "Garden", "__init__", 2, 4), ("r.py", "Garden", "plant_count", 6, 8)]
    src = {r.name: r.source_code for r in m.collect()}
    assert src["__init__"] == "def __init__(self, beds, rows):\n        self.beds = beds\n        self.rows = rows"
    doc = {r.name: r.doc_comment for r in m.collect()}
    assert doc["plant_count"] == '"""How many plants fit."""'
    decl = c.first().method_declarations
    assert decl == src["__init__"] + "\n-----\n" + src["plant_count"]


def test_java_golden(spark):
    cs, ms, _, _ = run(spark, [("A.java", "java", JAVA)])
    assert cs == [("A.java", "A", 1, 8)]
    assert ms == [("A.java", "A", "A", 3, 3), ("A.java", "A", "go", 4, 7)]


def test_braces_in_strings_and_comments(spark):
    cs, ms, _, m = run(spark, [("B.java", "java", TRICKY_JAVA)])
    assert cs == [("B.java", "B", 1, 11)]
    assert ms == [("B.java", "B", "f", 6, 10)]


def test_rust_struct_and_impl(spark):
    cs, ms, _, m = run(spark, [("p.rs", "rust", RUST)])
    assert cs == [("p.rs", "Point", 1, 3)]
    assert ms == [("p.rs", "", "new", 6, 8)]  # impl is not inside the struct
    assert m.first().doc_comment == "/// make one"


def test_js_methods_only(spark):
    _, ms, _, _ = run(spark, [("s.js", "javascript", JS)])
    names = [x[2] for x in ms]
    assert "area" in names and "helper" not in names


def test_nested_outermost_class_and_nested_functions(spark):
    cs, ms, c, _ = run(spark, [("n.py", "python", NESTED)])
    assert [x[1] for x in cs] == ["Inner", "Outer"]
    owner = {x[2]: x[1] for x in ms}
    assert owner == {"deep": "Outer", "top": "Outer", "local": "Outer"}
    outer = [r for r in c.collect() if r.class_name == "Outer"][0]
    assert outer.method_declarations.count("\n-----\n") == 2


def test_crlf_and_line_table(spark):
    from quarry.sources.files import decode_text

    df = spark.createDataFrame([("w.py", "python", bytearray(b"def f():\r\n    return 1\r\n"))], "file_path string, language string, b binary")
    df = df.select("file_path", "language", decode_text(F.col("b")).alias("content"))
    _, ms, _, _ = run(spark, [tuple(r) for r in df.collect()])
    assert ms == [("w.py", "", "f", 1, 2)]


def test_references_golden(spark):
    f = files(spark, [("r.py", "python", RECT)])
    c, m = extract.extract_definitions(f)
    lines = extract.line_table(f)
    occ = refs.code_references(lines, c, m)
    got = sorted((r.kind, r.name, r.line, r.column) for r in occ.collect())
    assert ("class", "Garden", 10, 8) in got
    assert ("method", "plant_count", 11, 10) in got
    assert not any(r[2] in (1, 2, 6) for r in got)  # definitions are not references
    rendered = {r.name: r.references for r in refs.render_references(occ).collect()}
    assert rendered["Garden"] == "r.py:10:8"


def test_keep_last_same_name_two_files(spark):
    from quarry.plans.index import code_entities

    f = files(spark, [("a/x.py", "python", "class K:\n    pass\n"), ("b/x.py", "python", "class K:\n    x = 1\n")])
    classes, methods = code_entities(f)
    rows = classes.collect()
    assert len(rows) == 1 and rows[0].file_path == "b/x.py"


def _defs(spark, lang, code):
    f = spark.createDataFrame([("f", lang, code)], "file_path string, language string, content string")
    lines, classes, methods = extract.extract_all(f)
    c = sorted((r.class_name, r.start_line, r.end_line) for r in classes.collect())
    m = sorted((r.name, r.class_name, r.start_line, r.end_line) for r in methods.collect())
    for r in lines.collect():
        assert len(r.masked) == len(r.line), r
    return c, m


def test_comment_and_string_signs_do_not_flip_the_rest(spark):
    py = '# use """ here\nclass A:\n    def f(self):\n        s = "# no" + \'"""\'\n        return s\n'
    assert _defs(spark, "python", py) == ([("A", 2, 5)], [("f", "A", 3, 5)])
    java = "class A {\n  /* don't do this */ char c = 'x';\n  void f() {\n  }\n}\nclass B {\n  int g() { return 1; }\n}\n"
    assert _defs(spark, "java", java) == ([("A", 1, 5), ("B", 6, 8)], [("f", "A", 3, 4), ("g", "B", 7, 7)])
    js = "class A {\n  m() {\n    return `a {\n  b ${1}`;\n  }\n  n() { return 1; }\n}\n"
    assert _defs(spark, "javascript", js) == ([("A", 1, 7)], [("m", "A", 2, 5), ("n", "A", 6, 6)])
    rust = "pub struct P<'a> { x: &'a str }\nimpl P {\n  fn f(&self) -> char { '}' }\n  fn g() { let s = \"{\n\"; }\n}\n"
    assert _defs(spark, "rust", rust)[1] == [("f", "", 3, 3), ("g", "", 4, 5)]


def test_signature_over_lines_keeps_its_body(spark):
    py = "def f(\n    a,\n    b=(1,\n2),\n):\n    x = [\n1,\n]\n    return x\n\ndef g():\n    return 1\n"
    assert _defs(spark, "python", py)[1] == [("f", "", 1, 9), ("g", "", 11, 12)]


def test_java_call_over_lines_is_no_method(spark):
    java = "class A {\n  A(int x) {\n  }\n  void f() {\n    doWork(\n      1,\n      2);\n    assert check(\n      3);\n  }\n}\n"
    assert [m[0] for m in _defs(spark, "java", java)[1]] == ["A", "f"]


def test_reference_columns_after_long_strings(spark):
    code = 'def foo():\n    return 1\nx = "a long literal"; y = foo()\n'
    f = spark.createDataFrame([("f", "python", code)], "file_path string, language string, content string")
    lines, classes, methods = extract.extract_all(f)
    got = [(r.name, r.line, r.column) for r in refs.code_references(lines, classes, methods).collect()]
    assert got == [("foo", 3, 27)]


def test_long_literals_do_not_overflow(spark):
    code = 's = "' + "a\\\\" * 60_000 + '"\ndef f():\n    """' + "x\n" * 20_000 + '    """\n    return 1\n'
    assert _defs(spark, "python", code)[1] == [("f", "", 2, 20_004)]


def test_a_batch_is_parsed_in_slices(monkeypatch):
    """A worker parses some files at a time; it doesn't hold the statements of a whole Arrow batch."""
    import pyarrow as pa

    from quarry.functions import batches
    from quarry.operators import extract, refs

    text = "class A:\n    def b(self):\n        return c(1)\n"
    rows = pa.RecordBatch.from_pydict({"key": [str(i) for i in range(50)], "language": ["python"] * 50, "first_line": [0] * 50, "text": [text] * 50})
    whole = list(extract._parsed([rows]))
    monkeypatch.setattr(batches, "SLICE_CHARS", 4 * len(text))
    parts = list(extract._parsed([rows]))
    assert len(whole) == 1 and len(parts) == 13
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches(whole).to_pylist()


def test_units_are_read_by_column(spark):
    """Units and definitions are written once, and a reader of names reads no texts."""
    from quarry.operators import extract

    files = spark.createDataFrame([("a.py", "python", "class A:\n    def b(self):\n        return 1\n"), ("n.py", "python", None)], "file_path string, language string, content string")
    _, classes, methods = extract.entities_of(extract.units(files))
    names = extract.name_vocabulary(classes, methods)
    scans = [l for l in names._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in l or "Scan" in l]
    assert scans and not any("source" in l for l in scans)
    assert sorted(map(tuple, names.collect())) == [("class", "A"), ("method", "b")]


def test_names_need_no_texts(spark):
    """Classes, methods and code lines for references are those of ``entities_of``, from units without sources."""
    from quarry.operators import extract

    rows = [
        ("a.py", "python", "class A:\n    # c\n    def b(self):\n\n        class In:\n            def d(self): return 1\n        return 'x'\n\ndef e(): pass\n"),
        ("B.java", "java", "class B {\n  B() { f(); }\n  int f() { return 1; }\n  enum E { X; E() {} }\n}\n"),
        ("c.js", "javascript", "class C {\n  [Symbol.iterator]() { return null; }\n  g(a = {b: 1}) { return h(); }\n}\nclass C2 {}\n"),
        ("c.js", "javascript", "class C {\n  [Symbol.iterator]() { return null; }\n}\n"),
        (None, "rust", "struct R { x: i32 }\nfn s() -> i32 { 1 }\n"),
    ]
    files = spark.createDataFrame(rows, "file_path string, language string, content string")
    whole, bare = extract.units(files), extract.units(files, sources=False)
    sent = [s.source for r in bare.collect() for s in r.statements]
    assert sum(x is not None for x in sent) == 2 and len(sent) > 10
    lines, *full = extract.entities_of(whole)
    code, *named = extract.names_of(bare)
    for a, b in zip(full, named):
        assert not {"source_code", "doc_comment", "method_declarations"} & set(b.columns)
        assert sorted(map(repr, b.collect())) == sorted(map(repr, a.select(*b.columns).collect()))
    assert sorted(map(repr, code.collect())) == sorted(map(repr, lines.where("is_code").select(*code.columns).collect()))


def test_types_of_a_unit_are_found_once(spark):
    """The patterns of a definition stand once in the plan and the unit's types below the explode, not per statement."""
    from quarry.operators import extract

    parsed = extract.units(spark.createDataFrame([("B.java", "java", "class B {\n  B() { f(); }\n}\n")], "file_path string, language string, content string"))
    plan = extract.definitions(parsed)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode(statements", 1)
    assert "transform(" not in above and below.count("transform(") == 1
    assert plan.count("?:default|const|async|unsafe") == 1


def test_files_above_the_size_go_through_one_pass(spark):
    from quarry.operators import extract

    text = "".join(f"class C{i} {{\n  m{i}() {{ return 1; }}\n}}\n" for i in range(60))
    rows = [("big.js", "javascript", text), ("small.js", "javascript", "class S {\n  s() { return 2; }\n}\n"), ("none.js", "javascript", None), ("empty.js", "javascript", "")]
    files = spark.createDataFrame(rows, "file_path string, language string, content string")
    for sources in (True, False):
        parsed = extract.units(files, chunk_chars=500, sources=sources)
        assert parsed.where("masked is null").isEmpty() and parsed.where("key = 'big.js'").count() > 3
        _, classes, methods = extract.names_of(parsed)
        assert sorted(r.class_name for r in classes.collect()) == sorted([f"C{i}" for i in range(60)] + ["S"])
        assert {(r.class_name, r.name) for r in methods.collect()} == {(f"C{i}", f"m{i}") for i in range(60)} | {("S", "s")}
