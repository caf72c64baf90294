import pytest

from quarry.operators import extract, lex

SOURCES = {
    "python": '''"""module
class No: {
"""
import os

class Outer(object):
    """Outer "quoted" doc"""

    def first(
        self,
        a={"k": [1, 2]},
    ) -> "Map[str]":
        r\'\'\'doc of
    first\'\'\'
        s = "def no(): \\" {"  # class Comment:
        return f"""{a}
def not_one():
"""

    class Inner:
        async def deep(self): return 1

    x = 1

def top():
    # only a comment
    return 2

top()
''',
    "java": '''/* class No { */
@Entity(name = "}")
public final class Box<T extends Comparable<T>> {
  String text = """
    class Fake { "quoted" }
    """;
  char c = '{';
  // void no() {
  /** Finds. */
  @Override
  @Named("x(")
  public <K, V>
  Map<K, List<V>> find(
      K key,
      int... rest) throws IOException,
      Other {
    run(() -> { call(); });
    return new Thing() { void inner() { } };
  }

  Box(int x) { this.x = x; }
  int later();

  enum Kind { A(1) { int f() { return 1; } }; Kind(int i) { } }
}
class Second { int g() { return 2; } }
''',
    "javascript": '''/* outer { */
export default class Shape extends mixin(A, B) {
  /** doc of area */
  area(
    a = { b: 1 },
    c = [1, 2]
  ) {
    return `text ${ [1].map(x => { return `inner } ${x} {`; }) } {`;
  }
  field = 3
  // why
  *[Symbol.iterator]() { yield /[}/'"]+/g; }
  static async get(url) { return a / b / c; }
  #hidden() { if (x) { y(); } }
}
function helper() { return 1; }
const o = { m() { return 2; }, n: function () { }, p(q) { } }
for (const k of o) { go(k); }
class Last { z() { } }
''',
    "rust": '''/* one /* two { */ still */
#[derive(Debug, Clone)]
pub struct Point<'a> {
    name: &'a str,
}
struct Unit;
struct Pair(i32, char);
impl<'a> Point<'a> {
    /// makes one
    #[inline]
    pub(crate) fn make<T: Into<String>>(
        name: &'a str,
        c: char,
    ) -> Self
    where
        T: Clone,
    {
        let s = r#"fn no() { "quoted" "#;
        let b = b'{'; let d = '\\''; let t = "two
lines { \\" }";
        Point { name }
    }
}
trait Shape { fn area(&self) -> f64; fn twice(&self) -> f64 { 2.0 } }
fn main() { }
''',
}
EXPECTED = {
    "python": (
        [("Outer", 6, 23), ("Inner", 20, 21)],
        [("first", "Outer", 9, 18), ("deep", "Outer", 21, 21), ("top", "", 25, 27)],
    ),
    "java": (
        [("Box", 2, 25), ("Second", 26, 26)],
        [("find", "Box", 10, 19), ("inner", "Box", 18, 18), ("Box", "Box", 21, 21), ("later", "Box", 22, 22), ("f", "Box", 24, 24), ("Kind", "Box", 24, 24), ("g", "Second", 26, 26)],
    ),
    "javascript": (
        [("Shape", 2, 15), ("Last", 19, 19)],
        [("area", "Shape", 4, 9), ("[Symbol.iterator]", "Shape", 12, 12), ("get", "Shape", 13, 13), ("#hidden", "Shape", 14, 14), ("m", "", 17, 17), ("p", "", 17, 17), ("z", "Last", 19, 19)],
    ),
    "rust": (
        [("Point", 3, 5), ("Unit", 6, 6), ("Pair", 7, 7)],
        [("make", "", 11, 22), ("twice", "", 24, 24), ("main", "", 25, 25)],
    ),
}
DOCS = {"python": {"first": "r'''doc of\n    first'''"}, "java": {"find": "/** Finds. */"}, "javascript": {"area": "/** doc of area */", "[Symbol.iterator]": "// why"}, "rust": {"make": "/// makes one"}}


@pytest.mark.parametrize("language", list(SOURCES))
def test_state_at_any_cut_gives_the_same_mask(language):
    text = SOURCES[language]
    whole, end = lex.lex(text, language)
    assert len(whole) == len(text) and end in ("", ".")
    assert [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(whole) if c == "\n"]
    lines = text.splitlines(keepends=True)
    for k in range(1, len(lines)):
        a, z = "".join(lines[:k]), "".join(lines[k:])
        first, state = lex.lex(a, language)
        second, last = lex.lex(z, language, state)
        assert first + second == whole and last == end, k
    state, masked = "", ""
    for line in lines:
        m, state = lex.lex(line, language, state)
        masked += m
    assert masked == whole


def test_masks():
    assert lex.lex("a /* x /* y */ z */ b", "rust")[0].split() == ["a", "b"]
    assert lex.lex("a /* x /* y */ z */ b", "java")[0].split() == ["a", "z", "*/", "b"]
    assert lex.lex("x = `a ${ f(`b ${g({})} }`) } {`; y", "javascript")[0].replace(" ", "") == "x=`f(`g({})`)`;y"
    assert lex.lex("a / b / c; return /d{/ ; (/e}/)", "javascript")[0].replace(" ", "") == "a/b/c;return;()"
    assert lex.lex('r##"a "# b"##; \'x\'; \'static', "rust")[0].replace(" ", "") == "\"\"##;'';'static"
    assert lex.lex("'''a", "python")[1] == "'''" and lex.lex("/* a /* b", "rust")[1] == "/*2" and lex.lex("`${ {", "javascript")[1] == "` {1"
    assert lex.lex("s = 'open\nx = 1", "python")[0] == "s = '    \nx = 1"


@pytest.mark.parametrize("chunk_chars", [None, 1, 40, 300])
def test_definitions_for_every_chunk_size(spark, chunk_chars):
    rows = [(f"f.{x}", x, t) for x, t in SOURCES.items()] + [("empty", "java", ""), ("null", "java", None), ("other", "go", "func f() {}"), ("blank", "rust", "\n\n")]
    files = spark.createDataFrame(rows, "file_path string, language string, content string")
    _, classes, methods = extract.extract_all(files, chunk_chars=chunk_chars)
    c, m = classes.collect(), methods.collect()
    for language, (want_c, want_m) in EXPECTED.items():
        assert sorted((r.class_name, r.start_line, r.end_line) for r in c if r.language == language) == sorted(want_c)
        assert sorted((r.name, r.class_name, r.start_line, r.end_line) for r in m if r.language == language) == sorted(want_m)
        docs = {r.name: r.doc_comment for r in m if r.language == language and r.doc_comment}
        assert docs == DOCS[language]
        for r in [*c, *m]:
            if r.language == language:
                lines = SOURCES[language].split("\n")[r.start_line - 1 : r.end_line]
                assert r.source_code.split("\n")[1:-1] == lines[1:-1] and r.source_code.split("\n")[0] in lines[0] and r.source_code.split("\n")[-1] in lines[-1]
    box = next(r for r in c if r.class_name == "Box")
    assert box.method_declarations.count("\n-----\n") == 5 and box.source_code.startswith('@Entity(name = "}")\npublic final')


def test_one_huge_file_is_many_units(spark):
    text = "".join(f'class C{i} {{\n  /* }} */ m{i}() {{ return `{{`; }}\n}}\n' for i in range(400))
    files = spark.createDataFrame([("big.js", "javascript", text)], "file_path string, language string, content string")
    parsed = extract.units(files, chunk_chars=1000)
    assert parsed.count() > 15 and "".join(r.text for r in parsed.orderBy("first_line").collect()) == text
    _, classes, methods = extract.extract_all(files, chunk_chars=1000)
    assert sorted((r.class_name, r.start_line) for r in classes.collect()) == sorted((f"C{i}", 3 * i + 1) for i in range(400))
    assert methods.count() == 400


def test_identifier_places_without_neighbours(spark):
    from quarry.operators import refs

    lines = spark.createDataFrame([("f", 1, "Ab, c$d  é_1"), ("f", 2, ""), ("g", 1, None), ("g", 2, "  x.y(\u00df)")], "file_path string, ln int, masked string")
    full, bare = refs.identifier_occurrences(lines), refs.identifier_occurrences(lines, neighbours=False)
    assert bare.columns == ["file_path", "line", "column", "token"]
    assert sorted(bare.collect()) == sorted(full.select(*bare.columns).collect())
    assert bare.count() == 6
