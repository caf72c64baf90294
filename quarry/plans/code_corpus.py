"""The code half on given tables: a source tree derived from ``documents``.

A stated rule turns every document into one source file: its language follows ``lang``, and
the document's lines become comments of the method ``m<id>a`` of class ``C<id>``. The files hold what
makes extraction hard: headers over several lines, annotations and attributes, generics,
braces and headers in strings, raw strings, text blocks, templates within templates, nested
comments, patterns, constructors, nested functions, a name that an inner definition shadows
(``r<id>``) and an import under another name (``other``). Documents call each other in rings of eight,
so the call graph has cycles. What is to be found follows in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import callgraph, clean, extract, refs
from ..session import scratch_path
from ..sources import entities
from ..sources.tables import table

LANGUAGE_OF = {"fr": ("java", "java"), "de": ("javascript", "js"), "es": ("rust", "rs")}

#: per language: the file before, the prefix of, and the file behind the comment lines; {i} this document, {n} the next of its ring
TEMPLATES = {
    "python": (
        '''from d{n} import t{n} as other

class C{i}:
    """Class {i}: { ' not open"""

    def m{i}a(
        self,
        a={"x": [1, 2]},
    ):
        """doc m{i}a"""
''',
        "        # ",
        '''
        def r{i}():
            return "def no(): {"
        return r{i}() + self.m{i}b()

    def r{i}(self):
        return f"""class Fake{i}:
  def fake(self):
"""

    def m{i}b(self):
        return other(C{n}()) + self.r{i}()

def t{i}(x):
    return C{i}()
''',
    ),
    "java": (
        """package p;
import p.C{n};

@Named("C{i} {")
class C{i} {
  String s = "} /* { ";
  /** doc m{i}a */
  @Deprecated
  <T extends Comparable<T>>
  int m{i}a(
      int a,
      String b) throws Exception {
""",
        "    // ",
        '''
    Runnable q = () -> { r{i}(); };
    return m{i}b();
  }

  C{i}() { /* } */ }
  int r{i}() { return '}'; }

  int m{i}b() {
    return new C{n}().m{n}a(1, """
      class Fake { int no() { """);
  }
}
''',
    ),
    "javascript": (
        """import { m{n}a as other } from './d{n}.js';
class C{i} extends Base {
  /** doc m{i}a */
  async m{i}a(
    a = { b: 1 },
    c = [`}`]
  ) {
""",
        "    // ",
        """
    const t = `x } ${ [1].map(v => { return this.r{i}(v); }) } {`;
    return this.m{i}b() / 2 / /[}"]/g.lastIndex;
  }
  f = 1
  r{i}(v) { return { "}": v }; }
  [Symbol.iterator]() { return null; }

  m{i}b() {
    return other(new C{n}());
  }
}
""",
    ),
    "rust": (
        """use crate::d{n}::m{n}a as other;
/* struct No { /* { */ */
#[derive(Debug)]
pub struct C{i}<'a> {
  x: &'a str,
}
impl<'a> C{i}<'a> {
  /// doc m{i}a
  pub fn m{i}a<T: Into<String>>(
    c: char,
  ) -> i32
  where T: Clone {
""",
        "    // ",
        """
    let s = r#"} fn no() { "#; let b = '}';
    r{i}() + m{i}b()
  }

  fn m{i}b() -> i32 {
    other(C{n} { x: 1 })
  }
}
fn r{i}() -> i32 { 1 }
""",
    ),
}


def document_sources(docs: DataFrame) -> DataFrame:
    """``file_path, language, content``: one source file per document."""
    i = F.col("doc_id").cast("string")
    n = F.when(F.pmod("doc_id", F.lit(8)) == 7, F.col("doc_id") - 7).otherwise(F.col("doc_id") + 1).cast("string")

    def fill(text):
        return F.replace(F.replace(F.lit(text), F.lit("{i}"), i), F.lit("{n}"), n)

    def pick(fn):
        out = fn("python")
        for lang, (language, _) in LANGUAGE_OF.items():
            out = F.when(F.col("lang") == lang, fn(language)).otherwise(out)
        return out

    extension = {"python": "py"} | dict(LANGUAGE_OF.values())
    content = pick(lambda x: F.concat(fill(TEMPLATES[x][0]), F.lit(TEMPLATES[x][1]), F.replace("text", F.lit("\n"), F.lit("\n" + TEMPLATES[x][1])), fill(TEMPLATES[x][2])))
    path = pick(lambda x: F.concat(F.lit(f"src/{x}/{'C' if x == 'java' else 'd'}"), i, F.lit("." + extension[x])))
    return docs.select(path.alias("file_path"), pick(F.lit).alias("language"), content.alias("content"))


def _sql_text(s: str) -> str:
    """A template with {i} and {n} as a SQL expression over columns i and n."""
    out = "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return out.replace("{i}", "' || i || '").replace("{n}", "' || n || '")


def _by_language(**of: str) -> str:
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in of.items()) + " END"


def _lines(language: str, a: int, z: int | None = None, *, part: int) -> str:
    """Lines a to z of the part of a template before (0) or behind (2) the comments, as SQL."""
    rows = TEMPLATES[language][part].strip("\n" if part == 2 else "").split("\n")
    return "\n".join(rows[a - 1 : z])


def _from(text: str, first: str) -> str:
    """The text from the place where ``first`` begins."""
    return text[text.index(first) :]


#: per language: first and last lines of each definition, calls and constructions by line and
#: column; k is the number of comment lines, lines behind the comments are counted on from them
EXPECTED = f"""
d AS (
  SELECT doc_id, CASE lang WHEN 'fr' THEN 'java' WHEN 'de' THEN 'javascript' WHEN 'es' THEN 'rust' ELSE 'python' END AS language,
         CAST(doc_id AS VARCHAR) AS i, CAST(CASE WHEN (doc_id % 8 + 8) % 8 = 7 THEN doc_id - 7 ELSE doc_id + 1 END AS VARCHAR) AS n, string_split(text, chr(10)) AS ls
  FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT *, len(ls) AS k, array_to_string([CASE WHEN language = 'python' THEN '        # ' ELSE '    // ' END || x FOR x IN ls], chr(10)) AS body,
         'src/' || language || CASE WHEN language = 'java' THEN '/C' ELSE '/d' END || i || {_by_language(python="'.py'", java="'.java'", javascript="'.js'", rust="'.rs'")} AS file_path
  FROM d
), m AS (
  SELECT *,
    {_by_language(
        python=_sql_text(_from(TEMPLATES["python"][0], "def m{i}a(")) + " || body || " + _sql_text("\n" + _lines("python", 1, 3, part=2)),
        java=_sql_text(_from(TEMPLATES["java"][0], "@Deprecated")) + " || body || " + _sql_text("\n" + _lines("java", 1, 3, part=2)),
        javascript=_sql_text(_from(TEMPLATES["javascript"][0], "async m{i}a(")) + " || body || " + _sql_text("\n" + _lines("javascript", 1, 3, part=2)),
        rust=_sql_text(_from(TEMPLATES["rust"][0], "pub fn m{i}a")) + " || body || " + _sql_text("\n" + _lines("rust", 1, 3, part=2)))} AS a_src,
    {_by_language(
        python=_sql_text(_lines("python", 10, 11, part=2).strip()),
        java=_sql_text(_lines("java", 8, 11, part=2).strip()),
        javascript=_sql_text(_lines("javascript", 8, 10, part=2).strip()),
        rust=_sql_text(_lines("rust", 5, 7, part=2).strip()))} AS b_src,
    {_by_language(
        python=_sql_text(_lines("python", 5, 8, part=2).strip()),
        java=_sql_text(_lines("java", 6, 6, part=2).strip()),
        javascript=_sql_text(_lines("javascript", 5, 5, part=2).strip()),
        rust=_sql_text(_lines("rust", 9, 9, part=2).strip()))} AS r_src,
    {_by_language(python="'\"\"\"doc m' || i || 'a\"\"\"'", java="'/** doc m' || i || 'a */'", javascript="'/** doc m' || i || 'a */'", rust="'/// doc m' || i || 'a'")} AS doc,
    {_by_language(python="10 + k", java="12 + k", javascript="7 + k", rust="12 + k")} AS o,
    {_by_language(python="6", java="8", javascript="4", rust="9")} AS a_line
  FROM b
), found AS (
  SELECT file_path, language, i, 'm' || i || 'a' AS name, doc AS doc_comment, a_src AS source_code, a_line AS start_line, o + 3 AS end_line FROM m
  UNION ALL SELECT file_path, language, i, 'm' || i || 'b', '', b_src,
    o + {_by_language(python="10", java="8", javascript="8", rust="5")}, o + {_by_language(python="11", java="11", javascript="10", rust="7")} FROM m
  UNION ALL SELECT file_path, language, i, 'r' || i, '', r_src,
    o + {_by_language(python="5", java="6", javascript="5", rust="9")}, o + {_by_language(python="8", java="6", javascript="5", rust="9")} FROM m
  UNION ALL SELECT file_path, language, i, 'r' || i, '', {_sql_text(_lines("python", 1, 2, part=2).strip())}, o + 1, o + 2 FROM m WHERE language = 'python'
  UNION ALL SELECT file_path, language, i, 't' || i, '', {_sql_text(_lines("python", 13, 14, part=2).strip())}, o + 13, o + 14 FROM m WHERE language = 'python'
  UNION ALL SELECT file_path, language, i, 'C' || i, '', {_sql_text(_lines("java", 5, 5, part=2).strip())}, o + 5, o + 5 FROM m WHERE language = 'java'
  UNION ALL SELECT file_path, language, i, '[Symbol.iterator]', '', {_sql_text(_lines("javascript", 6, 6, part=2).strip())}, o + 6, o + 6 FROM m WHERE language = 'javascript'
), methods AS (
  SELECT file_path, language, CASE WHEN language = 'rust' OR name = 't' || i THEN '' ELSE 'C' || i END AS class_name, name, doc_comment, source_code,
         CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM found
), hits AS (
  SELECT 'method' AS kind, 'm' || i || 'b' AS name, file_path AS file, o + {_by_language(python="3", java="2", javascript="2", rust="2")} AS line,
         {_by_language(python="27 + len(i)", java="12", javascript="17", rust="11 + len(i)")} AS col FROM m
  UNION ALL SELECT 'method', 'r' || i, file_path, o + {_by_language(python="3", java="1", javascript="1", rust="2")}, {_by_language(python="16", java="26", javascript="50", rust="5")} FROM m
  UNION ALL SELECT 'method', 'r' || i, file_path, o + 11, 34 + len(n) FROM m WHERE language = 'python'
  UNION ALL SELECT 'method', 'm' || n || 'a', file_path, o + 9, 20 + len(n) FROM m WHERE language = 'java' AND n IN (SELECT i FROM b)
  UNION ALL SELECT 'method', 'C' || n, file_path, o + 11, 22 FROM m WHERE language = 'python' AND n IN (SELECT i FROM b WHERE language = 'java')
  UNION ALL SELECT 'class', 'C' || n, file_path, o + {_by_language(python="11", java="9", javascript="9", rust="6")}, {_by_language(python="22", java="16", javascript="22", rust="11")}
            FROM m WHERE n IN (SELECT i FROM b)
  UNION ALL SELECT 'class', 'C' || i, file_path, {_by_language(python="o + 14", rust="7")}, {_by_language(python="12", rust="10")} FROM m WHERE language IN ('python', 'rust')
), rendered AS (
  SELECT kind, name, string_agg(file || ':' || CAST(line AS VARCHAR) || ':' || CAST(col AS VARCHAR), '; ' ORDER BY file, line, col) AS refs FROM hits GROUP BY ALL
)"""


def _extracted(spark: SparkSession, sf: str):
    return extract.entities_of(_units(spark, sf))


def _named(spark: SparkSession, sf: str):
    return extract.names_of(_units(spark, sf, sources=False))


def _units(spark: SparkSession, sf: str, sources: bool = True) -> DataFrame:
    return extract.units(document_sources(table(spark, sf, "documents").select("doc_id", "lang", "text")), sources=sources)


def extract_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every class with its methods' texts."""
    _, classes, _ = _extracted(spark, sf)
    return classes.select("file_path", "language", "class_name", "method_declarations", "source_code", "start_line", "end_line")


EXTRACT_CLASSES_SQL = f"""
WITH {EXPECTED}, held AS (
  SELECT file_path, string_agg(source_code, chr(10) || '-----' || chr(10) ORDER BY start_line) AS decl FROM methods WHERE class_name <> '' GROUP BY file_path
)
SELECT m.file_path, language, 'C' || i AS class_name, coalesce(decl, '') AS method_declarations,
       {_by_language(
           python=_sql_text(_from(TEMPLATES["python"][0], "class C{i}")) + " || body || " + _sql_text("\n" + _lines("python", 1, 11, part=2)),
           java=_sql_text(_from(TEMPLATES["java"][0], "@Named")) + " || body || " + _sql_text("\n" + _lines("java", 1, part=2)),
           javascript=_sql_text(_from(TEMPLATES["javascript"][0], "class C{i}")) + " || body || " + _sql_text("\n" + _lines("javascript", 1, part=2)),
           rust=_sql_text(_from(TEMPLATES["rust"][0], "pub struct C{i}").split("\nimpl")[0]))} AS source_code,
       CAST({_by_language(python="3", java="4", javascript="2", rust="4")} AS INTEGER) AS start_line,
       CAST({_by_language(python="o + 11", java="o + 12", javascript="o + 11", rust="6")} AS INTEGER) AS end_line
FROM m LEFT JOIN held USING (file_path)"""


def extract_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Every method with its doc comment, class and extent."""
    _, _, methods = _extracted(spark, sf)
    return methods.select("file_path", "language", "class_name", "name", "doc_comment", "source_code", "start_line", "end_line")


EXTRACT_METHODS_SQL = f"WITH {EXPECTED} SELECT * FROM methods"


def name_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """The names defined anywhere."""
    _, classes, methods = _named(spark, sf)
    return extract.name_vocabulary(classes, methods)


NAME_VOCABULARY_SQL = f"WITH {EXPECTED} SELECT 'class' AS kind, 'C' || i AS name FROM m UNION SELECT 'method', name FROM methods"


def code_references(spark: SparkSession, sf: str) -> DataFrame:
    """Where the defined names are used, by file, line and column."""
    lines, classes, methods = _named(spark, sf)
    hits = refs.code_references(lines, classes, methods)
    return hits.select("kind", "name", "file", F.col("line").cast("bigint").alias("line"), F.col("column").cast("bigint").alias("col"))


CODE_REFERENCES_SQL = f"WITH {EXPECTED} SELECT kind, name, file, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col FROM hits"


def attach_references(spark: SparkSession, sf: str) -> DataFrame:
    """Every method and class with the rendered list of its uses."""
    lines, classes, methods = _named(spark, sf)
    rendered = extract.staged(refs.render_references(refs.code_references(lines, classes, methods)), "rendered")
    m = refs.attach_references(methods, rendered, kind="method", name_col="name").select("file_path", F.lit("method").alias("kind"), "name", F.col("references").alias("refs"))
    c = refs.attach_references(classes, rendered, kind="class", name_col="class_name").select("file_path", F.lit("class").alias("kind"), F.col("class_name").alias("name"), F.col("references").alias("refs"))
    return m.unionByName(c)


ATTACH_REFERENCES_SQL = f"""
WITH {EXPECTED}, e AS (
  SELECT file_path, 'method' AS kind, name FROM methods UNION ALL SELECT file_path, 'class', 'C' || i FROM m
)
SELECT file_path, e.kind, e.name, coalesce(refs, '') AS refs FROM e LEFT JOIN rendered r ON r.kind = e.kind AND r.name = e.name"""


def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Which method calls which name, and where."""
    lines, classes, methods = _named(spark, sf)
    edges = callgraph.call_edges(methods, refs.code_references(lines, classes, methods))
    return edges.select("caller_file", "caller_class", "caller", "callee", F.col("line").cast("bigint").alias("line"), F.col("column").cast("bigint").alias("col"))


CALL_EDGES_SQL = f"""
WITH {EXPECTED}
SELECT f.file_path AS caller_file, f.class_name AS caller_class, f.name AS caller, h.name AS callee, CAST(h.line AS BIGINT) AS line, CAST(h.col AS BIGINT) AS col
FROM hits h JOIN methods f ON f.file_path = h.file AND h.line BETWEEN f.start_line AND f.end_line WHERE h.kind = 'method'"""


def _resolved(spark: SparkSession, sf: str):
    parsed = _units(spark, sf, sources=False)
    lines, classes, methods = extract.names_of(parsed)
    return methods, refs.resolve_references(lines, classes, methods, extract.imports_of(parsed))


def resolved_references(spark: SparkSession, sf: str) -> DataFrame:
    """R1-R3 with the definition meant: a shadowed name, own members, imports under another name."""
    _, found = _resolved(spark, sf)
    return found.select(
        "kind", "name", "file", F.col("line").cast("bigint").alias("line"), F.col("column").cast("bigint").alias("col"), "construct",
        "target_file", "target_class", F.col("target_line").cast("string").alias("target_line"), "scope",
    )


#: every hit with its construct and target: by the file's own scopes, by its import, or the only one
TARGETS = f"""
{EXPECTED}, nx AS (SELECT file_path AS nfile, language AS nlang, i AS ni, o AS no FROM m),
q AS (SELECT * FROM m LEFT JOIN nx ON n = ni),
resolved AS (
  SELECT 'method' AS kind, 'm' || i || 'b' AS name, file_path AS file, o + {_by_language(python="3", java="2", javascript="2", rust="2")} AS line,
         {_by_language(python="27 + len(i)", java="12", javascript="17", rust="11 + len(i)")} AS col, 'call' AS construct,
         file_path AS target_file, CASE WHEN language = 'rust' THEN '' ELSE 'C' || i END AS target_class, o + {_by_language(python="10", java="8", javascript="8", rust="5")} AS target_line, 'scope' AS scope FROM q
  UNION ALL SELECT 'method', 'r' || i, file_path, o + {_by_language(python="3", java="1", javascript="1", rust="2")}, {_by_language(python="16", java="26", javascript="50", rust="5")},
         CASE WHEN language = 'python' THEN 'construction' ELSE 'call' END, file_path, CASE WHEN language = 'rust' THEN '' ELSE 'C' || i END,
         o + {_by_language(python="1", java="6", javascript="5", rust="9")}, 'scope' FROM q
  UNION ALL SELECT 'method', 'r' || i, file_path, o + 11, 34 + len(n), 'call', file_path, 'C' || i, o + 5, 'scope' FROM q WHERE language = 'python'
  UNION ALL SELECT 'method', 'm' || n || 'a', file_path, o + 9, 20 + len(n), 'call', CASE WHEN nlang = 'java' THEN nfile END, CASE WHEN nlang = 'java' THEN 'C' || n END,
         CASE WHEN nlang = 'java' THEN 10 END, CASE WHEN nlang = 'java' THEN 'unique' END FROM q WHERE language = 'java' AND ni IS NOT NULL
  UNION ALL SELECT 'method', CASE WHEN language = 'python' THEN 't' ELSE 'm' END || n || CASE WHEN language = 'python' THEN '' ELSE 'a' END, file_path,
         o + {_by_language(python="11", javascript="9", rust="6")}, {_by_language(python="16", javascript="12", rust="5")}, CASE WHEN language = 'python' THEN 'construction' ELSE 'call' END,
         CASE WHEN nlang = language THEN nfile END, CASE WHEN nlang = language THEN CASE WHEN language = 'javascript' THEN 'C' || n ELSE '' END END,
         CASE WHEN nlang = language THEN {_by_language(python="no + 13", javascript="4", rust="9")} END, CASE WHEN nlang = language THEN 'import' END
         FROM q WHERE language <> 'java' AND ni IS NOT NULL AND (language <> 'python' OR nlang = 'python')
  UNION ALL SELECT 'method', 'C' || n, file_path, o + 11, 22, 'construction', NULL, NULL, NULL, NULL FROM q WHERE language = 'python' AND nlang = 'java'
  UNION ALL SELECT 'class', 'C' || n, file_path, o + {_by_language(python="11", java="9", javascript="9", rust="6")}, {_by_language(python="22", java="16", javascript="22", rust="11")}, 'construction',
         CASE WHEN nlang = language THEN nfile END, CASE WHEN nlang = language THEN '' END,
         CASE WHEN nlang = language THEN {_by_language(python="3", java="5", javascript="2", rust="4")} END,
         CASE WHEN nlang = language THEN CASE WHEN language = 'java' THEN 'import' ELSE 'unique' END END FROM q WHERE ni IS NOT NULL
  UNION ALL SELECT 'class', 'C' || i, file_path, {_by_language(python="o + 14", rust="7")}, {_by_language(python="12", rust="10")}, CASE WHEN language = 'python' THEN 'construction' ELSE 'type' END,
         file_path, '', {_by_language(python="3", rust="4")}, 'scope' FROM q WHERE language IN ('python', 'rust')
)"""
RESOLVED_SQL = f"""
WITH {TARGETS}
SELECT kind, name, file, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, construct, target_file, target_class, CAST(target_line AS VARCHAR) AS target_line, scope FROM resolved"""


def call_reach(spark: SparkSession, sf: str) -> DataFrame:
    """Which definitions a method reaches over any number of calls; rings of eight close on themselves."""
    methods, found = _resolved(spark, sf)
    return callgraph.reach(callgraph.resolved_edges(methods, found))


CALL_REACH_SQL = f"""
WITH RECURSIVE {TARGETS}, spans AS (
  SELECT file_path, start_line, end_line, start_line + CASE WHEN language = 'java' AND doc_comment <> '' THEN 2 ELSE 0 END AS name_line FROM methods
), inner_most AS (
  SELECT r.file, r.line, r.col, r.target_file, r.target_line, max_by(s.name_line, s.start_line) AS name_at
  FROM resolved r JOIN spans s ON s.file_path = r.file AND r.line BETWEEN s.start_line AND s.end_line
  WHERE r.kind = 'method' AND r.target_file IS NOT NULL GROUP BY ALL
), e AS (
  SELECT DISTINCT file || '#' || CAST(name_at AS VARCHAR) AS caller, target_file || '#' || CAST(target_line AS VARCHAR) AS callee FROM inner_most
), walk AS (
  SELECT caller, callee FROM e UNION SELECT w.caller, e.callee FROM walk w JOIN e ON e.caller = w.callee
)
SELECT caller, callee FROM walk"""


def special_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a special file's row of the class table."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.col("text").alias("content"))
    return clean.special_rows(docs).withColumnRenamed("references", "refs")


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The method table written as CSV and read back as text."""
    _, _, methods = _extracted(spark, sf)
    fields = ["file_path", "class_name", "name", "doc_comment", "source_code"]
    # texts that a CSV writer likes to change: blanks and tabs at the ends, quotes, words for nothing
    i = F.col("doc_id").cast("string")
    odd = table(spark, sf, "documents").where("text is not null").select(
        F.concat(F.lit("  d"), i).alias("file_path"), F.lit(" NA ").alias("class_name"), F.concat(F.lit("\t'"), i, F.lit('" \t')).alias("name"),
        F.concat(F.lit("  "), F.col("text"), F.lit("\r\n ")).alias("doc_comment"), F.lit("null").alias("source_code"),
    )
    path = scratch_path(spark, "method-csv")
    entities.write_entities_csv(methods.select(*fields).unionByName(odd), path, fields)
    back = entities.read_entities_csv(spark, path, fields)
    return back.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields])


CSV_ROUND_TRIP_SQL = f"""
WITH {EXPECTED}
SELECT file_path, class_name, name, doc_comment, source_code FROM methods
UNION ALL
SELECT '  d' || i, ' NA ', chr(9) || '''' || i || '" ' || chr(9), '  ' || array_to_string(ls, chr(10)) || chr(13) || chr(10) || ' ', 'null' FROM b"""
