"""Class and method extraction.

A source file is a row of the scan. ``units`` makes it one or more units: a file above
``CHUNK_CHARS`` characters is cut into chunks of whole lines, and each chunk is lexed by itself,
once from every state that it may well begin in; folding these transition maps in file
order gives the state and bracket depth that every chunk begins in. From these each chunk
knows its first place between two top-level statements, and the stretches from one such place to
the next are units, which need nothing from each other. The rows found are the same for
every chunk size.

A unit is lexed (strings and comments blanked in place), cut into statements by its brackets,
and each statement knows the bracket (in Python the line) that ends its block. Headers are
regular expressions over a statement's own level of brackets, so a header may hold strings,
generics and parameter lists over many lines. Which class holds a method is an equi-join on
(unit, line): each class is exploded into the lines it covers, so the work is the size of
the result, never classes x methods of a file.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.batches import text_slices
from ..session import checkpoint_dir, scratch_path, ship_package
from . import lex

CHUNK_CHARS = 4_000_000

# --- fixed per-language patterns, over the head of a statement --------------------------
_ID = r"[\p{L}_$][\p{L}\p{N}_$]*"
_JAVA_PREFIX = (
    r"^(?:@[\w.]+\s*(?:\(\))?\s*|(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp|sealed|non-sealed|transient|volatile)\s+)*"
)
_JAVA_TAIL = r"\s*\(\)\s*(?:\[\s*\]\s*)*(?:throws\b[\s\S]*)?$"
_JAVA_TYPE = r"(?!(?:return|new|throw|else|case|assert|yield|package|import|class|enum|record|interface)\b)(?:<[^()]*?>\s*)?(?:[\w$.<>\[\]?,&@\s]*[\w$>\]]\s+|[\w$.<>\[\]?,&@\s]*[>\]])"
CLASS_HEAD = {
    "python": rf"^class\s+({_ID})",
    "java": rf"{_JAVA_PREFIX}class\s+({_ID})",
    "javascript": rf"^class\s+({_ID})",
    "rust": rf"^(?:pub\s*(?:\(\))?\s+)?struct\s+({_ID})",
}
METHOD_HEAD = {
    "python": rf"^(?:async\s+)?def\s+({_ID})",
    "java": rf"{_JAVA_PREFIX}{_JAVA_TYPE}({_ID}){_JAVA_TAIL}",
    "javascript": rf"^(?:(?:static|async|get|set)\s+|\*\s*)*(#?{_ID}|\[\])\s*\(\)$",
    "rust": rf"^(?:pub\s*(?:\(\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"\s*\")?)\s+)*fn\s+({_ID})",
}
JAVA_CONSTRUCTOR = rf"{_JAVA_PREFIX}(?:<[^()]*?>\s*)?({_ID}){_JAVA_TAIL}"
JAVA_TYPE_NAME = rf"{_JAVA_PREFIX}(?:class|enum|record)\s+({_ID})"
COMPUTED_NAME = r"^(?:(?:static|async|get|set)\s+|\*\s*)*(\[[^\]]*\])"
# names a head may give that are statements, not definitions
NOT_A_NAME = ["if", "for", "while", "switch", "catch", "with", "function", "return", "new", "else", "do", "try", "synchronized"]


def _by_language(lang: Column, table: dict, fn) -> Column:
    expr = None
    for name, pat in table.items():
        e = fn(pat)
        expr = F.when(lang == name, e) if expr is None else expr.when(lang == name, e)
    return expr


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder; each reader takes only the columns it asks for."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _key(df: DataFrame) -> str:
    return f"key {df.schema['key'].dataType.simpleString()}"


def _chunks(files: DataFrame, size: int) -> DataFrame:
    """``key, language, chunk, first_line, piece``: files cut behind line ends, ``size`` characters or more each."""

    def run(batches):
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                out, at, ln = [], 0, 0
                while at < len(text):
                    z = text.find("\n", min(len(text), at + size) - 1) + 1 or len(text)
                    out.append((len(out), ln, text[at:z]))
                    ln += text.count("\n", at, z)
                    at = z
                take = pa.array([i] * len(out), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("key").take(take), b.column("language").take(take), *(pa.array(c, t) for c, t in zip(map(list, zip(*out)), (pa.int32(), pa.int32(), pa.string())))],
                    names=["key", "language", "chunk", "first_line", "piece"],
                )

    return files.mapInArrow(run, f"{_key(files)}, language string, chunk int, first_line int, piece string")


def _transitions(batches):
    """The state that a chunk ends in, for each state that it is asked about."""
    for b in batches:
        exits = []
        for piece, language, chunk, state in zip(*(b.column(c).to_pylist() for c in ("piece", "language", "chunk", "asked"))):
            states = [state] if state is not None else ["", *lex.USUAL[language]] if chunk else [""]
            exits.append([(s, lex.lex(piece, language, s)[1]) for s in states])
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("chunk"), pa.array(exits, pa.map_(pa.string(), pa.string()))], names=["key", "chunk", "exits"])


def chunk_states(chunks: DataFrame) -> DataFrame:
    """``key, chunk, state``: the lexer's state at the begin of every chunk.

    Every chunk is lexed once for all usual states; a fold over each file's maps gives the states.
    Where a chunk turns out to begin in an unusual one (deep nests), it is lexed from that one
    and the fold goes on, until nothing is left open.
    """
    schema = f"{_key(chunks)}, chunk int, exits map<string,string>"
    maps = chunks.withColumn("asked", F.lit(None).cast("string")).mapInArrow(_transitions, schema).checkpoint(eager=True)
    while True:
        files = maps.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", F.map_entries("exits").alias("exits")))).alias("c"))
        begin = F.struct(F.lit("").alias("at"), F.array(F.lit("")).alias("states"))

        def step(acc, x):
            after = F.coalesce(F.element_at(F.map_from_entries(x["exits"]), acc["at"]), F.lit("?"))
            return F.struct(after.alias("at"), F.array_append(acc["states"], after).alias("states"))

        states = files.select("key", F.posexplode(F.aggregate("c", begin, step, lambda acc: acc["states"])).alias("chunk", "state"))
        found = maps.join(states, ["key", "chunk"])
        # the first chunk of a file whose state its map doesn't know
        open_ones = found.where((F.col("state") != "?") & F.element_at("exits", F.col("state")).isNull()).select("key", "chunk", F.col("state").alias("asked"))
        if open_ones.isEmpty():
            return found.select("key", "chunk", "state")
        more = chunks.join(open_ones, ["key", "chunk"]).select("key", "language", "chunk", "piece", "asked").mapInArrow(_transitions, schema)
        both = maps.unionByName(more).select("key", "chunk", F.explode("exits").alias("s", "e"))
        maps = both.groupBy("key", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("s", "e"))).alias("exits")).checkpoint(eager=True)


def _cuts(batches):
    """Per chunk: the change of bracket depth, and its first clean cut for each depth it may begin at."""
    for b in batches:
        delta, cuts = [], []
        for piece, language, state in zip(*(b.column(c).to_pylist() for c in ("piece", "language", "state"))):
            closed = []
            masked, _ = lex.lex(piece, language, state, closed=closed)
            delta.append(sum(map(masked.count, "([{")) - sum(map(masked.count, ")]}")))
            cuts.append([(-d, at) for d, at in lex.clean_cuts(piece, masked, language, closed).items() if d <= 0])
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), b.column("chunk"), pa.array(delta, pa.int64()), pa.array(cuts, pa.map_(pa.int64(), pa.int32()))], names=["key", "chunk", "delta", "cuts"]
        )


def _joined_units(chunks: DataFrame) -> DataFrame:
    """Chunks put together to units that begin and end between two top-level statements."""
    lexed = chunks.join(chunk_states(chunks), ["key", "chunk"])
    schema = f"{_key(chunks)}, chunk int, delta bigint, cuts map<bigint,int>"
    found = lexed.select("key", "chunk", "language", "piece", "state").mapInArrow(_cuts, schema)
    w = Window.partitionBy("key").orderBy("chunk")  # a row per chunk, without its text
    depth = F.coalesce(F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumn("cut", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.element_at("cuts", depth)))
    found = found.withColumn("unit", F.count("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("key", "chunk", "cut", "unit")
    both = chunks.join(found, ["key", "chunk"])
    cut = F.coalesce("cut", F.length("piece"))
    parts = F.array(
        F.struct((F.col("unit") - F.col("cut").isNotNull().cast("int")).alias("unit"), F.col("first_line"), F.substring("piece", F.lit(1), cut).alias("piece")),
        F.struct(
            F.col("unit"),
            (F.col("first_line") + F.length(F.regexp_replace(F.substring("piece", F.lit(1), cut), "[^\n]", ""))).cast("int").alias("first_line"),
            F.substring("piece", cut + 1, F.length("piece")).alias("piece"),
        ),
    )
    rows = both.select("key", "language", "chunk", F.posexplode(parts).alias("half", "p")).where(F.length("p.piece") > 0)
    text = rows.groupBy("key", "language", "p.unit").agg(
        F.min("p.first_line").alias("first_line"), F.array_join(F.array_sort(F.collect_list(F.struct("chunk", "half", "p.piece")))["piece"], "").alias("text")
    )
    return text.select("key", "language", "first_line", "text")


def _parsed(batches, size: int | None = None, sources: bool = True):
    """``masked`` text and statements of every unit; begin, end and lines counted within the unit.

    A text above ``size`` characters is left as it is, ``masked`` null. Without ``sources`` a statement's
    text is null, unless its name may have to be read from it.
    """
    item = pa.list_(pa.struct([("a", pa.int32()), ("ln", pa.int32()), ("end_ln", pa.int32()), ("z", pa.int32()), ("name_ln", pa.int32()), ("head", pa.string()), ("stop", pa.string()), ("doc", pa.string()), ("source", pa.string())]))
    names = pa.list_(pa.struct([(c, pa.string()) for c in ("alias", "name", "module")]))
    for b in (part for whole in batches for part in text_slices(whole, "text")):
        masks, found, imported = [], [], []
        for text, language in zip(b.column("text").to_pylist(), b.column("language").to_pylist()):
            if size is not None and len(text) > size:
                masks.append(None), found.append([]), imported.append([])
                continue
            comments: list = []
            masked, _ = lex.lex(text, language, comments=comments)
            some = lex.python_statements(text, masked) if language == "python" else lex.statements(text, masked, language, comments)
            rows, at, ln = [], 0, 1
            for a, z, head, stop, doc, name in sorted(some):
                ln += text.count("\n", at, a)
                at = a
                rows.append((a, ln, ln + text.count("\n", a, z), z, ln + text.count("\n", a, name), head, stop, doc, text[a:z] if sources or "[]" in head else None))
            masks.append(masked)
            imported.append([dict(zip(("alias", "name", "module"), x)) for x in lex.imports(text, masked, language)])
            found.append([dict(zip(("a", "ln", "end_ln", "z", "name_ln", "head", "stop", "doc", "source"), r)) for r in rows])
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), b.column("language"), b.column("first_line"), b.column("text"), pa.array(masks, pa.string()), pa.array(found, item), pa.array(imported, names)],
            names=["key", "language", "first_line", "text", "masked", "statements", "imports"],
        )


def units(files: DataFrame, *, key: str = "file_path", text_col: str = "content", lang_col: str = "language", chunk_chars: int | None = None, sources: bool = True) -> DataFrame:
    """``key, language, first_line, text, masked, statements, imports`` per unit, written once.

    Files of another language than the four, and null texts, have no unit. Units without ``sources``
    are for ``names_of`` alone.
    """
    spark, size = files.sparkSession, chunk_chars or CHUNK_CHARS
    ship_package(spark)
    checkpoint_dir(spark)
    rows = files.select(F.col(key).alias("key"), F.col(lang_col).alias("language"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("language").isin(*CLASS_HEAD) & F.col("text").isNotNull())
    items = "array<struct<a:int,ln:int,end_ln:int,z:int,name_ln:int,head:string,stop:string,doc:string,source:string>>"
    schema = f"{_key(rows)}, language string, first_line int, text string, masked string, statements {items}, imports array<struct<alias:string,name:string,module:string>>"
    # one pass over the files: those above the size go through it unread
    whole = rows.select("key", "language", F.lit(0).alias("first_line"), "text")
    parsed = staged(whole.mapInArrow(lambda batches: _parsed(batches, size, sources), schema), "units")
    large = parsed.where("masked is null").select("key", "language", "text")
    if large.isEmpty():
        return parsed
    chunks = _chunks(large, size).repartition("key", "chunk").checkpoint(eager=True)
    cut = staged(_joined_units(chunks).mapInArrow(lambda batches: _parsed(batches, None, sources), schema), "units")
    return parsed.where("masked is not null").unionByName(cut)


def lines_of(parsed: DataFrame, key: str = "file_path") -> DataFrame:
    """``file, language, ln, line, masked, is_code`` from units; the line that only ends a unit is left out."""
    both = F.arrays_zip(F.split("text", "\n", -1).alias("line"), F.split("masked", "\n", -1).alias("masked"))
    rows = parsed.select(F.col("key").alias(key), "language", "first_line", F.posexplode(both).alias("pos", "l"))
    rows = rows.where((F.col("l.line") != "") | (F.col("pos") == 0))
    return rows.select(
        key, "language", (F.col("first_line") + F.col("pos") + 1).cast("int").alias("ln"), F.col("l.line").alias("line"), F.col("l.masked").alias("masked"),
        F.col("l.masked").rlike(r"\S").alias("is_code"),
    )


def code_lines_of(parsed: DataFrame, key: str = "file_path") -> DataFrame:
    """``file, language, ln, masked, is_code``: the lines of ``lines_of`` that hold code, without their text."""
    rows = parsed.select(F.col("key").alias(key), "language", "first_line", F.posexplode(F.split("masked", "\n", -1)).alias("pos", "masked"))
    rows = rows.where(F.col("masked").rlike(r"\S"))
    return rows.select(key, "language", (F.col("first_line") + F.col("pos") + 1).cast("int").alias("ln"), "masked", F.lit(True).alias("is_code"))


def line_table(files: DataFrame, *, key: str = "file_path", text_col: str = "content", lang_col: str = "language", chunk_chars: int | None = None) -> DataFrame:
    """One row per line that isn't empty, with strings and comments blanked in ``masked``."""
    return lines_of(units(files, key=key, text_col=text_col, lang_col=lang_col, chunk_chars=chunk_chars), key)


def definitions(parsed: DataFrame) -> DataFrame:
    """``key, language, unit, begin, end, kind, name, doc, source, start_line, end_line``."""
    lang = F.col("language")
    # the types of a unit are found once, not again for each of its statements
    own = F.filter(F.transform("statements", lambda s: F.regexp_extract(s["head"], JAVA_TYPE_NAME, 1)), lambda n: n != "")
    rows = parsed.select("key", "language", F.col("first_line").alias("unit"), F.when(lang == "java", own).alias("own"), "statements")
    rows = rows.select("key", "language", "unit", "own", F.explode("statements").alias("s"))
    head, block = F.col("s.head"), F.col("s.stop") == "{"
    # every step is a column of its own, and asked more than once it is evaluated once
    rows = rows.withColumn("cname", _by_language(lang, CLASS_HEAD, lambda p: F.regexp_extract(head, p, 1)))
    rows = rows.withColumn("mname", _by_language(lang, METHOD_HEAD, lambda p: F.regexp_extract(head, p, 1)))
    # a name and brackets without a type before them: a constructor where a type has that name
    rows = rows.withColumn("bare", F.when((lang == "java") & (F.col("mname") == "") & block, F.regexp_extract(head, JAVA_CONSTRUCTOR, 1)).otherwise(""))
    mname = F.when((lang == "java") & (F.col("mname") == ""), F.when(F.array_contains("own", F.col("bare")), F.col("bare")).otherwise("")).otherwise(F.col("mname"))
    rows = rows.withColumn("mname", mname)
    rows = rows.withColumn("mname", F.when(F.col("mname") == "[]", F.regexp_extract("s.source", COMPUTED_NAME, 1)).otherwise(F.col("mname")))
    cname, mname = F.col("cname"), F.col("mname")
    is_class = (cname != "") & (block | lang.isin("python", "rust"))
    # what a semicolon ends is a definition in Java alone (abstract, native, of an interface)
    is_method = (mname != "") & (block | lang.isin("python", "java")) & ~(lang.isin("java", "javascript") & mname.isin(*NOT_A_NAME))
    kind = F.when(is_class, F.struct(F.lit("class").alias("kind"), cname.alias("name"))).when(is_method, F.struct(F.lit("method").alias("kind"), mname.alias("name")))
    # exploded, so that the filter behind it isn't moved before the steps and doesn't repeat them
    rows = rows.select("key", "language", "unit", "s", F.explode(F.array(kind)).alias("d")).where(F.col("d").isNotNull())
    return rows.select(
        "key", "language", "unit", F.col("s.a").alias("begin"), F.col("s.z").alias("end"), F.col("d.kind").alias("kind"), F.col("d.name").alias("name"), F.col("s.doc").alias("doc"), F.col("s.source").alias("source"),
        (F.col("unit") + F.col("s.name_ln")).cast("int").alias("name_line"), (F.col("unit") + F.col("s.ln")).cast("int").alias("start_line"), (F.col("unit") + F.col("s.end_ln")).cast("int").alias("end_line"),
    )


def extract_definitions(files: DataFrame, *, key: str = "file_path", text_col: str = "content", lang_col: str = "language", enclosing: str = "outer", chunk_chars: int | None = None):
    """``(classes, methods)``; see ``extract_all``."""
    _, classes, methods = extract_all(files, key=key, text_col=text_col, lang_col=lang_col, enclosing=enclosing, chunk_chars=chunk_chars)
    return classes, methods


def extract_all(files: DataFrame, *, key: str = "file_path", text_col: str = "content", lang_col: str = "language", enclosing: str = "outer", chunk_chars: int | None = None):
    """``(lines, classes, methods)`` DataFrames from a table of source files.

    classes: ``file_path, class_name, constructor_declaration, method_declarations,
    source_code, start_line, end_line, language, name_line``.
    methods: ``file_path, class_name, name, doc_comment, source_code, start_line,
    end_line, language, name_line`` (the line that the name stands on).
    """
    return entities_of(units(files, key=key, text_col=text_col, lang_col=lang_col, chunk_chars=chunk_chars), key=key, enclosing=enclosing)


def _held(classes: DataFrame, methods: DataFrame, *more: Column) -> DataFrame:
    """Every method with each class around it.

    Containment as an equi-join: every class is exploded into the lines it covers, and a method
    meets the classes that cover its first line (then the places themselves are compared).
    """
    c = classes.select(
        F.col("key").alias("_k"), F.col("unit").alias("_u"), F.col("begin").alias("_a"), F.col("end").alias("_z"), F.col("name").alias("_n"),
        F.explode(F.sequence("start_line", "end_line")).alias("_l"),
    )
    m = methods.select("key", "unit", "begin", "end", "start_line", *more)
    return m.join(c, (m["key"].eqNullSafe(c["_k"])) & (m["unit"] == c["_u"]) & (m["start_line"] == c["_l"])).where("_a < begin and end <= _z")


def _with_class(methods: DataFrame, pairs: DataFrame, enclosing: str) -> DataFrame:
    """``methods`` with the ``class_name`` of the outermost or innermost class around each, else ``""``."""
    place = ["key", "unit", "begin"]
    pick = F.min_by if enclosing == "outer" else F.max_by
    encl = pairs.groupBy(*place).agg(pick("_n", "_a").alias("class_name"))
    e = encl.select(*[F.col(x).alias(f"_e{x}") for x in place], "class_name")
    found = methods.join(e, methods["key"].eqNullSafe(e["_ekey"]) & (methods["unit"] == e["_eunit"]) & (methods["begin"] == e["_ebegin"]), "left")
    return found.withColumn("class_name", F.coalesce("class_name", F.lit("")))


def names_of(parsed: DataFrame, *, key: str = "file_path", enclosing: str = "outer"):
    """``(lines, classes, methods)`` as ``entities_of``, without any text: for references and calls.

    lines: those with code, ``masked`` alone. classes and methods: ``file_path, class_name`` (``name``),
    ``start_line, end_line, language, name_line``; both are written once, as every step asks them.
    """
    defs = staged(definitions(parsed).drop("source", "doc"), "definitions")
    classes, methods = defs.where("kind = 'class'"), defs.where("kind = 'method'")
    places = ["start_line", "end_line", "language", "name_line"]
    methods_out = _with_class(methods, _held(classes, methods), enclosing).select(F.col("key").alias(key), "class_name", "name", *places)
    classes_out = classes.select(F.col("key").alias(key), F.col("name").alias("class_name"), *places)
    return code_lines_of(parsed, key), classes_out, staged(methods_out, "methods")


def entities_of(parsed: DataFrame, *, key: str = "file_path", enclosing: str = "outer"):
    """``(lines, classes, methods)`` of units; see ``extract_all``."""
    defs = staged(definitions(parsed), "definitions")
    classes, methods = defs.where("kind = 'class'"), defs.where("kind = 'method'")
    pairs = _held(classes, methods, F.col("source").alias("_text"))
    # only the methods' places and class names, and the classes' method texts, are shuffled
    decl = pairs.groupBy("_k", "_u", "_a").agg(F.array_join(F.array_sort(F.collect_list(F.struct("begin", "_text")))["_text"], K.METHOD_DECL_SEPARATOR).alias("method_declarations"))
    methods_out = _with_class(methods, pairs, enclosing).select(
        F.col("key").alias(key), "class_name", "name", F.col("doc").alias("doc_comment"), F.col("source").alias("source_code"), "start_line", "end_line", "language", "name_line"
    )
    classes_out = classes.join(decl, classes["key"].eqNullSafe(decl["_k"]) & (classes["unit"] == decl["_u"]) & (classes["begin"] == decl["_a"]), "left").select(
        F.col("key").alias(key), F.col("name").alias("class_name"), F.lit("").alias("constructor_declaration"), F.coalesce("method_declarations", F.lit("")).alias("method_declarations"),
        F.col("source").alias("source_code"), "start_line", "end_line", "language", "name_line"
    )
    return lines_of(parsed, key), classes_out, methods_out


def imports_of(parsed: DataFrame, key: str = "file_path") -> DataFrame:
    """``file, language, alias, name, module`` per imported name."""
    return parsed.select(F.col("key").alias(key), "language", F.explode("imports").alias("i")).select(key, "language", "i.*").distinct()


def name_vocabulary(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Distinct ``(kind, name)`` over all languages, before any dedupe."""
    return (
        classes.select(F.lit("class").alias("kind"), F.col("class_name").alias("name"))
        .unionByName(methods.select(F.lit("method").alias("kind"), F.col("name")))
        .distinct()
    )
