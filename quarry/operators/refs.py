"""Cross-corpus references.

* ``identifier_occurrences`` (R1): every identifier with file, 1-based line and
  1-based character column, the characters and the word beside it. One pass over each
  Arrow batch: all its lines are one text, a regex gives the identifiers' places, and lines,
  columns and neighbours follow from arrays of places. Map only.
* ``construct`` names the position of an identifier: ``import``, ``construction``, ``type``,
  ``call``, ``attribute`` or plain ``name``.
* ``match_references`` (R2, R3): equi-join with the name vocabulary; adaptive execution
  measures the vocabulary and broadcasts it or splits hot names. Classes count in
  construction and type position, methods where they are called.
* ``imports`` and ``resolve_references``: which definition a reference means, by the scopes
  around it, the imports of its file, then a name that is defined only once.
* ``group_references`` / ``render_references`` (R4, R10): ordered ``file:line:column``
  lists. Rendering is two-level — per ``(name, file)`` first (bounded by one file),
  then file chunks in file order — so the expensive sort/format work of a popular
  name is spread over many tasks.
* ``attach_references`` (R8, R9): equi-join on the name; a missing name gives ``""``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.batches import text_slices
from ..session import checkpoint_dir, ship_package

IDENT_CHARS = r"\p{L}\p{N}\p{M}_$"
DEFINITION_KEYWORDS = ["def", "class", "fn", "struct", "function", "enum", "interface", "trait", "record"]
NEIGHBOURS = ["next_char", "next_two", "prev_char", "prev_token", "qualifier", "first_token"]


def _places(lines: list[str], word) -> tuple:
    """Flat arrays over all identifiers of the lines, in order: line index, column, token."""
    row, column, token = [], [], []
    for i, line in enumerate(lines):
        for m in word.finditer(line):
            row.append(i)
            column.append(m.start() + 1)
            token.append(m.group())
    return np.array(row, np.int64), np.array(column, np.int64), token


def _occurrences(lines: list[str], word) -> tuple:
    """As ``_places``, then the neighbours: NEIGHBOURS, but ``next_char``, the begin of ``next_two``."""
    text = "\n".join(lines) + "\n"
    spans = np.array([m.span() for m in word.finditer(text)], np.int64).reshape(-1, 2)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    begin = np.cumsum(size) - size
    a, z = spans[:, 0], spans[:, 1]
    row = np.searchsorted(begin, a, side="right") - 1
    # places that aren't blank: the neighbours of a place on its own line
    solid = np.nonzero(~np.isin(points, np.array([9, 10, 11, 12, 13, 32], np.uint32)))[0]
    after = np.searchsorted(solid, z)
    after = np.where(after < len(solid), solid[np.minimum(after, max(0, len(solid) - 1))], len(points))
    has_next = after < (begin + size)[row] - 1
    before = np.searchsorted(solid, a) - 1
    before = np.where(before >= 0, solid[np.maximum(before, 0)], -1)
    has_prev = before >= begin[row]
    second = np.where(has_next & (after + 1 < (begin + size)[row] - 1), after + 1, -1)
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    adjacent = np.concatenate([[False], (before[1:] == z[:-1] - 1)]) & ~first if len(row) else first
    token = [text[x:y] for x, y in spans.tolist()]
    char = lambda at, ok: [text[i] if k else "" for i, k in zip(at.tolist(), ok.tolist())]
    prev = [token[i - 1] if k else None for i, k in enumerate(adjacent.tolist())]
    # the identifier before a dot or a double colon that stands before this one
    mark = np.where(has_prev, points[np.maximum(before, 0)], 0) if len(row) else before
    gap = before - np.concatenate([[-9], z[:-1]]) if len(row) else before
    double = (mark == 58) & (points[np.maximum(before - 1, 0)] == 58) if len(row) else first
    qualified = (((mark == 46) & (gap == 0)) | (double & (gap == 1))) & ~first
    qualifier = [token[i - 1] if k else None for i, k in enumerate(qualified.tolist())]
    head = np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)).tolist() if len(row) else []
    follow = [x + y for x, y in zip(char(after, has_next), char(second, second >= 0))]
    return row, a - begin[row] + 1, token, follow, char(before, has_prev), prev, qualifier, [token[i] for i in head]


def identifier_occurrences(lines: DataFrame, *, key: str = "file_path", text_col: str = "masked", chars: str = IDENT_CHARS, neighbours: bool = True) -> DataFrame:
    """``(file, line, column, token, next_char, next_two, prev_char, prev_token, qualifier, first_token)`` for every identifier.

    ``next_char`` and ``prev_char`` are the nearest characters on the line that aren't blank
    (``""`` at its ends), ``next_two`` the next one and its right neighbour; ``prev_token`` the
    identifier before with nothing but blanks between, or null; ``qualifier`` the one that a dot
    or double colon joins to this one; ``first_token`` the line's first. Without ``neighbours``
    these six aren't looked for and have no column.
    """
    ship_package(lines.sparkSession)
    pattern = f"[{chars}]++"

    def run(batches):
        word = regex.compile(pattern)
        for b in (part for whole in batches for part in text_slices(whole, "text")):
            texts = [t or "" for t in b.column("text").to_pylist()]
            row, column, token, *more = (_occurrences if neighbours else _places)(texts, word)
            if more:
                more.insert(0, [x[:1] for x in more[0]])
            part = b.select(["key", "line"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(column.astype(np.int32)), *(pa.array(x, pa.string()) for x in (token, *more))],
                names=["key", "line", "column", "token", *(NEIGHBOURS if neighbours else [])],
            )

    rows = lines.select(F.col(key).alias("key"), F.col("ln").cast("int").alias("line"), F.col(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    names = ", ".join(["column int", "token string", *(f"{c} string" for c in NEIGHBOURS if neighbours)])
    return rows.mapInArrow(run, f"key {kind}, line int, {names}").withColumnRenamed("key", key)


def construct(language: Column) -> Column:
    """The kind of place an identifier stands in, from its neighbours on the line."""
    nxt, two, prev, first = (F.col(c) for c in ("next_char", "next_two", "prev_char", "first_token"))
    word = F.coalesce("prev_token", F.lit(""))
    call = nxt == "("
    named = nxt.rlike(r"^[\p{L}_$]")  # another identifier follows: a type before what it types
    after_type_word = word.isin("extends", "implements", "instanceof", "throws", "impl", "for", "dyn", "as", "mut")
    of = {
        "python": [("construction", call & (prev != ".")), ("type", prev.isin(":", ">") & ~call)],
        "java": [("construction", word == "new"), ("type", ~call & (after_type_word | (named & (prev != ".")) | (prev == "<") | (nxt == "<") | (two == "::")))],
        "javascript": [("construction", word == "new"), ("type", after_type_word & (word == "extends"))],
        "rust": [("construction", (nxt == "{") & ~after_type_word & (prev != ">")), ("type", ~call & (after_type_word | prev.isin(":", ">", "&", "<") | (nxt == "{") | (two == "::")))],
    }
    out = F.when(first.isin("import", "from", "use", "package"), "import")
    for name, rules in of.items():
        for kind, rule in rules:
            out = out.when((language == name) & F.coalesce(rule, F.lit(False)), kind)
    return out.when(call, "call").when(prev == ".", "attribute").otherwise("name")


def match_references(occ: DataFrame, vocab: DataFrame, *, key: str = "file_path", definitions: DataFrame | None = None) -> DataFrame:
    """Occurrences of vocabulary names in reference position.

    ``vocab``: ``(kind, name)``. A class name counts in construction and type position
    (anywhere, when ``occ`` has no column ``construct``), a method name when it is called
    (``name(``). ``definitions`` (``file, line, name``) marks definition sites to skip; a token
    right after a definition keyword is one by itself.
    """
    v = vocab.select("kind", F.col("name").alias("token"))
    m = occ.join(v, "token")  # adaptive execution measures the vocabulary and picks the join
    is_def = F.coalesce(F.col("prev_token").isin(*DEFINITION_KEYWORDS), F.lit(False))
    m = m.where(~is_def)
    if definitions is not None:
        d = definitions.select(F.col(key).alias("_df"), F.col("start_line").alias("_dl"), F.col("name").alias("_dn"))
        first = m.withColumn("_first", F.rank().over(Window.partitionBy(key, "line", "token").orderBy("column")) == 1)
        m = first.join(d, (first[key] == d["_df"]) & (first["line"] == d["_dl"]) & (first["token"] == d["_dn"]) & first["_first"], "left_anti").drop("_first")
    of_class = F.col("construct").isin("construction", "type") if "construct" in occ.columns else F.lit(True)
    of_method = F.col("next_char") == "("
    if "construct" in occ.columns:
        of_method = of_method & (F.col("construct") != "import") & ~F.coalesce(F.col("prev_token") == "new", F.lit(False))
    m = m.where(F.when(F.col("kind") == "class", of_class).otherwise(of_method))
    extra = [c for c in ("construct", "qualifier", "language") if c in occ.columns]
    return m.select("kind", F.col("token").alias("name"), F.col(key).alias("file"), "line", "column", *extra)


#: what a method calls its own object or type
OWN = ["self", "this", "cls", "Self", "super"]


def resolve_references(lines: DataFrame, classes: DataFrame, methods: DataFrame, imports: DataFrame, *, key: str = "file_path") -> DataFrame:
    """R1-R3 with the definition that each reference means.

    ``(kind, name, file, line, column, construct, target_file, target_class, target_line, scope)``;
    ``name`` is the name at its definition (an import may call it otherwise). In this order:

    * ``scope``: a definition of the file whose scope holds the line, the smallest scope first:
      the definition around it, else the file. Members of a class count behind ``self`` or ``this`` (in Java
      also bare); other definitions count without a qualifier;
    * ``import``: the name, or the module before it, is imported from the file that defines it;
    * ``unique``: the language has one definition of that name;
    * else the target is null.

    Every step is an equi-join on (file, name), (module, name) or the name of a single definition,
    so a name that every file defines meets only its own file's definitions.
    """
    cols = ["language", "name", "start_line", "end_line", "name_line"]
    c = classes.withColumnRenamed("class_name", "name").select(F.col(key).alias("f"), F.lit("class").alias("kind"), F.lit("").alias("class_name"), *cols)
    m = methods.select(F.col(key).alias("f"), F.lit("method").alias("kind"), "class_name", *cols)
    defs = c.unionByName(m)
    # the smallest definition around each definition
    around = defs.select(F.col("f").alias("_f"), F.col("kind").alias("_kind"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"), F.explode(F.sequence("start_line", "end_line")).alias("_l"))
    inside = defs.join(around, (F.col("f") == F.col("_f")) & (F.col("start_line") == F.col("_l")) & (F.col("_s") < F.col("start_line")) & (F.col("end_line") <= F.col("_e")))
    place = ["f", "kind", "name", "name_line", "start_line"]
    parent = inside.groupBy(*place).agg(F.max_by(F.struct("_kind", "_s", "_e"), "_s").alias("p"))
    checkpoint_dir(lines.sparkSession)
    defs = defs.join(parent, place, "left").checkpoint(eager=True)  # every step below asks the definitions
    target = F.struct(F.col("f").alias("file"), F.col("class_name").alias("class"), F.col("name_line").alias("line"))

    # a name counts where it is defined or imported under another one
    named = imports.select(F.col(key).alias("_if"), F.col("alias"), F.col("name").alias("_real"), "module").where("_real != ''")
    vocab = defs.select("kind", "name").distinct()
    aliases = named.join(vocab, named["_real"] == vocab["name"]).select("kind", F.col("alias").alias("name"))
    sites = defs.select(F.col("f").alias(key), F.col("name_line").alias("start_line"), "name")
    hits = match_references(code_occurrences(lines, key), vocab.unionByName(aliases).distinct(), key=key, definitions=sites)
    hits = hits.join(named, (hits["file"] == named["_if"]) & (hits["name"] == named["alias"]) & hits["qualifier"].isNull(), "left")
    hits = hits.withColumn("token", F.col("name")).withColumn("name", F.coalesce("_real", "name"))
    # an alias counts where what it names is defined somewhere
    hits = hits.join(vocab, ["kind", "name"], "left_semi")
    hits = hits.select("kind", "name", "token", "file", "line", "column", "construct", "qualifier", "language", F.col("module").alias("stem"))
    hits = hits.checkpoint(eager=True)  # both the scopes and the imports ask about every reference

    own = F.coalesce(F.col("qualifier").isin(*OWN), F.lit(False))
    site = ["kind", "name", "file", "line", "column"]
    d = defs.select(F.col("f").alias("_f"), F.col("kind").alias("_k"), F.col("name").alias("_n"), target.alias("t"), "p", F.coalesce("p._s", F.lit(0)).alias("_s"), F.coalesce("p._e", F.lit(2**31 - 1)).alias("_e"))
    member = F.coalesce(F.col("p._kind") == "class", F.lit(False)) & (F.col("_k") == "method")
    seen = F.when(member, own | (F.col("qualifier").isNull() & (F.col("language") == "java"))).otherwise(F.col("qualifier").isNull() | (own & (F.col("language") == "rust")))
    near = hits.join(d, (F.col("file") == F.col("_f")) & (F.col("token") == F.col("_n")) & (F.col("kind") == F.col("_k")))
    near = near.where((F.col("line") >= F.col("_s")) & (F.col("line") <= F.col("_e")) & seen)
    # among equals (overloads) the first one
    near = near.groupBy(*site).agg(F.min_by("t", F.struct((F.col("_e") - F.col("_s")).alias("a"), F.col("t.line").alias("b"))).alias("near"))

    modules = imports.where("name = ''").select(F.col(key).alias("_if"), F.col("alias").alias("_alias"), F.col("module").alias("_module"))
    hits = hits.join(modules, (hits["file"] == modules["_if"]) & (hits["qualifier"] == modules["_alias"]), "left").withColumn("stem", F.coalesce("stem", "_module"))
    stem = F.regexp_extract("f", r"([^/]+?)(?:\.[^./]*)?$", 1)
    there = defs.groupBy(stem.alias("_stem"), F.col("language").alias("_lang"), F.col("kind").alias("_k"), F.col("name").alias("_n")).agg(F.min(target).alias("far"))
    once = defs.groupBy(F.col("language").alias("_ul"), F.col("kind").alias("_uk"), F.col("name").alias("_un")).agg(F.count("*").alias("c"), F.min(target).alias("only")).where("c = 1")
    out = hits.join(near, site, "left")
    out = out.join(there, (out["stem"] == there["_stem"]) & (out["language"] == there["_lang"]) & (out["kind"] == there["_k"]) & (out["name"] == there["_n"]), "left")
    out = out.join(once, (out["language"] == once["_ul"]) & (out["kind"] == once["_uk"]) & (out["name"] == once["_un"]), "left")
    # what an import names is there or unknown; it isn't another definition of that name
    found = F.coalesce("near", "far", F.when(F.col("stem").isNull(), F.col("only")))
    scope = F.when(F.col("near").isNotNull(), "scope").when(F.col("far").isNotNull(), "import").when(F.col("stem").isNull() & F.col("only").isNotNull(), "unique")
    return out.select(*site, "construct", found["file"].alias("target_file"), found["class"].alias("target_class"), found["line"].alias("target_line"), scope.alias("scope"))


def _fmt(file_col, line_col, col_col):
    return F.concat_ws(":", file_col.cast("string"), line_col.cast("string"), col_col.cast("string"))


def render_by_file(refs: DataFrame, by: list[str] = ("kind", "name")) -> DataFrame:
    """R10 per file: ``(by…, file, n, refs)`` with ``file:line:column`` joined by ``; ``."""
    by = list(by)
    item = F.struct("line", "column", _fmt(F.col("file"), F.col("line"), F.col("column")).alias("t"))
    agg = refs.groupBy(*by, "file").agg(F.array_sort(F.collect_list(item)).alias("_p"), F.count(F.lit(1)).cast("bigint").alias("n"))
    return agg.select(*by, "file", "n", F.array_join(F.col("_p.t"), K.REFERENCE_SEPARATOR).alias("refs"))


def render_references(refs: DataFrame, by: list[str] = ("kind", "name")) -> DataFrame:
    """R4 + R10: one ``references`` string per name, files in path order."""
    by = list(by)
    chunks = render_by_file(refs, by)
    agg = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("file", "refs"))).alias("_c"), F.sum("n").cast("bigint").alias("n_refs"))
    return agg.select(*by, "n_refs", F.array_join(F.col("_c.refs"), K.REFERENCE_SEPARATOR).alias("references"))


def group_references(refs: DataFrame) -> DataFrame:
    """R4 nested form: ``(kind, name, refs array<struct<file,line,column>>)`` in order."""
    return refs.groupBy("kind", "name").agg(
        F.array_sort(F.collect_list(F.struct("file", "line", "column"))).alias("refs")
    )


def attach_references(entities: DataFrame, rendered: DataFrame, *, kind: str, name_col: str) -> DataFrame:
    """Every entity with that name gets the full list; none → ``""``."""
    r = rendered.where(F.col("kind") == kind).select(F.col("name").alias("_rn"), F.col("references").alias("_refs"))
    j = entities.join(r, entities[name_col] == r["_rn"], "left").drop("_rn")
    if "references" in entities.columns:
        j = j.drop("references")
    return j.withColumnRenamed("_refs", "references").withColumn("references", F.coalesce("references", F.lit("")))


def code_occurrences(lines: DataFrame, key: str = "file_path") -> DataFrame:
    """R1 over code lines, with the language and the construct of every identifier."""
    code = lines.where("is_code").select(F.struct(F.col(key).alias("k"), F.col("language").alias("l")).alias("_kl"), "ln", "masked")
    occ = identifier_occurrences(code, key="_kl", text_col="masked")
    occ = occ.select(F.col("_kl.k").alias(key), F.col("_kl.l").alias("language"), *[c for c in occ.columns if c != "_kl"])
    # a call on the value of an expression has a qualifier without a name
    occ = occ.withColumn("qualifier", F.coalesce("qualifier", F.when(F.col("prev_char") == ".", "?")))
    return occ.withColumn("construct", construct(F.col("language")))


def code_references(lines: DataFrame, classes: DataFrame, methods: DataFrame, key: str = "file_path") -> DataFrame:
    """R1-R3 for code: occurrences of extracted class/method names across the corpus."""
    from .extract import name_vocabulary

    defs = classes.select(key, F.col("name_line").alias("start_line"), F.col("class_name").alias("name"))
    defs = defs.unionByName(methods.select(key, F.col("name_line").alias("start_line"), "name"))
    return match_references(code_occurrences(lines, key), name_vocabulary(classes, methods), key=key, definitions=defs)
