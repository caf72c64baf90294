"""Text splitters (A5-A8); A5 to A7 are native per-row expressions, all are map only:

* ``fixed_chunks`` (A5): equal-size character windows with optional overlap —
  ``sequence`` of start offsets, ``explode``, ``substring``.
* ``token_chunks`` (A6): windows of n whitespace tokens over the token pieces.
* ``recursive_chunks`` (A7): separator priority ``\\n\\n`` → ``\\n`` → ``. `` → `` `` → characters;
  a stretch longer than the limit is split by the next separator, then stretches are
  greedily packed into chunks of at most ``size`` characters (a per-row fold over their
  lengths, no shuffle).
* ``line_sections`` (A8): a header line (markdown ``#``) or a blank line starts a
  section, fenced blocks are left whole, and a section knows the headings above it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.batches import text_slices
from ..session import ship_package


def fixed_chunks(df: DataFrame, *, id_col: str, text_col: str, size: int, overlap: int = 0) -> DataFrame:
    """``(id, chunk_no, start, chunk)``; chunk_no and start are 1-based."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    n = F.length(text_col)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(step))).otherwise(F.array())
    out = df.select(id_col, text_col, F.posexplode(starts).alias("pos", "start"))
    return out.select(
        id_col,
        (F.col("pos") + 1).cast("bigint").alias("chunk_no"),
        F.col("start").cast("bigint").alias("start"),
        F.expr(f"substring({text_col}, start, {size})").alias("chunk"),
    )


def token_chunks(df: DataFrame, *, id_col: str, text_col: str, n_tokens: int) -> DataFrame:
    """``(id, chunk_no, n, chunk)``: consecutive windows of ``n_tokens`` tokens
    (whitespace between tokens kept, leading whitespace of a window dropped)."""
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(tx.TOKEN_PIECE), 1)
    t = df.select(id_col, pieces.alias("_p"))
    starts = F.when(F.size("_p") > 0, F.sequence(F.lit(1), F.size("_p"), F.lit(n_tokens))).otherwise(F.array())
    t = t.select(id_col, "_p", F.posexplode(starts).alias("pos", "s"))
    sl = F.slice("_p", F.col("s"), n_tokens)
    return t.select(
        id_col,
        (F.col("pos") + 1).cast("bigint").alias("chunk_no"),
        F.size(sl).cast("bigint").alias("n"),
        F.regexp_replace(F.array_join(sl, ""), "^" + tx.ASCII_WS + "+", "").alias("chunk"),
    )


SEPARATORS = ["\n\n", "\n", ". ", " "]


def _split_level(piece, size: int, level: int):
    """``piece`` cut into stretches of at most ``size`` characters, by separator priority.

    A separator stays at the end of the stretch before it: the stretches joined are the text.
    """
    if level >= len(SEPARATORS):
        starts = F.sequence(F.lit(1), F.greatest(F.length(piece), F.lit(1)), F.lit(size))
        return F.transform(starts, lambda s: F.substring(piece, s, size))
    sep = SEPARATORS[level].replace(".", r"\.")
    parts = F.filter(F.split(piece, f"(?<={sep})", -1), lambda p: F.length(p) > 0)
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(_split_level(p, size, level + 1))))


def recursive_chunks(df: DataFrame, *, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(id, chunk_no, start, chunk)``: recursive split, then greedy packing up to ``size``.

    Chunks are stretches of the text (``start`` is the 1-based position); joined in order
    they are the text. The packing is a fold over the lengths of the stretches that yields
    the chunks' ends; the text is cut once at the end.
    """
    sizes = F.transform(_split_level(F.col(text_col), size, 0), F.length)
    init = F.struct(F.lit(0).alias("at"), F.lit(0).alias("held"), F.lit("").alias("cuts"))

    def step(acc, n):
        fits = acc["held"] + n <= size
        cuts = F.when(fits | (acc["held"] == 0), acc["cuts"]).otherwise(F.concat(acc["cuts"], F.lit(","), acc["at"].cast("string")))
        return F.struct((acc["at"] + n).alias("at"), F.when(fits, acc["held"] + n).otherwise(n).alias("held"), cuts.alias("cuts"))

    cuts = F.aggregate(sizes, init, step, lambda acc: F.concat(F.lit("0"), acc["cuts"], F.lit(","), acc["at"].cast("string")))
    ends = df.where(F.length(text_col) > 0).select(id_col, text_col, F.transform(F.split(cuts, ","), lambda c: c.cast("int")).alias("_e"))
    parts = F.transform(F.sequence(F.lit(1), F.size("_e") - 1), lambda i: F.struct(F.element_at("_e", i).alias("a"), F.element_at("_e", i + 1).alias("z")))
    out = ends.select(id_col, text_col, F.posexplode(parts).alias("pos", "p"))
    return out.select(
        id_col,
        (F.col("pos") + 1).cast("bigint").alias("chunk_no"),
        (F.col("p.a") + 1).cast("bigint").alias("start"),
        F.col(text_col).substr(F.col("p.a") + 1, F.col("p.z") - F.col("p.a")).alias("chunk"),
    )


_HEADER = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_BLANKS = "\t\n\x0b\x0c\r "


def _sections(text: str) -> list[tuple]:
    """(section, first line, number of lines, text, level, heading, path) of one text."""
    out, held, above = [], [], []
    fence, before = "", True
    for i, line in enumerate(text.split("\n"), 1):
        m = _FENCE.match(line) if "```" in line or "~~~" in line else None
        inside = bool(fence)
        if m and not fence:
            fence = m.group(1)
        elif m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not m.group(2).strip(_BLANKS):
            fence = ""
        if not inside and not line.strip(_BLANKS):
            before = True
            continue
        header = _HEADER.match(line) if line[:1] == "#" and not inside else None
        if before or header:
            level = len(header.group(1)) if header else 0
            heading = header.group(2) if header else ""
            if header:
                above = [x for x in above if x[0] < level] + [(level, heading)]
            held.append([i, [], level, heading, [x for _, x in above]])
        held[-1][1].append(line)
        before = False
    for k, (i, lines, level, heading, path) in enumerate(held, 1):
        out.append((k, i, len(lines), "\n".join(lines), level, heading, path))
    return out


def line_sections(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """``(id, section, first_line, n_lines, text, level, heading, path)``.

    A section starts at a header line (one to six ``#`` and a blank) or after a blank line;
    blank lines are part of no section. Between fences (a line of three or more backticks or
    tildes, up to a bare line of the same sign at least as long, or the end) no line is a
    header and a blank line ends nothing. ``level`` and ``heading`` are those of the section's own
    header (0 and ``""`` without one), ``path`` the headings it stands under, its own included.

    A text is one row already, so it is cut where it lies: map only, no shuffle, and every row
    stays a document of its own, also where ids are equal or null. A null text has no section.
    """
    ship_package(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    fields = [("section", pa.int64()), ("first_line", pa.int64()), ("n_lines", pa.int64()), ("text", pa.string()), ("level", pa.int32()), ("heading", pa.string()), ("path", pa.list_(pa.string()))]

    def run(batches):
        for b in (part for whole in batches for part in text_slices(whole, "text")):
            found = [_sections(text) for text in b.column("text").to_pylist()]
            at = pa.array([i for i, some in enumerate(found) for _ in some], pa.int64())
            columns = list(map(list, zip(*(x for some in found for x in some)))) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), *(pa.array(c, t) for c, (_, t) in zip(columns, fields))], names=["id", *(n for n, _ in fields)])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, section bigint, first_line bigint, n_lines bigint, text string, level int, heading string, path array<string>")
    return out.withColumnRenamed("id", id_col)
