"""Scalar text expressions. Every function takes and returns a ``Column`` and stays
inside the JVM (no Python per row), so Catalyst can push filters on them and
whole-stage codegen can fuse them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# Whitespace as Python's ``str.isspace`` sees it, written so that both Java regex
# and RE2 read it the same way (the oracle SQL uses the same class).
WS_CLASS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# A token for counting and clipping: a maximal run of non-whitespace, where
# whitespace is the ASCII set (tab, LF, VT, FF, CR, space), spelled out so that Java
# regex and RE2 agree on vertical tab.
ASCII_WS = r"[\x{09}-\x{0D}\x{20}]"
NON_WS = r"[^\x{09}-\x{0D}\x{20}]"
TOKEN_PIECE = f"({ASCII_WS}*{NON_WS}+)"
WORD = f"{NON_WS}+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(_c(col), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def words(col) -> Column:
    """Whitespace-separated tokens."""
    return F.regexp_extract_all(_c(col), F.lit(WORD), 0)


def token_count(col) -> Column:
    """Number of tokens (default tokenizer: whitespace words)."""
    return F.size(words(col)).cast("bigint")


def clip_tokens(col, max_tokens: int) -> Column:
    """First ``max_tokens`` tokens of the text, unchanged when it has no more.

    The clipped prefix ends at the end of the last kept token, so clipping is
    idempotent and never reorders text. The pieces are ``whitespace* token``; a
    single bounded regex over thousands of repetitions would overflow the regex
    engine's stack, so the text is split and the first N pieces re-joined.
    """
    c = _c(col)
    pieces = F.regexp_extract_all(c, F.lit(TOKEN_PIECE), 1)
    # more tokens need twice as many characters, less one: shorter texts are not split
    return F.when((F.length(c) > 2 * max_tokens) & (F.size(pieces) > max_tokens), F.array_join(F.slice(pieces, 1, max_tokens), "")).otherwise(c)


def clip_chars(col, n: int = K.CONTEXT_CHARS) -> Column:
    """First ``n`` characters (code points)."""
    return F.substring(_c(col), 1, n)


def preview(col, n: int = K.PREVIEW_CHARS) -> Column:
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def normalize_whitespace(col) -> Column:
    """Newlines and tabs to spaces, runs of whitespace to one space, then strip."""
    c = F.translate(_c(col), "\n\t", "  ")
    return strip_ws(F.regexp_replace(c, f"{WS_CLASS}+", " "))


def to_bool(col) -> Column:
    """``True``/``'true'``/``'True'``/``'1'``/``1`` → true; anything else (or missing) → false."""
    return F.coalesce(_c(col).cast("string").isin("true", "True", "1"), F.lit(False))


def has_directive(col, directive: str = K.CONTEXT_DIRECTIVE) -> Column:
    return F.coalesce(_c(col).contains(directive), F.lit(False))


def strip_directive(col, directive: str = K.CONTEXT_DIRECTIVE) -> Column:
    """Remove every occurrence of the directive, then strip the ends."""
    return strip_ws(F.replace(_c(col), F.lit(directive), F.lit("")))


def json_entry(query, response) -> Column:
    """``{"query": ..., "response": ...}`` as JSON text."""
    return F.to_json(F.struct(_c(query).alias("query"), _c(response).alias("response")), {"ignoreNullFields": "false"})


def json_entry_schema() -> str:
    return "query string, response string"


def fill_template(template: str, **slots) -> Column:
    """Fill ``{name}`` slots of a fixed template with column values in one pass.

    The template is a constant, so it is cut at its slot markers on the driver and
    the pieces are concatenated with the slot columns. Slot values are never
    scanned again, so corpus or user text containing ``{query}`` stays as it is.
    """
    parts = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.group(1) not in slots:
            continue
        parts.append(F.lit(template[pos : m.start()]))
        parts.append(F.coalesce(_c(slots[m.group(1)]).cast("string"), F.lit("")))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def extract_tagged(col, tag: str = "query") -> Column:
    """Text inside the first ``<tag>...</tag>`` pair (empty when absent)."""
    return F.regexp_extract(_c(col), f"(?s)<{tag}>(.*?)</{tag}>", 1)


def last_path_segment(col) -> Column:
    """``basename(normpath(path))``: last non-empty ``/`` segment."""
    trimmed = F.regexp_replace(_c(col), "/+$", "")
    return F.element_at(F.split(trimmed, "/"), -1)
