"""Vector expressions on ``array<float|double>`` columns.

These are native higher-order expressions, used where vectors meet row by row
(rerank scores, validation, small joins). Corpus-wide nearest-neighbour search does
not use them: it multiplies whole Arrow batches against a bounded query block (see
``operators.search``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sq_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def cosine(a, b) -> Column:
    """``a·b / (|a||b|)``; 0 when either vector is all zeros."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def l2_sq(a, b) -> Column:
    diffs = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2(a, b) -> Column:
    return F.sqrt(l2_sq(a, b))


def is_valid_vector(v, dim: int) -> Column:
    """Right length, no null element, no NaN element."""
    c = _c(v)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x))
    return c.isNotNull() & (F.size(c) == dim) & ~bad


def token_buckets(tokens, dim: int) -> Column:
    """Each token to a bucket in ``[0, dim)``: first 32 bits of its MD5, modulo ``dim``."""
    return F.transform(
        _c(tokens),
        lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim)),
    )


# Token pattern for embedding and keyword scoring: runs of Unicode letters, digits
# and underscore, after lower-casing. Java regex and RE2 read it the same way.
TERM_PATTERN = r"[\p{L}\p{N}_]+"


def terms(text) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TERM_PATTERN), 0)
