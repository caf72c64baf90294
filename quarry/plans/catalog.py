"""Registered driver queries and their DuckDB oracles.

Each query reads whole driver tables and returns a lazy DataFrame. Oracle SQL
spells out the same semantics independently (no shared code), so the driver's
side-by-side run is a real check.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import bpe, chat, chunk, clean, embed, enrich, keyword, refs, rerank, search
from ..plugins import DefaultEnricher
from ..sources import answers, files, history
from ..session import scratch_path, ship_package
from . import answer, code_corpus, index, pivots
from ..sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "two_pass_context"

TEXT_DIM = 256
TERM = r"[\p{L}\p{N}_]+"


def register(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn

    return deco


def _r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------------------
# Vector search over `embeddings`; the queries are the mean vectors of the labels, so the
# query side does not grow with the corpus
# ---------------------------------------------------------------------------

def _label_means(emb: DataFrame) -> DataFrame:
    """The query side: the mean vector of every label, over the whole table."""
    parts = emb.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vecs = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x")))["x"].alias("query_vec"))
    return vecs.select(F.col("label").cast("bigint").alias("query_id"), "query_vec")


def _mean_knn(spark, sf, metric, corpus_filter=None):
    emb = table(spark, sf, "embeddings")
    corpus = emb if corpus_filter is None else emb.where(corpus_filter)
    res = search.vector_topk(corpus, _label_means(emb), id_col="vec_id", vec_col="embedding", metric=metric, k=5)
    val = "dist" if metric == "l2" else "score"
    return res.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), _r6(F.col(val)).alias(val))


_PAIRS_SQL = """
WITH mean AS (
  SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x
  FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY label, pos
), q AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY pos) AS embedding FROM mean GROUP BY label),
pairs AS (
  SELECT q.query_id, d.vec_id AS vec_id, {expr} AS v
  FROM q CROSS JOIN embeddings d {where}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, vec_id) AS rank FROM pairs
)
SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank, round({out}, 6) AS {name}
FROM ranked WHERE rank <= 5
"""

_D2 = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (q.embedding[i]::DOUBLE - d.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - d.embedding[i]::DOUBLE)))"
_DOT = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: q.embedding[i]::DOUBLE * d.embedding[i]::DOUBLE))"
_QN = "sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_DN = "sqrt(list_sum(list_transform(d.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_COS = f"CASE WHEN {_QN} * {_DN} > 0 THEN {_DOT} / ({_QN} * {_DN}) ELSE 0 END"


@register("vector_topk", _PAIRS_SQL.format(expr=_D2, where="", order="round(v, 9)", out="sqrt(v)", name="dist"))
def q_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """V1/V4: exact L2 top-5 for the mean vector of every label."""
    return _mean_knn(spark, sf, "l2")


@register("pivot_topk", _PAIRS_SQL.format(expr=_D2, where="", order="round(v, 9)", out="sqrt(v)", name="dist"))
def q_pivot_topk(spark: SparkSession, sf: str) -> DataFrame:
    """V1 on vectors stored by pivot and distance: the rows of ``vector_topk`` from pruned scans."""
    emb = table(spark, sf, "embeddings")
    root = scratch_path(spark, "pivots")
    dim = emb.where(F.col("embedding").isNotNull()).select(F.size("embedding")).first()[0]
    pivots.write_pivots(emb, root, id_col="vec_id", vec_col="embedding", dim=dim)
    res = pivots.pivot_topk(spark, root, _label_means(emb), k=5)
    return res.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("bigint").alias("rank"), _r6(F.col("dist")).alias("dist"))


@register("cosine_topk", _PAIRS_SQL.format(expr=_COS, where="", order="round(v, 9) DESC", out="v", name="score"))
def q_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """V2: cosine-similarity top-5."""
    return _mean_knn(spark, sf, "cosine")


@register("dot_topk", _PAIRS_SQL.format(expr=_DOT, where="", order="round(v, 9) DESC", out="v", name="score"))
def q_dot_topk(spark: SparkSession, sf: str) -> DataFrame:
    """V3: inner-product top-5."""
    return _mean_knn(spark, sf, "dot")


@register("prefiltered_topk", _PAIRS_SQL.format(expr=_COS, where="WHERE d.label = 3", order="round(v, 9) DESC", out="v", name="score"))
def q_prefiltered_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A3: metadata pre-filter on the corpus (pushed to the scan), then search."""
    return _mean_knn(spark, sf, "cosine", corpus_filter=F.col("label") == 3)


# ---------------------------------------------------------------------------
# Hashing embedder and text search over `documents` / `benchmark`
# ---------------------------------------------------------------------------

def _hash_sql(src: str, key: str, text: str, dim: int = TEXT_DIM, alias: str = "x") -> str:
    """CTEs ``{alias}_b(key, bucket, c)`` and ``{alias}_n(key, nrm)`` for a table."""
    return f"""
{alias}_t AS (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '{TERM}')) AS t FROM {src}),
{alias}_b AS (SELECT k, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS bucket, count(*) AS c FROM {alias}_t GROUP BY ALL),
{alias}_n AS (SELECT k, sqrt(sum(c * c)) AS nrm FROM {alias}_b GROUP BY ALL)"""


@register(
    "hash_embed",
    f"""
WITH {_hash_sql('documents', 'doc_id', 'text', alias='d')}
SELECT d_b.k AS doc_id, d_b.bucket AS bucket, round(d_b.c / d_n.nrm, 6) AS weight
FROM d_b JOIN d_n USING (k)
""",
)
def q_hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Every document to a normalised hashed term vector (sparse long form)."""
    emb = embed.HashingEmbedder(dim=TEXT_DIM)
    docs = emb.embed(table(spark, sf, "documents").select("doc_id", "text"), "text", "vec")
    return embed.explode_vector(docs, ["doc_id"], "vec").select("doc_id", "bucket", _r6(F.col("weight")).alias("weight"))


def _cosine_pairs_sql(qsrc, qkey, qtext, dsrc, dkey, dtext):
    return f"""
WITH {_hash_sql(qsrc, qkey, qtext, alias='q')},
{_hash_sql(dsrc, dkey, dtext, alias='d')},
dots AS (SELECT q_b.k AS qk, d_b.k AS dk, sum(q_b.c * d_b.c) AS g FROM q_b JOIN d_b USING (bucket) GROUP BY ALL),
pairs AS (
  SELECT q.{qkey} AS query_id, d.{dkey} AS {dkey},
         CASE WHEN q_n.nrm > 0 AND d_n.nrm > 0 THEN coalesce(dots.g, 0) / (q_n.nrm * d_n.nrm) ELSE 0 END AS v
  FROM {qsrc} q CROSS JOIN {dsrc} d
  LEFT JOIN q_n ON q_n.k = q.{qkey} LEFT JOIN d_n ON d_n.k = d.{dkey}
  LEFT JOIN dots ON dots.qk = q.{qkey} AND dots.dk = d.{dkey}
)"""


@register(
    "text_search",
    _cosine_pairs_sql("benchmark", "item_id", "text", "documents", "doc_id", "text")
    + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(v, 9) DESC, doc_id) AS rank FROM pairs)
SELECT query_id, doc_id, CAST(rank AS BIGINT) AS rank, round(v, 6) AS score FROM ranked WHERE rank <= 5
""",
)
def q_text_search(spark: SparkSession, sf: str) -> DataFrame:
    """M0 / A10: every benchmark question against every document, top-5 by cosine."""
    emb = embed.HashingEmbedder(dim=TEXT_DIM, sparse=True)
    docs = table(spark, sf, "documents")
    qs = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    res = search.text_search(docs, qs, emb, id_col="doc_id", text_col="text", query_id="query_id", query_text="query_text", k=5, metric="cosine")
    return res.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), _r6(F.col("score")).alias("score"))


# ---------------------------------------------------------------------------
# Text functions over `documents`
# ---------------------------------------------------------------------------

_NONWS = r"[^\x{09}-\x{0D}\x{20}]"
_AWS = r"[\x{09}-\x{0D}\x{20}]"
_UWS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_UWS}+|{_UWS}+$', '', 'g')"


@register(
    "token_count",
    f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_NONWS}+')) AS BIGINT) AS tokens FROM documents",
)
def q_token_count(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens per document (default whitespace tokenizer)."""
    return table(spark, sf, "documents").select("doc_id", tx.token_count("text").alias("tokens"))


def _clip_sql(n: int) -> str:
    return f"""
WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '({_AWS}*{_NONWS}+)', 1) AS pieces FROM documents)
SELECT doc_id, CASE WHEN len(pieces) > {n} THEN array_to_string(pieces[1:{n}], '') ELSE text END AS clipped,
       CAST(len(CASE WHEN len(pieces) > {n} THEN array_to_string(pieces[1:{n}], '') ELSE text END) AS BIGINT) AS clipped_chars
FROM p"""


def _clip_query(n: int):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        c = tx.clip_tokens("text", n)
        return table(spark, sf, "documents").select("doc_id", c.alias("clipped"), F.length(c).cast("bigint").alias("clipped_chars"))

    return q


register("clip_tokens", _clip_sql(K.MAX_TOKENS_SMALL))(_clip_query(K.MAX_TOKENS_SMALL))
register("clip_tokens_256", _clip_sql(256))(_clip_query(256))


@register("bpe_token_count")
def q_bpe_token_count(spark: SparkSession, sf: str) -> DataFrame:
    """P7 with a real vocabulary: BPE tokens per document; merges run once per distinct word."""
    import public_tokenizers as vocab

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.add_token_counts(docs, vocab.path("byte_bpe_50k.tiktoken"), pattern=vocab.PATTERN).drop("text")


@register("bpe_clip")
def q_bpe_clip(spark: SparkSession, sf: str) -> DataFrame:
    """P8 with a real vocabulary: the first 256 BPE tokens of every document."""
    import public_tokenizers as vocab

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.clip_to_tokens(docs, vocab.path("byte_bpe_50k.tiktoken"), 256, pattern=vocab.PATTERN).select("doc_id", "clipped")


@register(
    "clip_chars",
    f"""
SELECT doc_id, substring(text, 1, {K.CONTEXT_CHARS}) AS clipped,
       CASE WHEN length(text) > {K.PREVIEW_CHARS} THEN substring(text, 1, {K.PREVIEW_CHARS}) || '...' ELSE text END AS preview
FROM documents""",
)
def q_clip_chars(spark: SparkSession, sf: str) -> DataFrame:
    """P15 + P10: first 12,000 characters, and the 200-character preview."""
    return table(spark, sf, "documents").select("doc_id", tx.clip_chars("text").alias("clipped"), tx.preview("text").alias("preview"))


@register(
    "normalize_whitespace",
    f"SELECT doc_id, {_sql_strip(f'''regexp_replace(translate(text, chr(10) || chr(9), '  '), '{_UWS}+', ' ', 'g')''')} AS normalized FROM documents",
)
def q_normalize_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    """newline/tab → space, collapse whitespace runs, strip."""
    return table(spark, sf, "documents").select("doc_id", tx.normalize_whitespace("text").alias("normalized"))


# ---------------------------------------------------------------------------
# Cleaning and keep-last
# ---------------------------------------------------------------------------

def _docs_with_labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return docs.join(labels, "doc_id", "left")


@register(
    "fill_nulls",
    """
SELECT d.doc_id, coalesce(d.lang, 'empty') AS lang, coalesce(d.source, 'empty') AS source,
       coalesce(CAST(l.quality AS VARCHAR), 'empty') AS quality, coalesce(CAST(l.toxic AS VARCHAR), 'empty') AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def q_fill_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls (from the metadata gap) → 'empty'."""
    return clean.fill_nulls(_docs_with_labels(spark, sf), K.NULL_FILL_METHOD)


@register(
    "any_null",
    """
SELECT CAST(count(*) AS BIGINT) AS rows,
       CAST(sum(CASE WHEN d.lang IS NULL OR d.source IS NULL OR l.quality IS NULL OR l.toxic IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_rows,
       sum(CASE WHEN d.lang IS NULL OR d.source IS NULL OR l.quality IS NULL OR l.toxic IS NULL THEN 1 ELSE 0 END) > 0 AS any_null
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def q_any_null(spark: SparkSession, sf: str) -> DataFrame:
    """Does any row have a null?"""
    return clean.any_null(_docs_with_labels(spark, sf))


@register(
    "keep_last",
    """
SELECT lang, source, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars
FROM documents GROUP BY lang, source""",
)
def q_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """One row per key, last in scan order wins."""
    docs = table(spark, sf, "documents").select("lang", "source", "doc_id", "n_chars")
    return clean.keep_last(docs, ["lang", "source"], ["doc_id"])


# ---------------------------------------------------------------------------
# Conversation state
# ---------------------------------------------------------------------------

@register(
    "carry_context",
    f"""
SELECT conv_id, turn, role,
       substring(coalesce(last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS)
         OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ''), 1, {K.CONTEXT_CHARS}) AS context
FROM conversations""",
)
def q_carry_context(spark: SparkSession, sf: str) -> DataFrame:
    """H2 + P15: a system turn sets the conversation's context; later turns reuse it."""
    conv = table(spark, sf, "conversations")
    out = chat.carry_context(
        conv, user_col="conv_id", order_cols=["turn"], is_setter=F.col("role") == "system", value=F.col("text"),
        chunk=F.floor(F.col("turn") / 64),
    )
    return out.select("conv_id", "turn", "role", tx.clip_chars("context").alias("context"))


_EVENTS_CONTEXT_SQL = """
SELECT event_id, user_id,
       coalesce(last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS)
         OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS context
FROM events"""


@register("carry_context_events", _EVENTS_CONTEXT_SQL)
def q_carry_context_events(spark: SparkSession, sf: str) -> DataFrame:
    """H2 on the event log: the latest signup's props per user, carried forward."""
    ev = table(spark, sf, "events")
    out = chat.carry_context(
        ev, user_col="user_id", order_cols=["ts", "event_id"], is_setter=F.col("event_type") == "signup", value=F.col("props"),
        chunk=F.to_date("ts"),
    )
    return out.select("event_id", "user_id", "context")


_PAIRS_CONV_SQL = """
asks AS (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user'),
rep AS (SELECT conv_id, turn - 1 AS turn, text AS response FROM conversations WHERE role = 'assistant'),
pairs AS (SELECT a.conv_id, a.turn, a.query, r.response FROM asks a LEFT JOIN rep r USING (conv_id, turn))"""


@register("pair_turns", f"WITH {_PAIRS_CONV_SQL} SELECT conv_id, turn, query, response FROM pairs")
def q_pair_turns(spark: SparkSession, sf: str) -> DataFrame:
    """H6: each user turn with the reply that follows it."""
    conv = table(spark, sf, "conversations")
    return chat.pair_turns(conv, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text")


_LAST_N_SQL = f"""
WITH {_PAIRS_CONV_SQL},
e AS (SELECT conv_id, turn, to_json(struct_pack(query := {_sql_strip("replace(query, '@codebase', '')")}, response := response)) AS entry FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM e)
SELECT conv_id, CAST(count(*) AS BIGINT) AS entries, string_agg(entry, chr(10) ORDER BY turn) AS history
FROM r WHERE rn <= 5 GROUP BY conv_id"""


@register("last_n_history", _LAST_N_SQL)
def q_last_n_history(spark: SparkSession, sf: str) -> DataFrame:
    """H4 + H5 + P16: JSON history entries, last five per conversation, oldest first."""
    conv = table(spark, sf, "conversations")
    pairs = chat.pair_turns(conv, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text")
    entries = chat.append_history(pairs)
    return chat.last_n_history(entries, user_col="conv_id", order_col="turn")


@register("history_store", _LAST_N_SQL)
def q_history_store(spark: SparkSession, sf: str) -> DataFrame:
    """S19 + H4 + H5: entries appended to the stored history by ranges of turns, the last range
    written twice (a retry) and merged with the first; the last five of every conversation read back."""
    conv = table(spark, sf, "conversations")
    pairs = chat.append_history(chat.pair_turns(conv, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"))
    root = scratch_path(spark, "history-store")
    no_of = F.least(F.floor(F.col("turn") / 4), F.lit(1)).cast("int")
    pairs.select("conv_id", "turn", "entry", no_of.alias("no")).write.partitionBy("no").parquet(f"{root}-entries")
    staged = spark.read.schema("conv_id bigint, turn bigint, entry string, no int").parquet(f"{root}-entries")
    for no in (0, 1, 1):
        history.append_entries(staged.where(F.col("no") == no), root, no, user_col="conv_id", order_col="turn", fan=2)
    history.clean_up(spark, root, fan=2)
    return history.last_entries(spark, root, fan=2).select(F.col("user").cast("bigint").alias("conv_id"), "entries", "history")


# ---------------------------------------------------------------------------
# References over document lines (R1, R2, R4, R10): a name "defined" by starting a
# line is referenced wherever else it occurs.
# ---------------------------------------------------------------------------

_PIECE_SQL = r"([^\p{L}\p{N}\p{M}_$]*)([\p{L}\p{N}\p{M}_$]+)"


@register(
    "references",
    f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents
), p AS (
  SELECT doc_id, ln, unnest(regexp_extract_all(line, '{_PIECE_SQL}', 1)) AS sep,
         unnest(regexp_extract_all(line, '{_PIECE_SQL}', 2)) AS tok,
         generate_subscripts(regexp_extract_all(line, '{_PIECE_SQL}', 1), 1) AS j
  FROM l
), c AS (
  SELECT *, coalesce(sum(length(sep) + length(tok)) OVER (PARTITION BY doc_id, ln ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + length(sep) + 1 AS col
  FROM p
), v AS (SELECT DISTINCT tok FROM c WHERE col = 1),
m AS (SELECT c.tok, c.doc_id, c.ln, c.col FROM c JOIN v USING (tok) WHERE c.col <> 1)
SELECT 'class' AS kind, tok AS name, CAST(doc_id AS VARCHAR) AS file, CAST(count(*) AS BIGINT) AS n,
       string_agg(CAST(doc_id AS VARCHAR) || ':' || CAST(ln AS VARCHAR) || ':' || CAST(col AS VARCHAR), '; ' ORDER BY ln, col) AS refs
FROM m GROUP BY tok, doc_id""",
)
def q_references(spark: SparkSession, sf: str) -> DataFrame:
    """R1 occurrences → R2 vocabulary match → R4 group → R10 render, per (name, document)."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text")
    lines = docs.select("file_path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("ln", F.col("pos") + 1)
    occ = refs.identifier_occurrences(lines, key="file_path", text_col="line", neighbours=False)
    # the vocabulary: names that start a line (read straight off the lines, so the
    # occurrence table is computed once)
    first = F.regexp_extract("line", f"^([{refs.IDENT_CHARS}]+)", 1)
    vocab = lines.select(first.alias("name")).where(F.col("name") != "").distinct().select(F.lit("class").alias("kind"), "name")
    hits = occ.where(F.col("column") != 1).withColumns({"prev_token": F.lit(None).cast("string"), "next_char": F.lit("")})
    matched = refs.match_references(hits, vocab, key="file_path")
    return refs.render_by_file(matched)


# ---------------------------------------------------------------------------
# Path scan over `pages` (S1, S2, S4): URL path as a file path under the site root
# ---------------------------------------------------------------------------

_DENY_SQL = ", ".join(f"'{d}'" for d in K.DENY_DIRS)
_EXT_CASE = " ".join(f"WHEN '{e}' THEN '{l}'" for e, l in K.EXTENSION_LANGUAGE.items())


@register(
    "scan_filter",
    f"""
WITH p AS (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/build/' ELSE '' END || regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1)
         || CASE page_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' ELSE '' END AS rel_path FROM pages
), s AS (SELECT page_id, rel_path, string_split(rel_path, '/') AS parts FROM p)
SELECT page_id, rel_path, parts[len(parts)] AS file_name,
       regexp_extract(parts[len(parts)], '^.+(\\.[^.]+)$', 1) AS extension,
       CASE regexp_extract(parts[len(parts)], '^.+(\\.[^.]+)$', 1) {_EXT_CASE} ELSE NULL END AS language
FROM s
WHERE NOT list_has_any(parts[1:len(parts) - 1], [{_DENY_SQL}])""",
)
def q_scan_filter(spark: SparkSession, sf: str) -> DataFrame:
    """S1 deny-directory pruning, S2 extension, S4 language tag over URL paths, some of them put
    into denied folders or given a source extension by a rule on page_id."""
    folder = F.when(F.col("page_id") % 5 == 0, "node_modules/").when(F.col("page_id") % 5 == 1, "src/build/").otherwise("")
    suffix = F.when(F.col("page_id") % 3 == 0, ".py").when(F.col("page_id") % 3 == 1, ".rs").otherwise("")
    path = F.concat(folder, F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^?#]*)", 1), suffix)
    pages = table(spark, sf, "pages").select("page_id", path.alias("rel_path"))
    out = pages.where(files.not_in_denied_dir(F.col("rel_path")))
    name = files.file_name(F.col("rel_path"))
    ext = files.extension(name)
    return out.select("page_id", "rel_path", name.alias("file_name"), ext.alias("extension"), files.language_of(ext).alias("language"))


# ---------------------------------------------------------------------------
# Bad-vector handling (E4): the table plus derived corrupt copies
# ---------------------------------------------------------------------------

@register(
    "drop_bad_vectors",
    """
SELECT vec_id, label, CAST(len(embedding) AS BIGINT) AS dim,
       round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm
FROM embeddings""",
)
def q_drop_bad_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector plus a truncated copy and a NaN copy of it; only the originals survive."""
    emb = table(spark, sf, "embeddings")
    short = emb.withColumn("embedding", F.slice("embedding", 1, F.size("embedding") - 1))
    nan = emb.withColumn("embedding", F.concat(F.slice("embedding", 1, F.size("embedding") - 1), F.array(F.lit(float("nan")).cast("float"))))
    nulls = emb.withColumn("embedding", F.concat(F.slice("embedding", 1, F.size("embedding") - 1), F.array(F.lit(None).cast("float"))))
    allv = emb.unionByName(short).unionByName(nan).unionByName(nulls)
    dim = 64
    kept = embed.drop_bad_vectors(allv, "embedding", dim)
    return kept.select("vec_id", "label", F.size("embedding").cast("bigint").alias("dim"), _r6(vec.norm("embedding")).alias("norm"))


# ---------------------------------------------------------------------------
# Keyword search, fusion, recall, reranking (A1, A2, A4, V6, V7)
# ---------------------------------------------------------------------------

def _cos_topk_ctes(name: str, q_src: str, q_key: str, q_text: str, d_src: str, d_key: str, d_text: str, k: int = 5, extra_d_cols: str = "") -> str:
    """CTEs ending in ``{name}(query_id, id, rank, score{extra})``: exact cosine top-k."""
    qa, da = f"{name}_q", f"{name}_d"
    extra_sel = "".join(f", d.{c}" for c in extra_d_cols.split(",") if c.strip())
    return f"""{_hash_sql(q_src, q_key, q_text, alias=qa)},
{_hash_sql(d_src, d_key, d_text, alias=da)},
{name}_dots AS (SELECT {qa}_b.k AS qk, {da}_b.k AS dk, sum({qa}_b.c * {da}_b.c) AS g FROM {qa}_b JOIN {da}_b USING (bucket) GROUP BY ALL),
{name}_pairs AS (
  SELECT q.{q_key} AS query_id, d.{d_key} AS id{extra_sel},
         CASE WHEN {qa}_n.nrm > 0 AND {da}_n.nrm > 0 THEN coalesce({name}_dots.g, 0) / ({qa}_n.nrm * {da}_n.nrm) ELSE 0 END AS score
  FROM {q_src} q CROSS JOIN {d_src} d
  LEFT JOIN {qa}_n ON {qa}_n.k = q.{q_key} LEFT JOIN {da}_n ON {da}_n.k = d.{d_key}
  LEFT JOIN {name}_dots ON {name}_dots.qk = q.{q_key} AND {name}_dots.dk = d.{d_key}
),
{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {name}_pairs)
  WHERE rank <= {k}
)"""


_BM25_CTES = f"""
bm_t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM documents),
bm_post AS (SELECT term, doc_id, count(*) AS tf FROM bm_t GROUP BY ALL),
bm_dl AS (SELECT doc_id, sum(tf) AS dl FROM bm_post GROUP BY ALL),
bm_st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM bm_dl),
bm_idf AS (SELECT term, ln(1 + ((SELECT n FROM bm_st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM bm_post GROUP BY term),
bm_qt AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM benchmark)),
bm_sc AS (
  SELECT bm_qt.query_id, bm_post.doc_id,
         sum(bm_idf.idf * bm_post.tf * 2.2 / (bm_post.tf + 1.2 * (1 - 0.75 + 0.75 * bm_dl.dl / (SELECT avgdl FROM bm_st)))) AS score
  FROM bm_qt JOIN bm_post USING (term) JOIN bm_idf USING (term) JOIN bm_dl USING (doc_id) GROUP BY ALL
),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm_sc) WHERE rank <= 5)"""


def _bench_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _text_candidates(spark, sf, carry=("text",)):
    emb = embed.HashingEmbedder(dim=TEXT_DIM, sparse=True)
    docs = table(spark, sf, "documents")
    return search.text_search(docs, _bench_queries(spark, sf), emb, id_col="doc_id", text_col="text", query_id="query_id", query_text="query_text", k=5, metric="cosine", carry=list(carry))


@register("bm25_topk", f"WITH {_BM25_CTES} SELECT query_id, doc_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM bm")
def q_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A1: BM25 top-5 documents for every benchmark question."""
    res = keyword.bm25_topk(table(spark, sf, "documents"), _bench_queries(spark, sf), id_col="doc_id", text_col="text", query_id="query_id", query_text="query_text", k=5)
    return res.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), _r6(F.col("score")).alias("score"))


@register(
    "hybrid_search",
    f"""
WITH {_BM25_CTES},
{_cos_topk_ctes('vs', 'benchmark', 'item_id', 'text', 'documents', 'doc_id', 'text')},
u AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS rrf FROM bm UNION ALL SELECT query_id, id AS doc_id, 1.0::DOUBLE / (60 + rank) AS rrf FROM vs),
f AS (SELECT query_id, doc_id, sum(rrf) AS rrf, count(*) AS lists FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, doc_id) AS rank FROM f)
SELECT query_id, doc_id, CAST(rank AS BIGINT) AS rank, round(rrf, 6) AS rrf, CAST(lists AS BIGINT) AS lists FROM r WHERE rank <= 5""",
)
def q_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """A2: reciprocal-rank fusion of vector and BM25 rankings."""
    vs = _text_candidates(spark, sf, carry=())
    bm = keyword.bm25_topk(table(spark, sf, "documents"), _bench_queries(spark, sf), id_col="doc_id", text_col="text", query_id="query_id", query_text="query_text", k=5)
    fused = keyword.reciprocal_rank_fusion({"vector": vs, "bm25": bm}, query_id="query_id", id_col="doc_id", k=5)
    return fused.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), _r6(F.col("rrf")).alias("rrf"), F.col("lists").cast("bigint").alias("lists"))


@register(
    "recall_at_k",
    _PAIRS_SQL.format(expr=_COS, where="", order="round(v, 9) DESC", out="v", name="score").replace(
        "SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank, round(v, 6) AS score\nFROM ranked WHERE rank <= 5",
        """, n AS (SELECT CAST(label AS BIGINT) AS label, count(*) AS relevant FROM embeddings GROUP BY 1)
SELECT query_id, CAST(sum(CASE WHEN e.label = query_id THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(any_value(relevant) AS BIGINT) AS relevant,
       round(sum(CASE WHEN e.label = query_id THEN 1 ELSE 0 END) / any_value(relevant), 6) AS recall
FROM ranked JOIN embeddings e USING (vec_id) JOIN n ON n.label = query_id WHERE rank <= 50 GROUP BY query_id""",
    ),
)
def q_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """A4: recall of the cosine top-50 around a label's mean against the label's items."""
    emb = table(spark, sf, "embeddings")
    res = search.vector_topk(emb, _label_means(emb), id_col="vec_id", vec_col="embedding", metric="cosine", k=50)
    out = keyword.recall_by_label(
        res.withColumn("query_label", F.col("query_id")), emb, query_id="query_id", id_col="vec_id", label_col="label", query_label="query_label"
    )
    return out.select("query_id", F.col("hits").cast("bigint").alias("hits"), F.col("relevant").cast("bigint").alias("relevant"), _r6(F.col("recall")).alias("recall"))


@register(
    "maxsim_rerank",
    f"""
WITH {_cos_topk_ctes('vs', 'benchmark', 'item_id', 'text', 'documents', 'doc_id', 'text')},
qb AS (SELECT item_id AS query_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {TEXT_DIM} AS bucket, count(*) AS qn
       FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS t FROM benchmark) GROUP BY ALL),
db AS (SELECT DISTINCT vs.query_id, vs.id AS doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {TEXT_DIM} AS bucket
       FROM vs JOIN (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS t FROM documents) d ON d.doc_id = vs.id),
ms AS (SELECT db.query_id, db.doc_id, sum(qb.qn) AS maxsim FROM db JOIN qb USING (query_id, bucket) GROUP BY ALL),
c AS (SELECT vs.query_id, vs.id AS doc_id, vs.rank AS first_rank, coalesce(ms.maxsim, 0)::DOUBLE AS maxsim
      FROM vs LEFT JOIN ms ON ms.query_id = vs.query_id AND ms.doc_id = vs.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY maxsim DESC, first_rank) AS rank FROM c)
SELECT query_id, doc_id, CAST(first_rank AS BIGINT) AS first_rank, CAST(rank AS BIGINT) AS rank, maxsim FROM r WHERE rank <= 3""",
)
def q_maxsim_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """V6: late-interaction rerank of the vector top-5, top-3 kept."""
    cands = _text_candidates(spark, sf).join(_bench_queries(spark, sf), "query_id")
    res = rerank.maxsim_rerank(cands, query_id="query_id", query_text="query_text", id_col="doc_id", doc_text="text", keep=3, dim=TEXT_DIM)
    return res.select("query_id", "doc_id", F.col("first_rank").cast("bigint").alias("first_rank"), F.col("rank").cast("bigint").alias("rank"), F.col("maxsim").cast("double").alias("maxsim"))


@register(
    "pair_rerank",
    f"""
WITH {_cos_topk_ctes('vs', 'benchmark', 'item_id', 'text', 'documents', 'doc_id', 'text', extra_d_cols='text')},
qt AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '{TERM}')) AS qterms FROM benchmark),
c AS (SELECT vs.query_id, vs.id AS doc_id, vs.rank AS first_rank,
             CASE WHEN len(qterms) > 0 THEN len(list_intersect(qterms, list_distinct(regexp_extract_all(lower(vs.text), '{TERM}'))))::DOUBLE / len(qterms) ELSE 0 END AS pair_score
      FROM vs JOIN qt USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(pair_score, 9) DESC, first_rank) AS rank FROM c)
SELECT query_id, doc_id, CAST(first_rank AS BIGINT) AS first_rank, CAST(rank AS BIGINT) AS rank, round(pair_score, 6) AS pair_score FROM r WHERE rank <= 3""",
)
def q_pair_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """V7: pair-scorer (cross-encoder stand-in) rerank of the vector top-5, top-3 kept."""
    cands = _text_candidates(spark, sf).join(_bench_queries(spark, sf), "query_id")
    res = rerank.pair_rerank(cands, query_id="query_id", query_text="query_text", id_col="doc_id", doc_text="text", keep=3)
    return res.select("query_id", "doc_id", F.col("first_rank").cast("bigint").alias("first_rank"), F.col("rank").cast("bigint").alias("rank"), _r6(F.col("pair_score")).alias("pair_score"))


# ---------------------------------------------------------------------------
# Flagship: two-pass retrieval context (C1-C7) over an index built from documents
# ---------------------------------------------------------------------------

_CLIP4000 = f"CASE WHEN len(regexp_extract_all(text, '({_AWS}*{_NONWS}+)', 1)) > {K.MAX_TOKENS_SMALL} THEN array_to_string(regexp_extract_all(text, '({_AWS}*{_NONWS}+)', 1)[1:{K.MAX_TOKENS_SMALL}], '') ELSE text END"

_TWO_PASS_SQL = f"""
WITH
ml AS (
  SELECT ('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|' || CAST(ln AS VARCHAR)), 1, 15))::BIGINT AS entity_id, 'doc/' || CAST(doc_id AS VARCHAR) AS file_path, code
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents)
  WHERE regexp_matches(code, '{_NONWS}')
),
cl AS (
  SELECT doc_id AS entity_id, 'doc/' || CAST(doc_id AS VARCHAR) AS file_path,
         'File: doc/' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || 'Class: ' || source || chr(10) || chr(10) || 'Source Code:' || chr(10) || {_CLIP4000} || chr(10) || chr(10) AS source_code,
         '' AS refs
  FROM documents
),
q AS (SELECT item_id AS query_id, text AS query, '{K.HYDE_USER_PREFIX}' || text AS hyde FROM benchmark),
{_cos_topk_ctes('p1m', 'q', 'query_id', 'hyde', 'ml', 'entity_id', 'code')},
{_cos_topk_ctes('p1c', 'q', 'query_id', 'hyde', 'cl', 'entity_id', 'source_code')},
tcls AS (SELECT p1c.query_id, string_agg(cl.source_code, chr(10) ORDER BY p1c.rank) AS kcls FROM p1c JOIN cl ON cl.entity_id = p1c.id GROUP BY 1),
tm AS (
  SELECT p1m.query_id, string_agg(ml.code || coalesce(tcls.kcls, ''), chr(10) ORDER BY p1m.rank) AS t
  FROM p1m JOIN ml ON ml.entity_id = p1m.id LEFT JOIN tcls ON tcls.query_id = p1m.query_id GROUP BY 1
),
q3 AS (
  SELECT q.query_id, q.query, q.hyde,
         '{K.HYDE_V2_USER_PREFIX}' || q.hyde || chr(10) || q.query || chr(10) || coalesce(tm.t, '') AS hyde2
  FROM q LEFT JOIN tm USING (query_id)
),
{_cos_topk_ctes('p2m', 'q3', 'query_id', 'hyde2', 'ml', 'entity_id', 'code')},
{_cos_topk_ctes('p2c', 'q3', 'query_id', 'hyde2', 'cl', 'entity_id', 'source_code')},
mtext AS (
  SELECT p2m.query_id, string_agg('File: ' || ml.file_path || chr(10) || 'Code:' || chr(10) || ml.code, chr(10) || chr(10) ORDER BY p2m.rank) AS methods_text
  FROM p2m JOIN ml ON ml.entity_id = p2m.id WHERE p2m.rank <= 3 GROUP BY 1
),
ctext AS (
  SELECT p2c.query_id, string_agg('File: ' || cl.file_path || chr(10) || 'Class Info:' || chr(10) || cl.source_code || ' References: ' || chr(10) || cl.refs
                                  || '  ' || chr(10) || ' END OF ROW ' || CAST(p2c.rank - 1 AS VARCHAR), chr(10) || chr(10) ORDER BY p2c.rank) AS classes_text
  FROM p2c JOIN cl ON cl.entity_id = p2c.id WHERE p2c.rank <= 3 GROUP BY 1
)
SELECT q3.query_id, q3.hyde AS hyde_query, q3.hyde2 AS hyde_query_v2,
       coalesce(mtext.methods_text, '') || chr(10) || ' below is class or constructor related code ' || chr(10) || coalesce(ctext.classes_text, '') AS context
FROM q3 LEFT JOIN mtext USING (query_id) LEFT JOIN ctext USING (query_id)"""


def _document_index(spark: SparkSession, sf: str, emb):
    """Build the two vector tables from `documents`, publish them, read them back."""
    mt, ct = index.document_tables(table(spark, sf, "documents"), emb)
    root = scratch_path(spark, "document-index")
    index.publish({"method": mt, "class": ct}, root, "documents")
    return index.open_index(spark, root, "documents", "method"), index.open_index(spark, root, "documents", "class")


@register("two_pass_context", _TWO_PASS_SQL)
def q_two_pass_context(spark: SparkSession, sf: str) -> DataFrame:
    """Expand → search both tables → temp context → expand again → search
    again → top-3 per table → assembled context, for every benchmark question."""
    emb = embed.HashingEmbedder(dim=TEXT_DIM, sparse=True)
    mt, ct = _document_index(spark, sf, emb)
    qs = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return answer.two_pass_context(qs, mt, ct, emb)


# ---------------------------------------------------------------------------
# Splitters (A5-A8), enrichment (L1-L5), streaming context (H2 stream)
# ---------------------------------------------------------------------------

@register(
    "fixed_chunks",
    """
SELECT doc_id, CAST((s - 1) // 800 + 1 AS BIGINT) AS chunk_no, CAST(s AS BIGINT) AS start, substring(text, s, 1000) AS chunk
FROM (SELECT doc_id, text, unnest(generate_series(1, length(text), 800)) AS s FROM documents WHERE length(text) > 0)""",
)
def q_fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A5: 1000-character windows every 800 characters (200 overlap)."""
    return chunk.fixed_chunks(table(spark, sf, "documents"), id_col="doc_id", text_col="text", size=1000, overlap=200)


@register(
    "token_chunks",
    f"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '({_AWS}*{_NONWS}+)', 1) AS pieces FROM documents),
s AS (SELECT doc_id, pieces, unnest(generate_series(1, len(pieces), 128)) AS st FROM p WHERE len(pieces) > 0)
SELECT doc_id, CAST((st - 1) // 128 + 1 AS BIGINT) AS chunk_no, CAST(len(pieces[st:st + 127]) AS BIGINT) AS n,
       regexp_replace(array_to_string(pieces[st:st + 127], ''), '^{_AWS}+', '') AS chunk
FROM s""",
)
def q_token_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 128 whitespace tokens."""
    return chunk.token_chunks(table(spark, sf, "documents"), id_col="doc_id", text_col="text", n_tokens=128)


@register("recursive_chunks")
def q_recursive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Separator-priority split, greedy packing to 1000 characters (no SQL form;
    checked against a direct Python implementation in the tests)."""
    return chunk.recursive_chunks(table(spark, sf, "documents"), id_col="doc_id", text_col="text", size=1000)


@register(
    "line_sections",
    f"""
WITH t AS (
  SELECT doc_id, copy, '# top ' || CAST(doc_id AS VARCHAR) || chr(10) || replace(replace(text, '. ', chr(10) || chr(10)), ', ', chr(10) || '## part' || chr(10))
         || chr(10) || '```sh' || chr(10) || '# no header' || chr(10) || chr(10) || replace(text, ', ', chr(10) || '~~~' || chr(10) || '## no' || chr(10)) || chr(10) || '````' || chr(10)
         || '### deep  #' || chr(10) || chr(10) || 'under deep' || chr(10) || '## ' || source || chr(10) || 'end' AS text
  FROM documents, (VALUES (0), (1)) c(copy)
), l AS (
  SELECT doc_id, copy, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM t
), f AS (
  SELECT *, regexp_matches(line, '^ {{0,3}}```') AS mark FROM l
), i AS (
  SELECT *, coalesce(sum(CAST(mark AS INT)) OVER (PARTITION BY doc_id, copy ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM f
), g AS (
  SELECT *, NOT inside AND NOT regexp_matches(line, '{_NONWS}') AS blank, CASE WHEN inside THEN 0 ELSE length(regexp_extract(line, '^(#{{1,6}})[ \t]', 1)) END AS level,
         regexp_extract(line, '^#{{1,6}}[ \t]+(.*?)[ \t]*#*[ \t]*$', 1) AS heading FROM i
), h AS (
  SELECT *, CASE WHEN NOT blank AND (level > 0 OR coalesce(lag(blank) OVER (PARTITION BY doc_id, copy ORDER BY ln), true)) THEN 1 ELSE 0 END AS st FROM g
), s AS (
  SELECT *, sum(st) OVER w AS section, max(CASE WHEN level = 1 THEN ln END) OVER w AS l1, max(CASE WHEN level = 2 THEN ln END) OVER w AS l2, max(CASE WHEN level = 3 THEN ln END) OVER w AS l3
  FROM h WINDOW w AS (PARTITION BY doc_id, copy ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), a AS (
  SELECT doc_id, copy, section, min(ln) AS first_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY ln) AS text, min_by(level, ln) AS level,
         min_by(CASE WHEN level > 0 THEN heading ELSE '' END, ln) AS heading, min(l1) AS l1, min(CASE WHEN l2 > l1 THEN l2 END) AS l2, min(CASE WHEN l3 > l1 AND l3 > coalesce(l2, 0) THEN l3 END) AS l3
  FROM s WHERE NOT blank GROUP BY ALL
)
SELECT CASE WHEN a.copy = 0 OR a.doc_id % 2 = 0 THEN CAST(a.doc_id AS VARCHAR) END AS doc_id, CAST(section AS BIGINT) AS section, CAST(first_line AS BIGINT) AS first_line, CAST(n_lines AS BIGINT) AS n_lines, a.text,
       CAST(a.level AS INTEGER) AS level, a.heading, p1.heading || coalesce(' > ' || p2.heading, '') || coalesce(' > ' || p3.heading, '') AS path
FROM a LEFT JOIN g p1 ON p1.doc_id = a.doc_id AND p1.copy = a.copy AND p1.ln = l1
       LEFT JOIN g p2 ON p2.doc_id = a.doc_id AND p2.copy = a.copy AND p2.ln = l2
       LEFT JOIN g p3 ON p3.doc_id = a.doc_id AND p3.copy = a.copy AND p3.ln = l3""",
)
def q_line_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of every document, its sentences as paragraphs and its commas as header lines, behind them
    the text again in a fenced block and headers of other levels. Every document comes twice,
    the second time under the same id or none."""
    docs = table(spark, sf, "documents").where("text is not null")
    nl = F.lit("\n")
    t = F.col("text")
    text = F.concat(
        F.lit("# top "), F.col("doc_id").cast("string"), nl, F.replace(F.replace(t, F.lit(". "), F.lit("\n\n")), F.lit(", "), F.lit("\n## part\n")),
        F.lit("\n```sh\n# no header\n\n"), F.replace(t, F.lit(", "), F.lit("\n~~~\n## no\n")), F.lit("\n````\n### deep  #\n\nunder deep\n## "), "source", F.lit("\nend"),
    )
    ids = F.array(F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    rows = docs.select(text.alias("text"), F.explode(ids).alias("doc_id"))
    out = chunk.line_sections(rows, id_col="doc_id", text_col="text")
    return out.withColumns({"doc_id": F.col("doc_id").cast("string"), "path": F.array_join("path", " > ")})


@register(
    "enrich_batches",
    """SELECT doc_id, 'Summary: Class: ' || source || ' / Method: doc' || CAST(doc_id AS VARCHAR) || ' #'
       || substr(md5('Class: ' || source || chr(10) || 'Method: doc' || CAST(doc_id AS VARCHAR) || chr(10) || 'Source Code:' || chr(10) || text), 1, 12) AS llm_comments FROM documents""",
)
def q_enrich_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a method row, described in requests of 32 prompts."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("class_name"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("source_code")
    )
    return enrich.enrich(docs).select("doc_id", "llm_comments")


_ONCE_SQL = """
WITH p AS (SELECT doc_id, source, lang, 'Class: ' || source || chr(10) || 'Method: ' || lang || chr(10) || 'Source Code:' || chr(10) || text AS prompt FROM documents)
SELECT doc_id, CASE WHEN prompt IS NOT NULL THEN 'Summary: Class: ' || source || ' / Method: ' || lang || ' #' || substr(md5(prompt), 1, 12) END AS llm_comments,
       CAST(CASE WHEN prompt IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS answered,
       CAST(CASE WHEN substr(md5(prompt), 1, 1) = '0' THEN 1 ELSE 0 END AS BIGINT) AS failed
FROM p"""


@register("enrich_once", _ONCE_SQL)
def q_enrich_once(spark: SparkSession, sf: str) -> DataFrame:
    """L3 + E2 with stored answers: a first run in which every sixteenth prompt fails (by its digest), then
    the job again. Equal prompts are sent once; ``answered`` and ``failed`` count what was sent of each."""
    import hashlib

    import pandas as pd

    def describe(prompts: list) -> list:
        return DefaultEnricher().describe(pd.Series(prompts, dtype=object)).tolist()

    def failing(prompts: list) -> list:
        return [None if hashlib.md5(p.encode()).hexdigest()[0] == "0" else a for p, a in zip(prompts, describe(prompts))]

    prompt = enrich.enrich_prompt(F.col("source"), F.col("lang"), F.col("text"))
    docs = table(spark, sf, "documents")
    root = scratch_path(spark, "answers")
    answers.ask(docs, root, failing, model="digest", prompt=prompt, strict=False)
    out = answers.ask(docs, root, describe, model="digest", prompt=prompt, out_col="llm_comments")
    calls = answers.log(spark, root).groupBy("key").agg(F.count("answer").alias("answered"), F.count("error").alias("failed"))
    out = out.withColumn("key", answers.key_of("digest", prompt)).join(calls, "key", "left")
    return out.select("doc_id", "llm_comments", F.coalesce("answered", F.lit(0)).alias("answered"), F.coalesce("failed", F.lit(0)).alias("failed"))


@register("stream_context", _EVENTS_CONTEXT_SQL)
def q_stream_context(spark: SparkSession, sf: str) -> DataFrame:
    """H2 as a stream: the event log replayed in three time-ordered micro-batches
    through keyed state; must equal the batch form."""
    from ..streaming.context_stream import replay_events_context

    out = replay_events_context(spark, table(spark, sf, "events", balance=False))
    return out.select("event_id", "user_id", "context")


# ---------------------------------------------------------------------------
# Turn routing, chat prompt, class-row text, context filter
# ---------------------------------------------------------------------------

def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@register(
    "route_turns",
    f"""
WITH u AS (
  SELECT conv_id, turn, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN '@codebase ' || text || ' @codebase' ELSE text END AS text
  FROM conversations WHERE role = 'user'
)
SELECT conv_id, turn, regexp_matches(text, '@codebase') AS retrieve, {_sql_strip("replace(text, '@codebase', '')")} AS query FROM u""",
)
def q_route_turns(spark: SparkSession, sf: str) -> DataFrame:
    """H3 + P13 + P14: which user turns trigger retrieval, and the stripped query."""
    conv = _directed(table(spark, sf, "conversations").where(F.col("role") == "user"))
    return conv.select("conv_id", "turn", tx.has_directive("text").alias("retrieve"), tx.strip_directive("text").alias("query"))


def _directed(asks: DataFrame) -> DataFrame:
    """User turns with the directive put into each conversation's first one."""
    first = asks.groupBy("conv_id").agg(F.min("turn").alias("_first"))
    j = asks.join(first, "conv_id")
    marked = F.concat(F.lit("@codebase "), F.col("text"), F.lit(" @codebase"))
    return j.withColumn("text", F.when(F.col("turn") == F.col("_first"), marked).otherwise(F.col("text"))).drop("_first")


@register(
    "chat_prompts",
    f"""
WITH c AS (
  SELECT conv_id, turn, role,
         substring(coalesce(last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS)
           OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ''), 1, {K.CONTEXT_CHARS}) AS context
  FROM conversations
)
SELECT conv_id, turn, replace({_sql_lit(K.CHAT_SYSTEM_PROMPT)}, '{{context}}', context) AS system_prompt FROM c WHERE role = 'user'""",
)
def q_chat_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """C8 + H2 + P15: the answering prompt of every user turn, context clipped to 12,000 characters."""
    from ..operators import context as C

    conv = table(spark, sf, "conversations")
    ctx = chat.carry_context(conv, user_col="conv_id", order_cols=["turn"], is_setter=F.col("role") == "system", value=F.col("text"), chunk=F.floor(F.col("turn") / 64))
    return ctx.where(F.col("role") == "user").select("conv_id", "turn", C.chat_system(tx.clip_chars("context")).alias("system_prompt"))


@register(
    "class_rows",
    f"""
SELECT doc_id, 'File: doc/' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || 'Class: ' || source || chr(10) || chr(10) || 'Source Code:' || chr(10) || {_CLIP4000} || chr(10) || chr(10) AS source_code,
       'File: doc/' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || 'Content:' || chr(10) || {_CLIP4000} || chr(10) || chr(10) AS special_text
FROM documents""",
)
def q_class_rows(spark: SparkSession, sf: str) -> DataFrame:
    """P4 + P5 + P8: class-row and special-file text as stored (clipped to 4000 tokens)."""
    d = table(spark, sf, "documents")
    fp = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return d.select("doc_id", clean.format_class_text(fp, F.col("source"), F.col("text")).alias("source_code"), clean.format_special_text(fp, F.col("text")).alias("special_text"))


@register(
    "context_filter",
    f"""
WITH {_cos_topk_ctes('vs', 'benchmark', 'item_id', 'text', 'documents', 'doc_id', 'text', extra_d_cols='text')},
qt AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '{TERM}')) AS qterms FROM benchmark),
c AS (SELECT vs.query_id, vs.id AS doc_id, vs.rank,
             CASE WHEN len(qterms) > 0 THEN len(list_intersect(qterms, list_distinct(regexp_extract_all(lower(vs.text), '{TERM}'))))::DOUBLE / len(qterms) ELSE 0 END AS relevance
      FROM vs JOIN qt USING (query_id))
SELECT query_id, doc_id, CAST(rank AS BIGINT) AS rank, round(relevance, 6) AS relevance FROM c WHERE relevance >= 0.5""",
)
def q_context_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieved items kept only when half the question's terms occur in them."""
    cands = _text_candidates(spark, sf).join(_bench_queries(spark, sf), "query_id")
    kept = rerank.filter_candidates(cands, query_text="query_text", doc_text="text", min_score=0.5)
    return kept.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), _r6(F.col("relevance")).alias("relevance"))


def _maxsim_ctes(name: str, cand: str, doc_table: str, doc_key: str, doc_text: str) -> str:
    """CTE ``{name}(query_id, id, rank)``: candidates of ``cand`` reordered by MaxSim of
    the expanded question (q3.hyde2) against the candidate text, ties by first rank."""
    return f"""
{name}_qb AS (SELECT query_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {TEXT_DIM} AS bucket, count(*) AS qn
              FROM (SELECT query_id, unnest(regexp_extract_all(lower(hyde2), '{TERM}')) AS t FROM q3) GROUP BY ALL),
{name}_db AS (SELECT DISTINCT c.query_id, c.id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {TEXT_DIM} AS bucket
              FROM {cand} c JOIN (SELECT {doc_key} AS id, unnest(regexp_extract_all(lower({doc_text}), '{TERM}')) AS t FROM {doc_table}) d ON d.id = c.id),
{name}_ms AS (SELECT query_id, id, sum(qn) AS maxsim FROM {name}_db JOIN {name}_qb USING (query_id, bucket) GROUP BY ALL),
{name} AS (
  SELECT c.query_id, c.id, row_number() OVER (PARTITION BY c.query_id ORDER BY coalesce(m.maxsim, 0) DESC, c.rank) AS rank
  FROM {cand} c LEFT JOIN {name}_ms m ON m.query_id = c.query_id AND m.id = c.id
)"""


_TWO_PASS_RERANK_SQL = (
    _TWO_PASS_SQL.replace(
        "\nmtext AS (",
        "\n" + _maxsim_ctes("r2m", "p2m", "ml", "entity_id", "code").strip() + ",\n" + _maxsim_ctes("r2c", "p2c", "cl", "entity_id", "source_code").strip() + ",\nmtext AS (",
        1,
    )
    .replace("FROM p2m JOIN ml ON ml.entity_id = p2m.id WHERE p2m.rank <= 3 GROUP BY 1", "FROM r2m AS p2m JOIN ml ON ml.entity_id = p2m.id WHERE p2m.rank <= 3 GROUP BY 1")
    .replace("FROM p2c JOIN cl ON cl.entity_id = p2c.id WHERE p2c.rank <= 3 GROUP BY 1", "FROM r2c AS p2c JOIN cl ON cl.entity_id = p2c.id WHERE p2c.rank <= 3 GROUP BY 1")
)


@register("two_pass_context_rerank", _TWO_PASS_RERANK_SQL)
def q_two_pass_context_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """C7 with rerank on (V6): second-pass candidates reordered by late interaction
    against the expanded question before the top-3 of each table are formatted."""
    emb = embed.HashingEmbedder(dim=TEXT_DIM, sparse=True)
    mt, ct = _document_index(spark, sf, emb)
    qs = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return answer.two_pass_context(qs, mt, ct, emb, rerank=True)


_ASKED_SQL = """
u AS (
  SELECT conv_id, turn, turn = min(turn) OVER (PARTITION BY conv_id) AS retrieve, text FROM conversations WHERE role = 'user'
), asked AS (
  SELECT conv_id, turn, retrieve, regexp_replace(CASE WHEN retrieve THEN replace(text, '@codebase', '') ELSE text END, '^{ws}+|{ws}+$', '', 'g') AS query FROM u
)""".format(ws=_UWS)


def _two_pass_of(sql: str, parity: int) -> str:
    """A two-pass query over the asking turns of conversations with this parity."""
    q = f"q AS (SELECT conv_id AS query_id, query, '{K.HYDE_USER_PREFIX}' || query AS hyde FROM asked WHERE retrieve AND conv_id % 2 = {parity})"
    old = f"q AS (SELECT item_id AS query_id, text AS query, '{K.HYDE_USER_PREFIX}' || text AS hyde FROM benchmark)"
    if old not in sql:
        raise ValueError("the two-pass SQL has another question table")
    return "SELECT query_id AS conv_id, context FROM (" + sql.replace(old, q) + ")"


@register(
    "answer_conversations",
    f"""
WITH {_ASKED_SQL},
found AS ({_two_pass_of(_TWO_PASS_SQL, 1)} UNION ALL {_two_pass_of(_TWO_PASS_RERANK_SQL, 0)}),
log AS (
  SELECT a.conv_id, a.turn, a.retrieve, a.query,
         coalesce(last_value(CASE WHEN a.retrieve THEN f.context END IGNORE NULLS)
           OVER (PARTITION BY a.conv_id ORDER BY a.turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS context
  FROM asked a LEFT JOIN found f ON f.conv_id = a.conv_id AND a.retrieve
)
SELECT conv_id, turn, retrieve, query, query || chr(10) || substring(context, 1, {K.CONTEXT_CHARS}) AS response FROM log""",
)
def q_answer_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """The turn job: directive, retrieval (reranked for even conversations), stored context,
    answer of every user turn; the directive stands in each conversation's first one."""
    emb = embed.HashingEmbedder(dim=TEXT_DIM, sparse=True)
    mt, ct = _document_index(spark, sf, emb)
    asks = _directed(table(spark, sf, "conversations").where(F.col("role") == "user")).withColumn("rerank", F.when(F.col("conv_id") % 2 == 0, "true"))
    out = answer.answer_log(asks, mt, ct, emb, user_col="conv_id", order_col="turn", rerank_col="rerank")
    return out.select("conv_id", "turn", "retrieve", "query", "response")


def _filled_sql(template: str, **slots: str) -> str:
    """A prompt template as SQL: its text with the slots' expressions in between."""
    out = _sql_lit(template).replace("\n", "' || chr(10) || '")
    for name, expr in slots.items():
        out = out.replace("{" + name + "}", f"' || {expr} || '")
    return out


@register(
    "expansion_prompts",
    f"""
SELECT item_id AS query_id, {_filled_sql(K.HYDE_SYSTEM_PROMPT)} AS hyde_system, '{K.HYDE_USER_PREFIX}' || b.text AS hyde_prompt,
       {_filled_sql(K.HYDE_V2_SYSTEM_PROMPT, query='b.text', temp_context='d.text')} AS hyde_v2_system, '{K.HYDE_V2_USER_PREFIX}' || b.text AS hyde_v2_prompt,
       {_filled_sql(K.REFERENCES_SYSTEM_PROMPT, query='b.text', context='d.text')} AS references_prompt
FROM benchmark b JOIN documents d ON d.doc_id = b.item_id""",
)
def q_expansion_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The filled prompts of every question, with the document of its id as context."""
    from ..operators import context as C

    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("found"))
    j = b.join(d, "query_id")
    return j.select(
        "query_id",
        F.lit(K.HYDE_SYSTEM_PROMPT).alias("hyde_system"),
        C.hyde_user("query").alias("hyde_prompt"),
        C.hyde_v2_system(F.col("query"), F.col("found")).alias("hyde_v2_system"),
        C.hyde_v2_user("query").alias("hyde_v2_prompt"),
        C.references_system(F.col("query"), F.col("found")).alias("references_prompt"),
    )


@register(
    "index_append",
    """
WITH base AS (SELECT vec_id AS entity_id, label, 0 AS part FROM embeddings),
one AS (SELECT vec_id AS entity_id, label + 100 AS label, 1 AS part FROM embeddings WHERE vec_id % 5 = 0 UNION ALL SELECT vec_id + 1000000000, label + 100, 1 FROM embeddings WHERE vec_id % 50 = 3),
two AS (SELECT vec_id AS entity_id, label + 200 AS label, 3 AS part FROM embeddings WHERE vec_id % 10 = 0),
gone AS (SELECT vec_id AS entity_id FROM embeddings WHERE vec_id % 7 = 0),
merged AS (
  SELECT * FROM base WHERE entity_id NOT IN (SELECT entity_id FROM one UNION SELECT entity_id FROM gone)
  UNION ALL SELECT * FROM one WHERE entity_id NOT IN (SELECT entity_id FROM two UNION SELECT entity_id FROM gone)
  UNION ALL SELECT * FROM two
)
SELECT CAST(entity_id AS BIGINT) AS entity_id, CAST(label AS BIGINT) AS label FROM merged""",
)
def q_index_append(spark: SparkSession, sf: str) -> DataFrame:
    """A published table, rows changed and added, rows changed and taken away, read back merged by id."""

    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("entity_id"), F.col("label").cast("long").alias("label"))
    change = lambda d, by: d.withColumn("label", F.col("label") + by)
    root = scratch_path(spark, "index-append")
    index.publish({"vectors": rows}, root, "e")
    one = rows.where("entity_id % 5 = 0").unionByName(rows.where("entity_id % 50 = 3").withColumn("entity_id", F.col("entity_id") + 1_000_000_000))
    index.append_index({"vectors": change(one, 100)}, root, "e")
    index.append_index({"vectors": change(rows.where("entity_id % 10 = 0"), 200)}, root, "e", {"vectors": rows.where("entity_id % 7 = 0")})
    return index.open_index(spark, root, "e", "vectors")


# ---------------------------------------------------------------------------
# Code extraction, references and call edges over sources derived from `documents`
# ---------------------------------------------------------------------------

for _name, _sql in {
    "extract_classes": code_corpus.EXTRACT_CLASSES_SQL,
    "extract_methods": code_corpus.EXTRACT_METHODS_SQL,
    "name_vocabulary": code_corpus.NAME_VOCABULARY_SQL,
    "code_references": code_corpus.CODE_REFERENCES_SQL,
    "attach_references": code_corpus.ATTACH_REFERENCES_SQL,
    "call_edges": code_corpus.CALL_EDGES_SQL,
    "resolved_references": code_corpus.RESOLVED_SQL,
    "call_reach": code_corpus.CALL_REACH_SQL,
    "csv_round_trip": code_corpus.CSV_ROUND_TRIP_SQL,
    "special_rows": f"""
SELECT 'File: doc/' || CAST(doc_id AS VARCHAR) || '.md' || chr(10) || chr(10) || 'Content:' || chr(10) || {_CLIP4000} || chr(10) || chr(10) AS source_code,
       'doc/' || CAST(doc_id AS VARCHAR) || '.md' AS file_path, 'empty' AS class_name, 'empty' AS constructor_declaration, 'empty' AS method_declarations, 'empty' AS refs
FROM documents""",
}.items():
    register(_name, _sql)(getattr(code_corpus, _name))
