from pyspark.sql import functions as F

from quarry.functions import text as tx


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_strip_directive_cases(spark):
    # directive removed everywhere, ends stripped, inner spacing kept
    rows = [("@codebase how is area computed?", "how is area computed?", True),
            ("and why?", "and why?", False),
            ("x @codebase y @codebase", "x  y", True)]
    for text, stripped, has in rows:
        assert one(spark, tx.strip_directive(F.col("s")), text) == stripped
        assert one(spark, tx.has_directive(F.col("s")), text) is has


def test_to_bool(spark):
    vals = ["true", "True", "1", "yes", "false", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r["b"] for r in df.select(tx.to_bool("s").alias("b")).collect()]
    assert got == [True, True, True, False, False, False]


def test_normalize_whitespace_matches_python(spark):
    import re

    samples = ["a\tb\n\nc  d ", " x y　", "", "  lead", "tail\r\n"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r["n"] for r in df.select(tx.normalize_whitespace("s").alias("n")).collect()]
    want = [re.sub(r"\s+", " ", s.replace("\n", " ").replace("\t", " ")).strip() for s in samples]
    assert got == want


def test_clip_tokens_prefix_and_idempotent(spark):
    text = "  one two\tthree\nfour five  "
    c3 = one(spark, tx.clip_tokens(F.col("s"), 3), text)
    assert c3 == "  one two\tthree"
    assert text.startswith(c3)
    assert one(spark, tx.clip_tokens(F.col("s"), 3), c3) == c3
    assert one(spark, tx.clip_tokens(F.col("s"), 10), text) == text


def test_preview_and_clip_chars(spark):
    long = "é" * 250
    assert one(spark, tx.preview(F.col("s")), long) == "é" * 200 + "..."
    assert one(spark, tx.preview(F.col("s")), "short") == "short"
    assert one(spark, tx.clip_chars(F.col("s"), 3), "ñandú") == "ñan"


def test_fill_template_is_single_pass(spark):
    t = "Q: {query} C: {temp_context}."
    df = spark.createDataFrame([("{temp_context}", "ctx {query}")], "q string, c string")
    r = df.select(tx.fill_template(t, query=F.col("q"), temp_context=F.col("c")).alias("r")).first()["r"]
    assert r == t.format(query="{temp_context}", temp_context="ctx {query}")


def test_json_entry_round_trip(spark):
    df = spark.createDataFrame([("q \"x\"\n", None)], "q string, r string")
    j = df.select(tx.json_entry("q", "r").alias("j")).first()["j"]
    import json

    assert json.loads(j) == {"query": "q \"x\"\n", "response": None}


def test_extract_tagged(spark):
    assert one(spark, tx.extract_tagged(F.col("s")), "pre <query>better\nq</query> post") == "better\nq"
