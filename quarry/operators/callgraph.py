"""Repository call graph (A9): caller method → called name, from the same tables the
index build produces.

An edge is a method-call occurrence (R3) placed inside the innermost method whose
line span contains it (equi-join on ``(file, line)`` against each method's exploded
line span). ``expand`` follows edges to a fixed depth with
repeated equi-joins on the callee name. ``resolved_edges`` joins definitions instead of names,
and ``reach`` follows them to the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def call_edges(methods: DataFrame, method_refs: DataFrame, key: str = "file_path") -> DataFrame:
    """``(caller_file, caller_class, caller, callee, line, column)`` per call site."""
    calls = method_refs.where(F.col("kind") == "method").select(F.col("file").alias("_f"), "line", "column", F.col("name").alias("callee"))
    # each method exploded into the lines it covers: placing a call is an equi-join on
    # (file, line), never a range test of every call against every method of a file
    m = methods.select(
        F.col(key).alias("caller_file"), F.col("class_name").alias("caller_class"), F.col("name").alias("caller"), "start_line",
        F.explode(F.sequence(F.col("start_line"), F.col("end_line"))).alias("_ml"),
    )
    j = calls.join(m, (calls["_f"] == m["caller_file"]) & (calls["line"] == m["_ml"]))
    # innermost enclosing method = the latest start line among those containing the call
    best = j.groupBy("_f", "line", "column", "callee").agg(F.max_by(F.struct("caller_file", "caller_class", "caller"), "start_line").alias("c"))
    return best.select("c.caller_file", "c.caller_class", "c.caller", "callee", "line", "column")


def expand(edges: DataFrame, depth: int = 2) -> DataFrame:
    """Distinct ``(caller, callee, hops)`` reachable within ``depth`` hops (the fewest hops).

    A pair reached before is not followed again, so cycles end.
    """
    base = edges.select("caller", "callee").distinct()
    out = base.withColumn("hops", F.lit(1))
    frontier = base
    for h in range(2, depth + 1):
        step = frontier.alias("a").join(base.alias("b"), F.col("a.callee") == F.col("b.caller"))
        step = step.select(F.col("a.caller").alias("caller"), F.col("b.callee").alias("callee")).distinct()
        frontier = step.join(out.select("caller", "callee"), ["caller", "callee"], "left_anti")
        out = out.unionByName(frontier.withColumn("hops", F.lit(h)))
    return out


def resolved_edges(methods: DataFrame, resolved: DataFrame, key: str = "file_path") -> DataFrame:
    """Distinct ``(caller, callee)`` from ``refs.resolve_references``, each a ``file#line`` of a definition."""
    calls = resolved.where("kind = 'method' and target_file is not null")
    m = methods.select(F.col(key).alias("_f"), "start_line", "name_line", F.explode(F.sequence("start_line", "end_line")).alias("_l"))
    j = calls.join(m, (calls["file"] == m["_f"]) & (calls["line"] == m["_l"]))
    best = j.groupBy("file", "line", "column", "target_file", "target_line").agg(F.max_by("name_line", F.struct("start_line", "name_line")).alias("at"))
    return best.select(F.concat_ws("#", "file", F.col("at").cast("string")).alias("caller"), F.concat_ws("#", "target_file", F.col("target_line").cast("string")).alias("callee")).distinct()


def reach(edges: DataFrame, source: str = "caller", target: str = "callee") -> DataFrame:
    """All pairs ``(source, target)`` with a path of one edge or more between them.

    Semi-naive by doubling: in each round the pairs new in the last one are joined to all
    known ones on either side, and only pairs not known before go on, so the rounds are the
    logarithm of the longest shortest path, cycles end by themselves, and no pair is followed
    twice. Each round is written to the shared folder; nothing but a count comes to the driver.
    """
    checkpoint_dir(edges.sparkSession)
    known = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null").distinct().checkpoint(eager=True)
    new = known
    while not new.isEmpty():
        ahead = new.join(known.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        back = known.select("a", F.col("b").alias("m")).join(new.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        new = ahead.unionByName(back).distinct().join(known, ["a", "b"], "left_anti").checkpoint(eager=True)
        known = known.unionByName(new)
    return known.select(F.col("a").alias(source), F.col("b").alias(target))
