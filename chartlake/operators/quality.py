"""Chart data-quality checks (L1-L6): undefined guard variables, faulty guard operators,
dead-end steps, overlapping branch guards, dangling references and unreachable steps —
each a keyed DataFrame job over the chart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.charts import Charts
from chartlake.functions.equivalence import branch_overlap
from chartlake.functions.guards import canonical_guards, normalize_guard
from chartlake.operators import graph
from chartlake.operators.reach import marked_reachable

KEYWORDS = ["and", "or", "not", "true", "false"]


# L1 ------------------------------------------------------------------------------
def undefined_variables(c: Charts) -> DataFrame:
    """``(model_id, var)``: identifiers used in guards that the chart does not declare."""
    n = normalize_guard(F.col("guard"))
    ids = c.transitions.select("model_id", F.explode(F.regexp_extract_all(n, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\b"), 1)).alias("var"))
    ids = ids.filter(~F.col("var").isin(KEYWORDS)).distinct()
    declared = c.meta.select("model_id", F.explode("variables").alias("var"))
    return ids.join(declared, ["model_id", "var"], "left_anti")


# L2 ------------------------------------------------------------------------------
def bad_operator_guards(c: Charts) -> DataFrame:
    """``(model_id, t_idx, guard, issue)`` for ``=`` used as comparison, shift operators and
    missing guards."""
    g = F.coalesce(F.col("guard"), F.lit(""))
    issue = (
        F.when(F.trim(g) == "", "missing_guard")
        .when(g.rlike(r"<<|>>"), "shift_operator")
        .when(g.rlike(r"(?<![=!<>:])=(?!=)"), "single_equals")
    )
    return c.transitions.select("model_id", "t_idx", "guard", issue.alias("issue")).filter(F.col("issue").isNotNull())


# L3 ------------------------------------------------------------------------------
def no_exit_steps(c: Charts) -> DataFrame:
    return graph.sink_places(c)


# L4 ------------------------------------------------------------------------------
def overlapping_branches(c: Charts) -> DataFrame:
    """``(model_id, place, verdict, reason)`` of steps with two outgoing transitions whose guards hold together
    somewhere (``overlap``), or of which that is not known (``unknown``, with the reason). One row a step with its
    distinct outgoing guards, of which those on more than one transition overlap if they can hold at all; no pairs
    are emitted."""
    ai, _ = graph.chart_arcs(c)
    given = ai.withColumn("guard", F.coalesce("guard", F.lit(""))).join(graph.places(c), ["model_id", "place"], "left_semi")
    per = given.join(canonical_guards(given), "guard").groupBy("model_id", "place", "cg").agg(F.countDistinct("t_idx").alias("n"))
    per = per.groupBy("model_id", "place").agg(
        F.sum("n").alias("n_out"), F.max((F.col("cg").isNull()).cast("int")).alias("unread"),
        F.flatten(F.collect_list(F.when(F.col("cg").isNotNull(), F.expr("array_repeat(cg, cast(least(n, 2) as int))")))).alias("conds"))
    got = branch_overlap(per.filter("n_out >= 2"), "conds")
    return got.select(
        "model_id", "place",
        F.when(F.col("overlap"), "overlap").when(F.col("overlap").isNull() | (F.col("unread") == 1), "unknown").alias("verdict"),
        F.when(F.col("overlap"), F.lit(None).cast("string")).otherwise(F.coalesce("reason", F.lit("unparsable"))).alias("reason"),
    ).filter(F.col("verdict").isNotNull())


# L5 ------------------------------------------------------------------------------
def dangling_refs(c: Charts) -> DataFrame:
    """``(model_id, role, ref)``: transition ends or initial step naming no declared step."""
    ai, ao = graph.chart_arcs(c)
    pl = graph.places(c)
    refs = (ai.select("model_id", F.lit("src").alias("role"), "place")
            .unionByName(ao.select("model_id", F.lit("tgt").alias("role"), "place"))
            .unionByName(c.meta.filter(F.coalesce("initial_step", F.lit("")) != "")
                         .select("model_id", F.lit("initial").alias("role"), F.col("initial_step").alias("place"))))
    return refs.join(pl, ["model_id", "place"], "left_anti").select("model_id", "role", F.col("place").alias("ref")).distinct()


# L6 ------------------------------------------------------------------------------
def unreachable_steps(c: Charts) -> DataFrame:
    """``(model_id, place)``: steps that no path from the initial step reaches (all, where no declared step is initial)."""
    first = c.meta.select(F.col("model_id").alias("g"), F.col("initial_step").alias("node"), F.lit(True).alias("marked"))
    nodes = graph.step_order(c).join(first, ["g", "node"], "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    reached = marked_reachable(graph.keyed_edges(c), nodes)
    return graph.places(c).join(reached.select(F.col("g").alias("model_id"), F.col("node").alias("place")), ["model_id", "place"], "left_anti")
