"""Registered chart queries over D-CHART / D-PAIR (graph, guards, containment)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartlake.functions.guards import assignments, canonical_guard, transform_key
from chartlake.operators import containment as ct
from chartlake.operators import graph
from chartlake.plans.registry import query
from chartlake.plans.sql import compose
from chartlake.session import stored
from chartlake.sources.derived import day_week_pairs, load_event_charts


def _charts(spark, sf):
    c, idx = load_event_charts(spark, sf)
    return c.persist(), idx.persist()


# P1 --------------------------------------------------------------------------------
@query("chart_steps", compose("SELECT model_id, CAST(ord AS INTEGER) AS ord, name, function FROM ch_steps", "ch_steps"))
def q_chart_steps(spark, sf):
    c, _ = _charts(spark, sf)
    return c.steps.select("model_id", F.col("ord").cast("int").alias("ord"), "name", "function")


@query("step_function_map", compose("""
SELECT model_id, CAST(count(*) AS BIGINT) AS n_steps,
       string_agg(name || '=' || function, ' | ' ORDER BY name) AS functions
FROM ch_steps GROUP BY model_id""", "ch_steps"))
def q_step_function_map(spark, sf):
    c, _ = _charts(spark, sf)
    m = c.steps.groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "function"))).alias("fm"))
    ent = F.array_sort(F.map_entries("fm"))
    return m.select(
        "model_id", F.size(ent).cast("bigint").alias("n_steps"),
        F.array_join(F.transform(ent, lambda e: F.concat(e["key"], F.lit("="), e["value"])), " | ").alias("functions"),
    )


# G1 --------------------------------------------------------------------------------
@query("chart_arcs", compose("""
SELECT model_id, 'in' AS direction, src AS place, 't_' || CAST(t_idx AS VARCHAR) AS transition, guard FROM ch_trans
UNION ALL
SELECT model_id, 'out', tgt, 't_' || CAST(t_idx AS VARCHAR), guard FROM ch_trans""", "ch_trans"))
def q_chart_arcs(spark, sf):
    c, _ = _charts(spark, sf)
    ai, ao = graph.chart_arcs(c)
    g = c.transitions.select("model_id", "t_idx", "guard")
    return ai.select("model_id", F.lit("in").alias("direction"), "place", "transition", "guard").unionByName(
        ao.join(g, ["model_id", "t_idx"]).select("model_id", F.lit("out").alias("direction"), "place", "transition", "guard")
    )


# G2-G5, G7, G8 ---------------------------------------------------------------------
@query("place_degrees", compose("SELECT * FROM g_deg", "g_deg"))
def q_place_degrees(spark, sf):
    return graph.place_degrees(_charts(spark, sf)[0])


@query("initial_places", compose("SELECT model_id, initial_step AS place FROM ch_meta", "ch_meta"))
def q_initial_places(spark, sf):
    return graph.initial_places(_charts(spark, sf)[0])


@query("branch_places", compose("SELECT model_id, place FROM g_deg WHERE out_degree > 1", "g_deg"))
def q_branch_places(spark, sf):
    return graph.branch_places(_charts(spark, sf)[0])


@query("sink_places", compose("SELECT model_id, place FROM g_deg WHERE out_degree = 0", "g_deg"))
def q_sink_places(spark, sf):
    return graph.sink_places(_charts(spark, sf)[0])


@query("reachability", compose("SELECT model_id, src, dst FROM g_reach", "g_reach"))
def q_reachability(spark, sf):
    return graph.reachability(_charts(spark, sf)[0])


@query("cycle_places", compose("SELECT DISTINCT model_id, src AS place FROM g_reach WHERE src = dst", "g_reach"))
def q_cycle_places(spark, sf):
    return graph.cycle_places(_charts(spark, sf)[0])


@query("cut_points", compose("""
SELECT model_id, CAST(count(*) AS BIGINT) AS n_cut_points, string_agg(place, ',' ORDER BY place) AS cut_points
FROM g_cuts GROUP BY model_id""", "g_cuts"))
def q_cut_points(spark, sf):
    c, _ = _charts(spark, sf)
    cl = graph.cut_point_lists(graph.cut_points(c))
    return cl.select("model_id", F.size("cut_points").cast("bigint").alias("n_cut_points"),
                     F.array_join("cut_points", ",").alias("cut_points"))


# G9 / G10 --------------------------------------------------------------------------
@query("cut_paths", compose("""
SELECT model_id, path_key, from_place, to_place, CAST(len(transitions) AS INTEGER) AS n_hops FROM g_paths""", "g_paths"))
def q_cut_paths(spark, sf):
    p = graph.cut_paths(_charts(spark, sf)[0])
    return p.select("model_id", "path_key", "from_place", "to_place", F.size("transitions").cast("int").alias("n_hops"))


@query("cut_paths_compat", compose("""
SELECT model_id, path_key, from_place, to_place, CAST(len(transitions) AS INTEGER) AS n_hops FROM g_paths_compat""",
                                   "g_paths_compat"))
def q_cut_paths_compat(spark, sf):
    p = graph.cut_paths_compat(_charts(spark, sf)[0])
    return p.select("model_id", "path_key", "from_place", "to_place", F.size("transitions").cast("int").alias("n_hops"))


# E1 --------------------------------------------------------------------------------
@query("assignments", compose("""
SELECT model_id, name, CAST(0 AS INTEGER) AS pos, 'acc' AS lhs, 'acc + ' || CAST(length(name) AS VARCHAR) AS rhs FROM ch_steps
UNION ALL
SELECT model_id, name, 1, 'last', 'k' FROM ch_steps""", "ch_steps"))
def q_assignments(spark, sf):
    a = assignments(_charts(spark, sf)[0].steps)
    return a.select("model_id", "name", F.col("pos").cast("int").alias("pos"), "lhs", "rhs")


# E8 / E9 ---------------------------------------------------------------------------
@query("path_condition", compose("SELECT model_id, path_key, cond_key FROM g_sem", "g_sem"))
def q_path_condition(spark, sf):
    c, _ = _charts(spark, sf)
    s = ct.path_semantics(c, graph.cut_paths(c))
    return s.select("model_id", "path_key", "cond_key")


@query("path_transform", compose("SELECT model_id, path_key, xform_key FROM g_sem", "g_sem"))
def q_path_transform(spark, sf):
    c, _ = _charts(spark, sf)
    s = ct.path_semantics(c, graph.cut_paths(c))
    v = c.meta.select("model_id", "variables")
    return s.join(v, "model_id").select("model_id", "path_key", transform_key(F.col("xform"), F.col("variables")).alias("xform_key"))


# J3 --------------------------------------------------------------------------------
@query("common_variables", compose("SELECT pair_id, 'acc,k,last' AS common_vars FROM d_pair", "d_pair"))
def q_common_variables(spark, sf):
    c, idx = _charts(spark, sf)
    cv = ct.common_variables(c, day_week_pairs(idx))
    return cv.select("pair_id", F.array_join("common_vars", ",").alias("common_vars"))


# J4 / J5 / A5 ----------------------------------------------------------------------
@query("path_match", compose("SELECT pair_id, path_key, match_key FROM c_match", "c_match"))
def q_path_match(spark, sf):
    c, idx = _charts(spark, sf)
    p1, p2 = ct.pair_paths(c, day_week_pairs(idx), expand=False)
    return ct.path_match(p1, p2)


@query("path_unmatched", compose("""
SELECT a.pair_id, a.path_key, a.cond_key, a.xform_key FROM c_p1 a
WHERE NOT EXISTS (SELECT 1 FROM c_match m WHERE m.pair_id = a.pair_id AND m.path_key = a.path_key)""", "c_p1", "c_match"))
def q_path_unmatched(spark, sf):
    c, idx = _charts(spark, sf)
    p1, p2 = ct.pair_paths(c, day_week_pairs(idx), expand=False)
    return ct.path_unmatched(p1, ct.path_match(p1, p2)).select("pair_id", "path_key", "cond_key", "xform_key")


@query("containment_summary", compose("SELECT * FROM c_contain", "c_contain"))
def q_containment_summary(spark, sf):
    c, idx = _charts(spark, sf)
    return ct.containment(c, day_week_pairs(idx)).drop("unknown")  # every guard of these charts is read; see containment_dialects


# E4 on the chart guards ---------------------------------------------------------------
@query("canonical_guard_charts", compose("SELECT DISTINCT guard, guard AS canonical FROM ch_trans", "ch_trans"))
def q_canonical_guard_charts(spark, sf):
    c, _ = _charts(spark, sf)
    return c.transitions.select("guard").distinct().select("guard", canonical_guard(F.col("guard")).alias("canonical"))


# E7 / E10 / E11 --------------------------------------------------------------------------
@query("substitute", compose("""
SELECT t.model_id, CAST(t.t_idx AS INTEGER) AS t_idx,
       '(acc + ' || CAST(length(t.src) AS VARCHAR) || ') + ' || CAST(length(t.tgt) AS VARCHAR) AS acc_after
FROM ch_trans t""", "ch_trans"))
def q_substitute(spark, sf):
    """E7 per transition: the target step's ``acc`` right-hand side with the source step's value put in."""
    from chartlake.functions.guards import assignments as asg, substitute
    c, _ = _charts(spark, sf)
    a = asg(c.steps).filter(F.col("lhs") == "acc").select("model_id", "name", "rhs")
    t = c.transitions.select("model_id", "t_idx", F.col("src")[0].alias("src"), F.col("tgt")[0].alias("tgt"))
    j = (t.join(a.withColumnRenamed("name", "src").withColumnRenamed("rhs", "src_rhs"), ["model_id", "src"])
         .join(a.withColumnRenamed("name", "tgt").withColumnRenamed("rhs", "tgt_rhs"), ["model_id", "tgt"]))
    return j.select("model_id", F.col("t_idx").cast("int"),
                    substitute(F.col("tgt_rhs"), F.create_map(F.lit("acc"), F.col("src_rhs"))).alias("acc_after"))


@query("transform_map", compose("""
SELECT model_id, path_key, 2 AS n_vars, split_part(split_part(xform_key, '; last=', 1), 'acc=', 2) AS acc_expr,
       'k' AS last_expr FROM g_sem""", "g_sem"))
def q_transform_map(spark, sf):
    """Transform keys back to maps."""
    from chartlake.functions.guards import transform_map
    c, _ = _charts(spark, sf)
    s = ct.path_semantics(c, graph.cut_paths(c)).join(c.meta.select("model_id", "variables"), "model_id")
    m = s.select("model_id", "path_key", transform_map(transform_key(F.col("xform"), F.col("variables"))).alias("m"))
    return m.select("model_id", "path_key", F.size("m").alias("n_vars"), F.col("m")["acc"].alias("acc_expr"),
                    F.col("m")["last"].alias("last_expr"))


@query("transform_equal", compose("""
SELECT d.pair_id, a.path_key, a.xform_key = b.xform_key AS same_transform
FROM d_pair d JOIN g_sem a ON a.model_id = d.model1 JOIN g_sem b ON b.model_id = d.model2 AND b.path_key = a.path_key""",
                                  "d_pair", "g_sem"))
def q_transform_equal(spark, sf):
    """The transform of each model-1 path against the model-2 path with the same key, on the common variables."""
    from chartlake.functions.guards import transform_equal
    c, idx = _charts(spark, sf)
    pairs = day_week_pairs(idx)
    c = ct.paired_charts(c, pairs)
    paths = graph.cut_paths(c)
    end = lambda m: paths.select(F.col("model_id").alias(m), "path_key")
    both = stored(ct.common_variables(c, pairs).join(end("model1"), "model1").join(end("model2"), ["model2", "path_key"]))
    # only paths whose key occurs on both sides are folded
    met = both.select(F.explode(F.array("model1", "model2")).alias("model_id"), "path_key").distinct()
    sem = stored(ct.path_semantics(c, paths.join(met, ["model_id", "path_key"], "left_semi")).select(
        "model_id", "path_key", "xform").dropDuplicates(["model_id", "path_key"]))
    a = sem.withColumnRenamed("model_id", "model1").withColumnRenamed("xform", "m1")
    b = sem.withColumnRenamed("model_id", "model2").withColumnRenamed("xform", "m2")
    j = both.join(a, ["model1", "path_key"]).join(b, ["model2", "path_key"])
    return j.select("pair_id", "path_key", transform_equal(F.col("m1"), F.col("m2"), F.col("common_vars")).alias("same_transform"))
