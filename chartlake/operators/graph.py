"""Graph operators over chart tables (G1-G10): Petri-net arcs, degrees, cut-points,
reachability and cut-point paths for every model at once.

All operators are keyed by ``model_id``. Cycles and reachability come from strongly connected components (``reach``);
cut-point paths double their length each round, so rounds grow with the logarithm of the longest path, not with the
number of charts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.charts import Charts
from chartlake.operators.reach import closure, on_cycles, stored_count
from chartlake.session import stored


def t_name(idx_col="t_idx"):
    return F.concat(F.lit("t_"), F.col(idx_col).cast("string"))


# G1 ------------------------------------------------------------------------------
def chart_arcs(c: Charts) -> tuple[DataFrame, DataFrame]:
    """Input arcs ``(model_id, place, t_idx, transition, guard)`` and output arcs
    ``(model_id, t_idx, transition, place)``; list-valued src/tgt fan out."""
    arcs_in = c.transitions.select(
        "model_id", "t_idx", t_name().alias("transition"), "guard", F.explode("src").alias("place")
    )
    arcs_out = c.transitions.select("model_id", "t_idx", t_name().alias("transition"), F.explode("tgt").alias("place"))
    return arcs_in, arcs_out


def places(c: Charts) -> DataFrame:
    return c.steps.select("model_id", F.col("name").alias("place")).distinct()


def place_edges(c: Charts) -> DataFrame:
    """place -> place through one transition; only declared places have outgoing arcs."""
    src = c.transitions.select("model_id", "t_idx", F.explode("src").alias("place"), "tgt").join(places(c), ["model_id", "place"], "left_semi")
    return src.select("model_id", "t_idx", F.col("place").alias("src"), F.explode("tgt").alias("dst"))


# G2 ------------------------------------------------------------------------------
def place_degrees(c: Charts) -> DataFrame:
    arcs_in, arcs_out = chart_arcs(c)
    outd = arcs_in.groupBy("model_id", "place").agg(F.countDistinct("t_idx").alias("out_degree"))
    ind = arcs_out.groupBy("model_id", "place").agg(F.countDistinct("t_idx").alias("in_degree"))
    return (
        places(c)
        .join(outd, ["model_id", "place"], "left")
        .join(ind, ["model_id", "place"], "left")
        .select("model_id", "place",
                F.coalesce("out_degree", F.lit(0)).cast("bigint").alias("out_degree"),
                F.coalesce("in_degree", F.lit(0)).cast("bigint").alias("in_degree"))
    )


# G3-G5 ---------------------------------------------------------------------------
def initial_places(c: Charts) -> DataFrame:
    return c.meta.filter(F.coalesce(F.col("initial_step"), F.lit("")) != "").select(
        "model_id", F.col("initial_step").alias("place")
    )


def branch_places(c: Charts, degrees: DataFrame | None = None) -> DataFrame:
    d = degrees if degrees is not None else place_degrees(c)
    return d.filter("out_degree > 1").select("model_id", "place")


def sink_places(c: Charts, degrees: DataFrame | None = None) -> DataFrame:
    d = degrees if degrees is not None else place_degrees(c)
    return d.filter("out_degree = 0").select("model_id", "place")


# G6 ------------------------------------------------------------------------------
def step_order(c: Charts) -> DataFrame:
    """``(g, node, ord)``: the position of each declared step, first one counting."""
    return c.steps.groupBy(F.col("model_id").alias("g"), F.col("name").alias("node")).agg(F.min("ord").alias("ord"))


def keyed_edges(c: Charts, edges: DataFrame | None = None) -> DataFrame:
    return (edges if edges is not None else stored(place_edges(c))).select(F.col("model_id").alias("g"), F.col("src").alias("u"), F.col("dst").alias("v"))


def reachability(c: Charts) -> DataFrame:
    """Transitive closure ``(model_id, src, dst)`` over paths of length >= 1 (see ``reach.closure``)."""
    return closure(keyed_edges(c), step_order(c)).select(F.col("g").alias("model_id"), F.col("u").alias("src"), F.col("v").alias("dst"))


# G7 ------------------------------------------------------------------------------
def cycle_places(c: Charts, edges: DataFrame | None = None) -> DataFrame:
    """``(model_id, place)`` of the places on a cycle: those in strongly connected components (see ``reach``), no closure."""
    return on_cycles(keyed_edges(c, edges), step_order(c)).select(F.col("g").alias("model_id"), F.col("node").alias("place"))


# G8 ------------------------------------------------------------------------------
def cut_points(c: Charts, edges: DataFrame | None = None) -> DataFrame:
    """Initial, branching, sink and cyclic places ``(model_id, place)``; ``edges``: the charts' ``place_edges``, if at hand."""
    arcs_in, _ = chart_arcs(c)
    out = arcs_in.groupBy("model_id", "place").agg(F.min("t_idx").alias("least"), F.max("t_idx").alias("most"))
    branch_or_sink = places(c).join(out, ["model_id", "place"], "left").filter("least is null or least < most").select("model_id", "place")
    return initial_places(c).unionByName(branch_or_sink).unionByName(cycle_places(c, edges)).distinct()


def cut_point_lists(cuts: DataFrame) -> DataFrame:
    return cuts.groupBy("model_id").agg(F.array_sort(F.collect_set("place")).alias("cut_points"))


# G9 / G10 ------------------------------------------------------------------------
def _finish_paths(done: DataFrame, keep_loops: bool) -> DataFrame:
    out = done.withColumnRenamed("dst", "to_place")
    if not keep_loops:
        out = out.filter(F.col("from_place") != F.col("to_place"))
    return out.select(
        "model_id", "from_place", "to_place", "transitions",
        F.concat(
            F.array_join(F.transform("transitions", lambda t: F.concat(F.lit("t_"), t.cast("string"))), ","),
            F.lit(">"), F.col("to_place"),
        ).alias("path_key"),
    )


def cut_paths(c: Charts, cuts: DataFrame | None = None, mode: str = "multi_hop", keep_loops: bool = False) -> DataFrame:
    """Paths between cut-points whose interior places are not cut-points.

    Returns ``(model_id, from_place, to_place, transitions ARRAY<INT>, path_key)`` where
    ``transitions`` holds t indices in hop order and ``path_key`` is a deterministic
    text id. ``mode='compat'`` keeps single-hop paths only.

    Segments start as edges. Those from cut-point to cut-point are paths and are put aside; a round appends to every
    segment that ends inside a path all segments that start there, so segments double in length and ``log2`` of the
    longest path rounds suffice."""
    edges = stored(place_edges(c))
    given = cuts is not None
    cuts = stored((cuts if given else cut_points(c, edges)).select("model_id", "place").distinct())
    ends = lambda c, at: cuts.select("model_id", F.col("place").alias(c), F.lit(True).alias(at))
    first = edges.withColumnRenamed("src", "from_place").join(ends("dst", "at_cut"), ["model_id", "dst"], "left").join(
        ends("from_place", "from_cut"), ["model_id", "from_place"], "left").select(
        "model_id", "from_place", "dst", F.array("t_idx").alias("transitions"),
        F.coalesce("from_cut", F.lit(False)).alias("from_cut"), F.coalesce("at_cut", F.lit(False)).alias("at_cut"))
    if mode != "multi_hop":
        return _finish_paths(first.filter("from_cut and at_cut"), keep_loops)
    first, inside = stored_count(first, ~F.col("at_cut"))
    done, segments = first.filter("from_cut and at_cut"), first.filter("not (from_cut and at_cut)")
    rounds = None  # every cycle holds own cut-points; given ones may leave one out, in which what is open after these rounds runs
    if given and inside:
        rounds = first.groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0].bit_length() + 1
    while inside and rounds != 0:
        longer = segments.filter("not at_cut").alias("a").join(
            segments.alias("b"), (F.col("a.model_id") == F.col("b.model_id")) & (F.col("a.dst") == F.col("b.from_place"))
        ).select(F.col("a.model_id").alias("model_id"), F.col("a.from_place").alias("from_place"), F.col("b.dst").alias("dst"),
                 F.concat("a.transitions", "b.transitions").alias("transitions"), F.col("a.from_cut").alias("from_cut"), F.col("b.at_cut").alias("at_cut"))
        segments, inside = stored_count(segments.filter("at_cut").unionByName(longer), ~F.col("at_cut"))
        rounds = rounds - 1 if rounds else None
    return _finish_paths(done.unionByName(segments.filter("from_cut and at_cut")), keep_loops)


def cut_paths_compat(c: Charts, cuts: DataFrame | None = None) -> DataFrame:
    return cut_paths(c, cuts, mode="compat")
