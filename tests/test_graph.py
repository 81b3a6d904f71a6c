from pyspark.sql import functions as F

from chartlake.operators import graph, quality
from conftest import FACTORIAL, INVALID, SIMPLE, TRAFFIC, chart_df


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_cut_points_simple_and_factorial(spark):
    c = chart_df(spark, {"simple": SIMPLE, "fact": FACTORIAL})
    got = {r["model_id"]: r["cut_points"] for r in graph.cut_point_lists(graph.cut_points(c)).collect()}
    assert got["simple"] == ["End", "Start"]
    assert got["fact"] == ["Check", "End", "Increment", "Multiply", "Start"]


def test_paths_single_hop_vs_multi_hop(spark):
    c = chart_df(spark, {"simple": SIMPLE})
    assert graph.cut_paths_compat(c).count() == 0          # only one-hop paths: none here
    p = graph.cut_paths(c).collect()
    assert [(r["from_place"], r["to_place"], r["path_key"]) for r in p] == [("Start", "End", "t_0,t_1>End")]


def test_reachability_and_cycles(spark):
    c = chart_df(spark, {"fact": FACTORIAL})
    r = set(_rows(graph.reachability(c), "src", "dst"))
    assert ("Check", "Check") in r and ("Start", "End") in r and ("End", "Start") not in r
    assert _rows(graph.cycle_places(c), "place") == [("Check",), ("Increment",), ("Multiply",)]


def test_second_transition_without_target_is_a_branch(spark):
    c = chart_df(spark, {"m": dict(
        steps=[("S", ""), ("M", ""), ("E", "")],
        transitions=[("S", "M", "a"), ("M", "E", "b"), ("M", [], "d")], variables=[], initial="S")})
    assert _rows(graph.cut_points(c), "place") == [("E",), ("M",), ("S",)]
    assert _rows(graph.cut_paths(c), "path_key") == [("t_0>M",), ("t_1>E",)]


def test_ring_of_many_steps(spark):
    n = 500
    names = [f"p{i}" for i in range(n)]
    ring = dict(steps=[(x, "") for x in names], transitions=[(names[i], names[(i + 1) % n], "g") for i in range(n)],
                variables=[], initial="p0")
    line = dict(steps=[(x, "") for x in names], transitions=[(names[i], names[i + 1], "g") for i in range(n - 1)],
                variables=[], initial="p0")
    c = chart_df(spark, {"ring": ring, "line": line})
    got = {r["model_id"]: r["count"] for r in graph.reachability(c).groupBy("model_id").count().collect()}
    assert got == {"ring": n * n, "line": n * (n - 1) // 2}
    paths = graph.cut_paths(c).filter("model_id = 'line'").collect()
    assert [(p["from_place"], p["to_place"], len(p["transitions"])) for p in paths] == [("p0", "p499", n - 1)]


def test_cycle_without_given_cuts_ends(spark):
    c = chart_df(spark, {"t": TRAFFIC})
    cuts = spark.createDataFrame([("t", "Cleanup")], "model_id string, place string")
    assert graph.cut_paths(c, cuts).collect() == []


def test_paths_between_cuts_are_put_aside_and_others_grow(spark):
    line = dict(steps=[(x, "") for x in "ABCDE"], transitions=[("A", "B", ""), ("A", "C", ""), ("B", "C", ""), ("C", "D", ""), ("D", "E", "")],
                variables=[], initial="A")
    c = chart_df(spark, {"m": line})
    whole = [("t_0,t_2,t_3,t_4>E",), ("t_1,t_3,t_4>E",)]
    assert _rows(graph.cut_paths(c), "path_key") == whole
    assert _rows(graph.cut_paths(c, graph.cut_points(c)), "path_key") == whole


def test_degrees(spark):
    c = chart_df(spark, {"fact": FACTORIAL})
    d = {r["place"]: (r["out_degree"], r["in_degree"]) for r in graph.place_degrees(c).collect()}
    assert d["Check"] == (2, 2) and d["End"] == (0, 1) and d["Start"] == (1, 0)


def test_quality_checks(spark):
    c = chart_df(spark, {"invalid": INVALID, "traffic": TRAFFIC})
    assert _rows(quality.dangling_refs(c), "model_id", "role", "ref") == [("invalid", "tgt", "NonExistentStep")]
    assert _rows(quality.unreachable_steps(c), "model_id", "place") == [("traffic", "Cleanup")]
    assert _rows(quality.no_exit_steps(c), "model_id", "place") == []


def test_overlap_sees_brackets_and_tells_unknown(spark):
    def one(*guards):
        return dict(steps=[("S", ""), ("E", "")], transitions=[("S", "E", g) for g in guards], variables=[], initial="S")

    c = chart_df(spark, {"br": one("(x > 5)", "(x > 3)"), "no": one("x > 5", "x <= 5"), "vv": one("x > y", "x <= y"), "bad": one("x >> 1", "x"),
                         "dec": one("x > 2.5", "x == 2.5"), "str": one("s == 'a'", "s != 'b'"), "two": one("k", "k"), "null": one(None, "k"),
                         "grid": one(*[f"v{i} > {i}" for i in range(12)])})
    got = {r["model_id"]: (r["verdict"], r["reason"]) for r in quality.overlapping_branches(c).collect()}
    assert got == {"br": ("overlap", None), "bad": ("unknown", "unparsable"), "str": ("overlap", None), "two": ("overlap", None),
                   "null": ("overlap", None), "grid": ("overlap", None)}
