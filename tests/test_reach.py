"""Components and reachability against plain searches on random graphs, and on charts of very many steps."""

import random

import pytest
from pyspark.sql import functions as F

from chartlake.charts import Charts
from chartlake.operators import graph, quality
from chartlake.operators import reach as reach_module
from chartlake.operators.reach import acyclic_closure, closure, marked_reachable, strong_components


def _reach(edges):
    out = {}
    for g, u, v in edges:
        out.setdefault((g, u), set()).add((g, v))
    got = {}
    for start in {(g, x) for g, u, v in edges for x in (u, v)}:
        seen, todo = set(), list(out.get(start, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        got[start] = seen
    return got


def _graphs(seed, ordered):
    rnd = random.Random(seed)
    edges, order = set(), []
    for g in range(8):
        n = rnd.randint(1, 11)
        names = [f"n{i}" for i in range(n)]
        place = list(range(n)) if ordered else rnd.sample(range(n), n)
        order += [(str(g), x, place[i]) for i, x in enumerate(names)]
        for _ in range(rnd.randint(0, 2 * n)):
            edges.add((str(g), rnd.choice(names), rnd.choice(names)))
    return sorted(edges), order


@pytest.mark.parametrize("seed,ordered,bits", [(1, True, 62), (2, False, 7)])
def test_components_and_marks_equal_search(spark, monkeypatch, seed, ordered, bits):
    monkeypatch.setattr(reach_module, "BITS", bits)  # graphs with more nodes go by rounds
    edges, order = _graphs(seed, ordered)
    reach = _reach(edges)
    e = spark.createDataFrame(edges, "g string, u string, v string")
    o = spark.createDataFrame(order, "g string, node string, ord int")
    got = strong_components(e, o).collect()
    root = {(r.g, r.node): r.root for r in got}
    assert len(root) == len(got) and set(root) == {x for x, seen in reach.items() if x in seen}
    for x in root:
        for y in root:
            assert (x[0] == y[0] and root[x] == root[y]) == (x == y or (y in reach[x] and x in reach[y]))
    marked = {(g, n) for g, n, k in order if k in (0, 3)}
    m = marked_reachable(e, o.withColumn("marked", F.col("ord").isin(0, 3)))
    assert {(r.g, r.node) for r in m.collect()} == marked.union(*[reach.get(x, set()) for x in marked])
    every = closure(e, o).collect()
    assert len(every) == len(set(every)) and {tuple(r) for r in every} == {(*x, y[1]) for x, s in reach.items() for y in s}
    forward = [(g, u, v) for g, u, v in edges if u < v]
    closed = acyclic_closure(spark.createDataFrame(forward, e.schema)).collect()
    assert len(closed) == len(set(closed)) and {tuple(r) for r in closed} == {(*x, y[1]) for x, s in _reach(forward).items() for y in s}


def _big(spark, n, edges):
    """One chart of ``n`` steps with the edges ``i -> j`` given by a column expression of ``i`` (null: none)."""
    i = spark.range(n).select(F.lit("m").alias("model_id"), F.col("id").cast("int").alias("ord"))
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    steps = i.select("model_id", "ord", name(F.col("ord")).alias("name"), F.lit("").alias("function"))
    tr = i.withColumn("to", F.expr(edges)).filter("to is not null").select(
        "model_id", F.col("ord").alias("t_idx"), F.array(name(F.col("ord"))).alias("src"), F.array(name(F.col("to"))).alias("tgt"), F.lit("g").alias("guard"))
    meta = spark.createDataFrame([("m", ["g"], "p0")], "model_id string, variables array<string>, initial_step string")
    return Charts(steps, tr, meta)


def test_ring_and_line_of_many_steps(spark):
    n = 20_000  # rounds grow with the logarithm of the length
    assert graph.cycle_places(_big(spark, n, f"(ord + 1) % {n}")).count() == n
    line = _big(spark, n, f"case when ord < {n - 1} and ord <> 7000 then ord + 1 end")
    assert quality.unreachable_steps(line).count() == n - 7_001


def test_two_rings_in_a_row(spark):
    c = _big(spark, 20, "case when ord = 9 then 0 when ord = 19 then 10 else ord + 1 end")
    more = c.transitions.limit(1).select("model_id", F.lit(99).alias("t_idx"), F.array(F.lit("p4")).alias("src"), F.array(F.lit("p12")).alias("tgt"), "guard")
    c = Charts(c.steps, c.transitions.unionByName(more), c.meta)
    assert graph.cycle_places(c).count() == 20
    assert graph.reachability(c).count() == 10 * 20 + 10 * 10


def test_no_edges_and_no_charts(spark):
    c = _big(spark, 3, "cast(null as int)")
    assert graph.cycle_places(c).collect() == [] and graph.reachability(c).collect() == []
    assert {r.place for r in quality.unreachable_steps(c).collect()} == {"p1", "p2"}
    none = Charts(c.steps.limit(0), c.transitions.limit(0), c.meta.limit(0))
    assert graph.cycle_places(none).collect() == [] and quality.unreachable_steps(none).collect() == []


def test_nodes_on_cycles_are_those_of_the_components_with_repeated_edges(spark):
    from chartlake.operators.reach import on_cycles
    ring = [("r", f"n{i:03}", f"n{(i + 1) % 70:03}") for i in range(70)]  # more than a bit mask holds
    small = [("s", "a", "b"), ("s", "b", "a"), ("s", "b", "c"), ("s", "d", "d")] * 20
    fan = [("f", "hub", f"x{i:02}") for i in range(40)] + [("f", "x05", "hub")]  # many edges, few nodes
    e = spark.createDataFrame(ring + small + fan, "g string, u string, v string")
    o = e.selectExpr("g", "u node", "0 ord").unionAll(e.selectExpr("g", "v", "1")).groupBy("g", "node").agg(F.min("ord").alias("ord"))
    got = sorted(map(tuple, on_cycles(e, o).select("g", "node").collect()))
    assert got == sorted(map(tuple, strong_components(e, o).select("g", "node").collect()))
    assert got == [("f", "hub"), ("f", "x05")] + [("r", f"n{i:03}") for i in range(70)] + [("s", "a"), ("s", "b"), ("s", "d")]
