"""Reachability in many graphs at once, without a table of (source, target) pairs.

Everything stands on one iteration, ``greatest_reachable``: each node holds the greatest label it is known to reach. A
round looks at the nodes one edge ahead and then, ``JUMPS`` times, at what the node of the held label itself holds, so
the look-ahead grows by a factor and a chain of ``n`` nodes needs about ``log n`` rounds. Rounds are semi-naive: only labels that
changed in the last round are sent along edges.

* marked reachability: label the marked nodes above all others, edges reversed;
* strongly connected components: forward colouring by greatest label, then backward search inside each colour for the
  nodes that the colour's node reaches; what is left falls apart by both results and goes into the next turn.

Graphs are keyed rows ``(g, u, v)``, so millions of small graphs and a few very large ones run in the same joins. Graphs
of at most ``BITS`` nodes skip the rounds: each is one row with a bit mask a node, closed by Warshall's rule within a
projection. The results are the same either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chartlake.session import stored

#: Nodes of a graph whose reachable sets are bits of one long.
BITS = 62
#: Looks at the node of the held label in each round.
JUMPS = 4


def stored_count(df: DataFrame, what: Column) -> tuple[DataFrame, int]:
    """Write a table, and the number of its rows for which ``what`` holds, observed by the same job."""
    seen = Observation()
    kept = stored(df.observe(seen, F.coalesce(F.sum(what.cast("long")), F.lit(0)).alias("n")))
    return kept, seen.get["n"]


def by_size(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct edges of small graphs as one row each, ``g, nodes, reach`` (``reach[i]``: bit mask of the nodes that a path of one or
    more edges reaches from ``nodes[i]``), and the edges of all other graphs."""
    edges = edges.select("g", "u", "v")
    # a graph of few edges has few nodes; the others' nodes are counted
    many = edges.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BITS // 2).select("g")
    nodes = _nodes_of(edges.join(many, "g", "left_semi")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    large = stored(nodes.filter(F.col("n") > BITS).select("g"))
    # at most BITS^2 edges a row
    rows = edges.join(large, "g", "left_anti").groupBy("g").agg(F.collect_set(F.struct("u", "v")).alias("e"))
    rows = rows.select("g", "e", F.array_sort(F.array_distinct(F.concat(F.col("e.u"), F.col("e.v")))).alias("nodes"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    at = lambda x: (F.array_position("nodes", x) - 1).cast("int")
    ahead = F.transform("nodes", lambda x: F.aggregate(
        F.filter("e", lambda e: e["u"] == x), F.lit(0).cast("long"), lambda m, e: m.bitwiseOR(bit(at(e["v"])))))
    closed = F.aggregate(
        F.sequence(F.lit(0), F.size("nodes") - 1), F.col("ahead"),
        lambda m, k: F.transform(m, lambda x: F.when(has_bit(x, k), x.bitwiseOR(F.get(m, k))).otherwise(x)))
    return rows.select("g", "nodes", ahead.alias("ahead")).select("g", "nodes", closed.alias("reach")), edges.join(large, "g", "left_semi").distinct()


def has_bit(mask: Column, i: Column) -> Column:
    return F.call_function("shiftrightunsigned", mask, i.cast("int")).bitwiseAND(F.lit(1)) == 1


def members_of(nodes: str, mask: Column) -> Column:
    """The nodes whose bits are set."""
    return F.filter(nodes, lambda _, i: has_bit(mask, i))


def greatest_reachable(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(g, node, best)``: the greatest label reachable from each node over zero or more edges ``(g, u, v)``.

    ``labels(g, node, label)`` names every node once; a label is a struct whose last field is ``node`` itself, so that the
    node of a label can be looked up and labels are unique within ``g``."""
    state = stored(labels.select("g", "node", F.col("label").alias("best"), F.lit(True).alias("fresh")))
    changed = 1
    while changed:
        ahead = state.filter("fresh").select("g", F.col("node").alias("v"), "best")
        near = edges.join(ahead, ["g", "v"]).select("g", F.col("u").alias("node"), "best")
        none = F.lit(None).cast(state.schema["best"].dataType)
        every = state.select("g", "node", "best", F.col("best").alias("held")).unionByName(near.withColumn("held", none))
        # new rows of nodes without a label (ends of edges that ``labels`` leaves out) are no state
        ahead = every.groupBy("g", "node").agg(F.max("best").alias("best"), F.max("held").alias("held")).filter("held is not null")
        there = state.select("g", F.col("node").alias("_to"), F.col("best").alias("_best"))
        for _ in range(JUMPS):
            ahead = ahead.withColumn("_to", F.col("best.node")).join(there, ["g", "_to"], "left").select(
                "g", "node", F.greatest("best", "_best").alias("best"), "held")
        state, changed = stored_count(ahead.withColumn("fresh", F.col("best") > F.col("held")).drop("held"), F.col("fresh"))
    return state.select("g", "node", "best")


def _nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select("g", F.explode(F.array("u", "v")).alias("node")).distinct()


def marked_reachable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(g, node)`` of the nodes that some marked node reaches over zero or more edges.

    ``nodes(g, node, ord, marked)``; ``ord`` is any number, best the order in which edges mostly run: rounds are then few."""
    small, edges = by_size(edges.filter("u <> v"))
    marks = nodes.filter("marked").join(edges.select("g").distinct(), "g", "left_anti").groupBy("g").agg(
        F.collect_list("node").alias("marks"))  # marks of small graphs, and of graphs without edges
    every = F.aggregate(F.zip_with("nodes", "reach", lambda x, m: F.when(F.array_contains("marks", x), m).otherwise(F.lit(0).cast("long"))),
                        F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(m))
    near = small.join(marks, "g").select("g", F.explode(members_of("nodes", every)).alias("node"))
    found = near.unionByName(nodes.filter("marked").select("g", "node"))
    edges, left = stored_count(edges, F.lit(1))
    if not left:
        return found.distinct()
    nodes = nodes.join(edges.select("g").distinct(), "g", "left_semi")
    label = F.struct(F.col("marked").cast("int").alias("top"), (-F.col("ord")).alias("back"), "node")
    back = edges.select("g", F.col("v").alias("u"), F.col("u").alias("v"))
    far = greatest_reachable(back, nodes.select("g", "node", label.alias("label"))).filter("best.top = 1").select("g", "node")
    return found.unionByName(far).distinct()


def strong_components(edges: DataFrame, order: DataFrame) -> DataFrame:
    """``(g, node, root)`` of the nodes that lie on a cycle; nodes of one strongly connected component share the root.

    ``order(g, node, ord)`` gives every node a number, best the order in which edges mostly run; any order is right.
    A node with an edge to itself is on a cycle. Edges whose ends cannot lie on a common cycle are dropped each turn,
    so a turn works on what is undecided. No (source, target) pairs are built. The first turn goes by the given order;
    along a line this drops one edge a turn, so later turns go by hashes, which break a line into pieces in both directions."""
    small, large = by_size(edges)
    ring = F.filter(F.transform(F.arrays_zip("nodes", "reach"), lambda x, i: F.struct(
        x["nodes"].alias("node"), has_bit(x["reach"], i).alias("on"),
        F.get(F.filter("nodes", lambda _, j: has_bit(x["reach"], j) & has_bit(F.get("reach", j), i)), F.lit(0)).alias("root"))), lambda x: x["on"])
    near = small.select("g", F.explode(ring).alias("x")).select("g", "x.node", "x.root")
    return near.unionByName(_large_components(large, order))


def on_cycles(edges: DataFrame, order: DataFrame) -> DataFrame:
    """``(g, node)`` of the nodes that lie on a cycle."""
    small, large = by_size(edges)
    near = small.select("g", F.explode(F.filter("nodes", lambda _, i: has_bit(F.get("reach", i), i))).alias("node"))
    return near.unionByName(_large_components(large, order).select("g", "node"))


def _large_components(large: DataFrame, order: DataFrame) -> DataFrame:
    loops = large.filter("u = v").select("g", F.col("u").alias("node")).distinct()
    rest = large.filter("u <> v")
    rest, left = stored_count(rest.join(rest.select("g", F.col("u").alias("v")).distinct(), ["g", "v"], "left_semi").select("g", "u", "v"), F.lit(1))
    found, turn = None, 0
    while left:
        mixed = lambda salt: F.shiftright(F.xxhash64("node", F.lit(salt)), 1)
        ahead, behind = (mixed(turn), mixed(-turn)) if turn else (F.col("ord"), -F.col("ord"))
        nodes = stored(_nodes_of(rest).join(order, ["g", "node"]).select("g", "node", ahead.alias("ord"), behind.alias("back")))
        turn += 1
        ahead = greatest_reachable(rest, nodes.select("g", "node", F.struct("ord", "node").alias("label")))
        held = ahead.select("g", "node", F.col("best.node").alias("pivot"))
        ends = lambda e, s, c: e.join(s.select("g", F.col("node").alias("u"), F.col(c).alias("_a")), ["g", "u"]).join(
            s.select("g", F.col("node").alias("v"), F.col(c).alias("_b")), ["g", "v"]).filter("_a = _b")
        rest = stored(ends(rest, held, "pivot").select("g", "u", "v", F.col("_a").alias("pivot")))
        label = F.struct((F.col("node") == F.col("pivot")).cast("int").alias("top"), "back", "node")
        back = greatest_reachable(rest.select("g", F.col("v").alias("u"), F.col("u").alias("v")),
                                  nodes.join(held, ["g", "node"]).select("g", "node", label.alias("label")))
        same = stored(ends(rest, back, "best").select("g", "u", "v", "pivot", F.col("_a.top").alias("top")))
        one = same.filter("top = 1").select("g", F.col("u").alias("node"), F.col("pivot").alias("root")).distinct()
        found = one if found is None else found.unionByName(one)
        rest, left = stored_count(same.filter("top = 0").select("g", "u", "v"), F.lit(1))
    alone = loops.withColumn("root", F.col("node"))
    if found is not None:
        alone = found.unionByName(alone.join(found, ["g", "node"], "left_anti"))
    return alone.select("g", "node", "root")


def acyclic_closure(edges: DataFrame) -> DataFrame:
    """``(g, u, v)`` for every path of one or more edges of acyclic graphs.

    Beside the pairs found so far, a round holds the pairs with a walk of exactly ``2^k`` edges; the new pairs are a pair
    found so far followed by such a walk, and the next walks are two of them. In acyclic graphs the walks run out after
    ``log2`` of the longest path, so no round has to count the pairs. Each pair is written once, in its own round."""
    small, large = by_size(stored(edges))
    near = small.select("g", F.explode(F.arrays_zip("nodes", "reach")).alias("x"), "nodes").select(
        "g", F.col("x.nodes").alias("u"), F.explode(members_of("nodes", F.col("x.reach"))).alias("v"))
    walks, left = stored_count(large, F.lit(1))
    known = walks
    while left:
        step = walks.select("g", F.col("u").alias("v"), F.col("v").alias("w"))
        join = lambda a: a.join(step, ["g", "v"]).select("g", "u", F.col("w").alias("v")).distinct()
        known = known.unionByName(stored(join(known).join(known, ["g", "u", "v"], "left_anti")))
        walks, left = stored_count(join(walks), F.lit(1))
    return near.unionByName(known)


def closure(edges: DataFrame, order: DataFrame) -> DataFrame:
    """``(g, u, v)`` for every path of one or more edges. Nodes of one cycle reach the same nodes, so the closure is taken
    between components and spread to their nodes at the end; rows are written once, in proportion to the result."""
    small, large = by_size(edges)
    near = small.select("g", F.explode(F.arrays_zip("nodes", "reach")).alias("x"), "nodes").select(
        "g", F.col("x.nodes").alias("u"), F.explode(members_of("nodes", F.col("x.reach"))).alias("v"))
    large, left = stored_count(large, F.lit(1))
    if not left:
        return near
    comp = stored(strong_components(large, order))
    of = lambda end: comp.select("g", F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    between = large.join(of("u"), ["g", "u"], "left").join(of("v"), ["g", "v"], "left").select(
        "g", F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")).filter("u <> v")
    roots = comp.select("g", F.col("root").alias("u"), F.col("root").alias("v")).distinct()
    pairs = acyclic_closure(between).unionByName(roots)
    inside = lambda end, name: comp.select("g", F.col("root").alias(end), F.col("node").alias(name))
    far = pairs.join(inside("u", "a"), ["g", "u"], "left").join(inside("v", "b"), ["g", "v"], "left").select(
        "g", F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
    return near.unionByName(far)
