from chartlake.operators import containment as ct
from conftest import FACTORIAL, MODIFIED, SIMPLE, chart_df


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "pair_id string, model1 string, model2 string")


def test_self_containment(spark):
    c = chart_df(spark, {"simple": SIMPLE, "fact": FACTORIAL})
    r = {x["pair_id"]: x for x in ct.containment(c, _pairs(spark, [("s", "simple", "simple"), ("f", "fact", "fact")])).collect()}
    assert r["s"]["contained"] and r["f"]["contained"]
    assert r["f"]["paths1"] == r["f"]["matched"] + r["f"]["unmatched"]


def test_upgrade_contains_original(spark):
    c = chart_df(spark, {"simple": SIMPLE, "modified": MODIFIED})
    r = ct.containment(c, _pairs(spark, [("p", "simple", "modified")])).collect()[0]
    assert r["contained"] and r["paths1"] == 1 and not r["vacuous"]


def test_compat_mode_is_vacuous(spark):
    c = chart_df(spark, {"simple": SIMPLE, "fact": FACTORIAL})
    r = ct.containment(c, _pairs(spark, [("p", "simple", "fact")]), mode="compat").collect()[0]
    assert r["paths1"] == 0 and r["contained"] and r["vacuous"]


def test_not_contained(spark):
    c = chart_df(spark, {"simple": SIMPLE, "fact": FACTORIAL})
    r = ct.containment(c, _pairs(spark, [("p", "simple", "fact")])).collect()[0]
    assert not r["contained"] and r["unmatched"] == 1


def test_semantics_of_simple_path(spark):
    c = chart_df(spark, {"simple": SIMPLE})
    p1, _ = ct.pair_paths(c, _pairs(spark, [("p", "simple", "simple")]))
    row = p1.collect()[0]
    assert row["cond_key"] == "counter >= 3"
    assert row["xform_key"] == "counter=counter + 1; done=True"


def test_equivalent_conditions_match(spark):
    def one(guard):
        return dict(steps=[("S", ""), ("E", "a := 1")], transitions=[("S", "E", guard)], variables=["a"], initial="S")

    c = chart_df(spark, {"x": one("k > 49"), "y": one("k >= 50"), "z": one("k >= 51"), "bad": one("k >> 1"), "n": one(None), "t": one("true")})
    rows = ct.containment(c, _pairs(spark, [
        ("xy", "x", "y"), ("yx", "y", "x"), ("xz", "x", "z"), ("bad", "bad", "bad"), ("nt", "n", "t")])).collect()
    got = {r["pair_id"]: r["contained"] for r in rows}
    assert got == {"xy": True, "yx": True, "xz": False, "bad": False, "nt": True}
    assert {r["pair_id"]: r["unknown"] for r in rows} == {"xy": 0, "yx": 0, "xz": 0, "bad": 1, "nt": 0}


def test_missing_guard_keeps_the_assignments(spark):
    from chartlake.charts import Charts
    c = chart_df(spark, {"m": dict(steps=[("S", ""), ("M", "b := 2"), ("E", "c := 3")],
                                   transitions=[("S", "M", "g"), ("M", "E", "x > 1")], variables=["b", "c"], initial="S")})
    from pyspark.sql import functions as F
    c = Charts(c.steps, c.transitions.withColumn("guard", F.when(F.col("t_idx") == 1, F.col("guard"))), c.meta)
    from chartlake.operators import graph
    row = ct.path_semantics(c, graph.cut_paths(c)).collect()[0]
    assert row["xform"] == {"b": "2", "c": "3"} and row["cond_key"] == "x > 1"


def test_second_side_is_held_once_for_all_its_pairs(spark):
    c = chart_df(spark, {"simple": SIMPLE, "modified": MODIFIED, "fact": FACTORIAL, "other": {**SIMPLE, "variables": ["done"]}})
    pairs = _pairs(spark, [(f"{m}{i}", m, "modified") for i in range(4) for m in ("simple", "fact", "modified", "other")])
    p1, p2 = ct.pair_paths(c, pairs)
    q1, q2 = ct.pair_paths(c, pairs, expand=False)
    rows = lambda df, cols: sorted(map(str, df.select(*cols).collect()))
    assert rows(p1, p1.columns) == rows(q1, p1.columns)
    n = p2.filter("pair_id = 'modified0'").count()
    lists = ct.common_variables(c, pairs).select("common_vars").distinct().count()
    assert p2.count() == 16 * n and q2.count() == lists * n  # one a list of common variables, not one a pair
    got = ct.path_match(q1, q2)
    assert rows(got, got.columns) == rows(ct.path_match(p1, p2), got.columns) and got.count() >= 4


def test_semantics_of_paths_with_several_targets_and_hops(spark):
    from chartlake.operators import graph
    chart = dict(steps=[("S", "s := 1"), ("A", "a := 1"), ("B", "b := a"), ("E", "a := a + 1; e := b")],
                 transitions=[("S", ["A", "B", "None"], "k > 1"), ("A", "E", "k >> 1"), ("B", "E", "k > 2")], variables=["a"], initial="S")
    c = chart_df(spark, {"m": chart})
    paths = spark.createDataFrame([("m", "one", [0]), ("m", "two", [0, 2]), ("m", "bad", [0, 1]), ("m", "single", [2]), ("m", "unread", [1])],
                                  "model_id string, path_key string, transitions array<int>")
    got = {r["path_key"]: (r["cond_key"], r["xform"]) for r in ct.path_semantics(c, paths).collect()}
    end, long = {"a": "a + 1", "e": "b"}, {"a": "(1) + 1", "b": "(1)", "e": "((1))"}  # targets are folded in order
    assert got == {"one": ("k > 1", {"a": "1", "b": "(1)"}), "two": ("k > 1 AND k > 2", long), "bad": (None, long),
                   "single": ("k > 2", end), "unread": (None, end)}
