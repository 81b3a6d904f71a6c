import pytest
from pyspark.sql import functions as F

from chartlake.functions.equivalence import guard_equivalent
from chartlake.functions.guards import assignments, canonical_guard, fold_functions, normalize_guard, substitute

CASES = [
    ("a", "a"), ("true", "true"), ("TRUE", "true"), ("init", "true"), ("always", "true"), ("", "true"),
    ("x == 5", "x == 5"), ("x = 5", "x == 5"), ("x <> 5", "x != 5"), ("x != 5", "x != 5"),
    ("a AND b", "a and b"), ("a && b || !c", "a and b or not c"), ("'True'", "true"),
    ("lvl >= 3 and lvl < 9", "lvl < 9 and lvl >= 3"), ("9 > lvl and 3 <= lvl", "lvl < 9 and lvl >= 3"),
    ("c > limit", "c > limit"), ("not k > 5", "k <= 5"), ("x == true", "x"), ("x == false", "not x"),
    ("x - 1 >= 0", None), ("(>= i 0)", None), ("x > 0; i := i - 1", None), ("x >> 1", None), ("a &&& b", None),
    ("not (s == 'True')", "not s"), ("(a and b) or c", "a and b or c"), ("not (k > 5 or x)", "k <= 5 and not x"),
    ("(x - 1) >= 0", None),
]


def test_canonical_guards(spark):
    from chartlake.functions.guards import canonical_guards
    df = spark.createDataFrame([(g,) for g, _ in CASES], "g string")
    got = {r["guard"]: r["cg"] for r in canonical_guards(df, "g").collect()}
    for g, want in CASES:
        assert got[g] == want, g


def test_nested_path_agrees_with_flat_path(spark):
    from chartlake.functions.guards import nested_canonical_text
    flat = [g for g, c in CASES if c is not None and "(" not in g]
    df = spark.createDataFrame([(g,) for g in flat], "g string")
    for r in df.select("g", normalize_guard(F.col("g")).alias("n"), canonical_guard(F.col("g")).alias("c")).collect():
        if r["c"] != "true":
            assert nested_canonical_text(r["n"]) == r["c"], r["g"]


def test_normalize(spark):
    df = spark.createDataFrame([("a&&b",), ("x<>1",), ("k=3",), ("A AND NOT b",)], "g string")
    got = [r[0] for r in df.select(normalize_guard(F.col("g"))).collect()]
    assert got == ["a and b", "x != 1", "k == 3", "A and not b"]


def test_assignments_and_parallel_fold(spark):
    steps = spark.createDataFrame([("m", "s", "a := b; b := a; noise; c := a + 1")], "model_id string, name string, function string")
    a = [(r["pos"], r["lhs"], r["rhs"]) for r in assignments(steps).orderBy("pos").collect()]
    assert a == [(0, "a", "b"), (1, "b", "a"), (2, "c", "a + 1")]
    seq = spark.createDataFrame([(["a := b; b := a", "a := a + b"],)], "f array<string>")
    m = seq.select(fold_functions(F.col("f")).alias("m")).collect()[0]["m"]
    # within a step both right-hand sides see the old values (swap), then a := a + b uses them
    assert m == {"a": "(b) + (a)", "b": "a"}


def test_substitute_whole_words(spark):
    df = spark.createDataFrame([("acc + acc2 + x", {"acc": "acc + 1", "x": "y"})], "e string, m map<string,string>")
    assert df.select(substitute(F.col("e"), F.col("m"))).collect()[0][0] == "(acc + 1) + acc2 + (y)"


@pytest.mark.parametrize("c1,c2,verdict", [
    ("k >= 5", "k > 4", "equivalent"),
    ("k >= 5", "k > 5", "different"),
    ("a and b", "b and a", "equivalent"),
    ("k < 50 AND k >= 50", "k < 10 AND k > 20", "equivalent"),
    ("c > limit", "limit < c", "not_refuted"),
    ("x == 1 or x == 2", "x >= 1 and x <= 2", "equivalent"),
])
def test_bounded_domain_equivalence(spark, c1, c2, verdict):
    df = spark.createDataFrame([(c1, c2)], "c1 string, c2 string")
    assert guard_equivalent(df, "c1", "c2").collect()[0]["verdict"] == verdict


def test_equivalence_agrees_with_canonical_keys(spark):
    gs = [g for g, c in CASES if c is not None]
    df = spark.createDataFrame([(a, b) for a in gs for b in gs], "a string, b string").select(
        canonical_guard(F.col("a")).alias("c1"), canonical_guard(F.col("b")).alias("c2")).distinct()
    for r in guard_equivalent(df, "c1", "c2").collect():
        if r["c1"] is not None and r["c1"] == r["c2"]:
            assert r["verdict"] in ("equivalent", "not_refuted")


@pytest.mark.parametrize("c1,c2,verdict,reason", [
    ("k > 49", "k >= 50", "equivalent", None),
    ("x >= 2.5", "x > 2.5", "different", None),
    ("x > 2.5 or x <= 2.5", "true", "equivalent", None),
    ("s == 'abc'", "s == 'abd'", "different", None),
    ("x or x >= 5", "true", "different", None),
    ("x > y", "y < x", "not_refuted", None),
    ("x > y and z", "y < x", "unknown", "related"),
    ("s == 'a' or s > 3", "true", "unknown", "types"),
    (None, "true", "unknown", "unparsable"),
    (" and ".join(f"v{i} > {i}" for i in range(13)), "true", "unknown", "size"),
])
def test_equivalence_never_fails(spark, c1, c2, verdict, reason):
    df = spark.createDataFrame([(c1, c2)], "c1 string, c2 string")
    r = guard_equivalent(df, "c1", "c2").collect()[0]
    assert (r["verdict"], r["reason"]) == (verdict, reason)


def test_condition_keys_agree_with_verdicts():
    from chartlake.functions.equivalence import condition_key, equivalence_verdict
    conds = ["k > 49", "k >= 50", "k >= 49.5", "not k", "k == 0", "k", "k != 0", "k or k >= 50", "true", "a or not a", "a and not a",
             "k < 1 AND k > 4", "s == 'x'", "s != 'x'", "s == 'x' or s != 'y'", "a and b", "b and a or a and b", "a or b", "x > y", "y < x", "y <= x"]
    conds = [c for c in conds]
    for a in conds:
        for b in conds:
            same = condition_key(a)[0] == condition_key(b)[0]
            verdict = equivalence_verdict(a, b)[0]
            if same:
                assert verdict in ("equivalent", "not_refuted"), (a, b)
            # a decimal or a bare use changes how a variable's values are cut, so equal functions may have two keys
            elif "." not in a + b and not {a, b} & {"k", "not k"}:
                assert verdict != "equivalent", (a, b)


def test_constants_and_bigger_guards(spark):
    from chartlake.functions.guards import canonical_guards
    wide = " and ".join(f"(a{i} or b{i})" for i in range(7))  # 128 clauses
    df = spark.createDataFrame([("1",), ("0",), ("x and 1",), ("x and 0",), ("x or 1",), ("(x > 5)",), ("x >= 2.5",), ("2.5 < x",),
                                ("s == 'abc'",), ("(a and 0) or b",), (wide,)], "g string")
    got = {r["guard"]: r["cg"] for r in canonical_guards(df, "g").collect()}
    assert got["1"] == "true" and got["0"] == "false" and got["x and 1"] == "x" and got["x and 0"] == "false" and got["x or 1"] == "true"
    assert got["(x > 5)"] == "x > 5" and got["2.5 < x"] == "x > 2.5" and got["s == 'abc'"] == "s == 'abc'" and got["(a and 0) or b"] == "b"
    assert got[wide].count(" or ") == 127


def test_types_from_arithmetic(spark):
    from conftest import chart_df
    from chartlake.functions.guards import infer_var_types
    c = chart_df(spark, {"m": dict(steps=[("S", "")], transitions=[("S", "S", "n + 1 == 3 and flag"), ("S", "S", "3 < q"), ("S", "S", "2 * p == 4")],
                                   variables=["n", "flag", "q", "p"], initial="S")})
    assert {r["var"]: r["type"] for r in infer_var_types(c).collect()} == {"n": "Int", "flag": "Bool", "q": "Int", "p": "Int"}


def test_atoms_of_bracketed_guards(spark):
    from chartlake.functions.guards import guard_atoms
    df = spark.createDataFrame([("not (k > 5 or x)",)], "g string")
    got = sorted((r["clause"], r["var"], r["op"], r["val"], r["negated"]) for r in guard_atoms(df, "g").collect())
    assert got == [(0, "k", "<=", "5", False), (0, "x", "", "", True)]


def test_doubling_assignments_stay_small(spark):
    from chartlake.functions.guards import expression_nodes
    n = 60
    seqs = spark.createDataFrame([(["x := 1", *["x := x + x"] * n],), (["x := 1", *["x := x + x"] * 40, "y := x"],), (["x := 1"],)], "fun_seq array<string>")
    for longest in (10_000, 12):
        got = seqs.select(fold_functions(F.col("fun_seq"), longest).alias("m")).collect()
        nodes = {r["node"]: r["expr"] for r in expression_nodes(seqs, longest=longest).collect()}
        assert all(len(v) <= max(longest, 33) for r in got for v in r["m"].values()) and len(nodes) <= n

        known = {}

        def value(text):
            for node in sorted(nodes):
                if node in text and node not in known:
                    known[node] = value(nodes[node])
            for node, v in known.items():
                text = text.replace(node, str(v))
            return eval(text)  # sums of numbers and brackets

        assert sorted(value(r["m"]["x"]) for r in got) == [1, 2**40, 2**60]
        assert value(next(r["m"]["y"] for r in got if "y" in r["m"])) == 2**40


def test_bracketed_alternatives_do_not_multiply():
    import time

    from chartlake.functions.guards import nested_canonical_text
    pairs = [f"(a{i} or b{i})" for i in range(20)]
    start = time.time()
    got = nested_canonical_text(" and ".join(pairs))
    assert got == " AND ".join(f"a{i} or b{i}" for i in sorted(range(20), key=str)) and time.time() - start < 1
    assert nested_canonical_text("not (" + " or ".join(f"(not a{i} and not b{i})" for i in reversed(range(20))) + ")") == got
    assert nested_canonical_text(" and ".join([*pairs, "(c and 0)"])) == "false"
    assert nested_canonical_text("(x and y) or (" + " and ".join(pairs) + ")") is None  # no conjunction outermost


def test_guard_keys_are_read_from_distinct_texts(spark):
    from chartlake.functions.guards import canonical_guards
    df = spark.createDataFrame([("a > 1",), ("a > 1",), (None,), ("(b or c)",)], "g string")
    got = canonical_guards(df, "g")
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()  # nothing to move the tests below
    assert sorted(((r["guard"], r["cg"]) for r in got.collect()), key=str) == [("(b or c)", "b or c"), ("a > 1", "a > 1"), (None, "true")]


def test_join_on_guards_reads_no_guard_twice(spark):
    from chartlake.functions.guards import canonical_guards
    t = spark.createDataFrame([(i, g) for i, g in enumerate(["x > 1", "(x > 1)", "k >> 1"] * 5)], "i int, guard string")
    j = t.join(canonical_guards(t), "guard")
    assert "regexp" not in j._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted((r["guard"], r["cg"]) for r in j.distinct().collect() if r["i"] < 3) == [("(x > 1)", "x > 1"), ("k >> 1", None), ("x > 1", "x > 1")]
