from pyspark.sql import functions as F

from chartlake.functions import text as X
from chartlake.operators import scoring as S


def one(spark, col, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col).collect()[0][0]


def test_measures_follow_python_semantics(spark):
    t = F.col("t")
    assert one(spark, X.word_count(t), "  a  b\tc\n") == 3
    assert one(spark, X.line_count(t), "a\n") == 2
    assert one(spark, X.char_count(t), "é") == 1 and one(spark, X.byte_count(t), "é") == 2
    assert one(spark, X.estimate_tokens(F.lit(1499)), "x") == 1998
    assert abs(one(spark, X.estimate_cost(F.lit(1998)), "x") - 0.003996) < 1e-12


def test_html_escape_and_fence(spark):
    assert one(spark, X.html_escape(F.col("t")), "<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"
    assert one(spark, X.strip_markdown_fence(F.col("t")), "```python\nx = 1\n```") == "x = 1"


def test_code_block_extraction(spark):
    t = F.col("t")
    assert one(spark, X.extract_code_block(t), "pre\n```python\nsteps2 = []\n```\npost") == "steps2 = []\n"
    assert one(spark, X.extract_code_block(t), "```\nabc```") == "abc"
    unfenced = "Sure:\nsteps2 = [\n  {'name': 'A'}\n]\nnoise\ntransitions2 = []\nbye"
    assert one(spark, X.extract_code_block(t), unfenced) == "steps2 = [\n  {'name': 'A'}\n]\ntransitions2 = []"
    assert one(spark, X.extract_code_block(t), "nothing here") == ""


def test_parse_reply_never_executes(spark):
    reply = "```python\nsteps2 = [{'name': 'A', 'function': 'x := 1'}]\ntransitions2 = [{'src': 'A', 'tgt': 'A', 'guard': 'x > 0'}]\n```"
    r = one(spark, X.parse_code_reply(F.col("t")), reply)
    assert r["status"] == "ok" and r["steps2"][0]["name"] == "A" and r["transitions2"][0]["guard"] == "x > 0"
    assert one(spark, X.parse_code_reply(F.col("t")), "import os; os.system('x')")["status"] == "no_code_block"


def test_api_error_flag(spark):
    assert one(spark, X.api_error_flag(F.col("t")), "Error 403 forbidden")
    assert not one(spark, X.api_error_flag(F.col("t")), "error handling is fine")


def test_cost_accuracy_formula(spark):
    body = " ".join(["word"] * 1480)
    text = "# Title\nexample must rule error validate comment\n```code```\n" + body
    m = one(spark, S.score_cost_accuracy(F.col("t"), F.lit("Accuracy-Effective")), text)
    raw = 15 + 15 + 10 + 10 + 10 + 10 + 10 + 5 + 10 + 15
    assert m["quality_score"] == 100
    assert m["token_count"] == int(m["word_count"] / 0.75)
    assert abs(m["quality_per_token"] - raw / m["token_count"]) < 1e-12
    assert abs(m["cost_efficiency"] - raw / max(m["token_count"] / 1000 * 0.002, 0.001)) < 1e-9


def test_grade_and_gated_counts(spark):
    assert one(spark, X.grade(F.lit(80), S.GRADE_REPORT, "needs_improvement"), "x") == "good"
    t = F.col("t")
    txt = "It Explains and describes; Step 1 and Phase 2. ### 3. x"
    gated = one(spark, sum(X.count_matches(t, p, g) for p, g in zip(S.EXPLANATION_RES, S.EXPLANATION_GATES)), txt)
    plain = one(spark, sum(X.count_matches(t, p) for p in S.EXPLANATION_RES), txt)
    assert gated == plain == 2


def test_rules_from_a_table(spark):
    from chartlake.operators.rules import rule_hits, rule_scores
    docs = spark.createDataFrame([(1, "the cat  saw the\tcat"), (2, None), (3, ""), (4, "The Cat"), (5, "a cat cat cat")], "doc_id int, text string")
    rules = spark.createDataFrame([("cat", "animal", 2.0), ("the  cat", "phrase", None), ("cat cat", "phrase", 5.0), ("cat", "animal", 1.0), (" ", "none", 1.0),
                                   (None, "none", 1.0)] + [(f"term{i}", "many", 1.0) for i in range(100_000)], "term string, category string, weight double")
    got = sorted((r.doc_id, r.category, r.term, r.n, r.weight) for r in rule_hits(docs, rules).collect())
    assert got == [(1, "animal", "cat", 2, 2.0), (1, "phrase", "the cat", 2, 1.0), (5, "animal", "cat", 3, 2.0), (5, "phrase", "cat cat", 2, 5.0)]
    assert sorted(tuple(r) for r in rule_scores(docs, rules, fold=True).filter("doc_id = 4").collect()) == [(4, "animal", 1, 1, 2.0), (4, "phrase", 1, 1, 1.0)]
    assert rule_hits(docs, rules.limit(0)).collect() == []


def test_positions_read_their_rows_once(spark):
    from pyspark.sql import functions as F

    from chartlake.operators.ranking import positions
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.createDataFrame([(i % 3, i) for i in range(300)], "k int, v int").mapInPandas(count, "k int, v int")
    got = {(r["k"], r["v"]): r["rank"] for r in positions(rows, ["k"], [F.desc("v")]).collect()}
    assert got == {(i % 3, i): 100 - i // 3 for i in range(300)}
    assert seen.value == 300


def test_scores_alone_do_not_compute_issues(spark):
    docs = spark.createDataFrame([(1, "notes.txt", "# Head one\n- **x**\nStep 1"), (2, "notes.txt", None)], "doc_id long, file_name string, text string")
    scored = S.score_overall(docs)
    plan = S.rank_by_each_score(scored)
    scores = scored.select("doc_id", "overall_score")._jdf.queryExecution().optimizedPlan().toString()
    assert "No code examples provided" not in scores and "CASE" in scores
    assert "No code examples provided" in scored.filter("doc_id = 1").first()["issues"]
    assert sorted({(r["ranking"], r["rank"]) for r in plan.collect()}) == sorted((n, i) for n, _ in S.RANKINGS for i in (1, 2))
