import os
import tempfile

from chartlake.operators import runs as R
from chartlake.streaming.runs import run_state_stream

ATT = "job_id string, name string, type string, model string, attempt_no int, ok boolean, error boolean, tokens bigint, secs double"


def attempts(spark):
    rows = [("A", "a", "t", "GPT4o", 1, True, False, 5, 1.0)]
    rows += [("B", "b", "t", "Gemini", 1, False, False, 100, 1.5), ("B", "b", "t", "Gemini", 2, False, False, None, 2.0),
             ("B", "b", "t", "Gemini", 3, True, False, 7, 9.0)]
    rows += [("C", "c", "t", "LLaMA", 1, False, False, 10, 1.0), ("C", "c", "t", "LLaMA", 2, False, True, 20, 2.0),
             ("C", "c", "t", "LLaMA", 3, True, False, 1, 1.0)]
    rows += [("D", "d", "t", "Claude", i, False, False, 1, 1.0) for i in range(1, 11)]
    rows += [("D", "d", "t", "Claude", 11, True, False, 1, 1.0)]
    rows += [("E", "e", "t", "Perplexity", i, False, False, 3, 0.5) for i in range(1, 4)]
    return spark.createDataFrame(rows, ATT)


EXPECTED = {
    "A": ("success", 1, 0, 0.0), "B": ("success", 3, 100, 3.5), "C": ("error", 2, 30, 3.0),
    "D": ("timeout", 10, 10, 10.0), "E": ("open", 3, 9, 1.5),
}


def test_run_rollup(spark):
    got = {r["job_id"]: (r["status"], r["iterations"], r["tokens"], r["secs"]) for r in R.run_rollup(attempts(spark)).collect()}
    assert got == EXPECTED


def test_sheet_cells_and_melt(spark):
    sheet = R.long_to_sheet(R.run_rollup(attempts(spark)))
    row = {r["Benchmark Name"]: r for r in sheet.collect()}
    assert set(row) == {"a", "b", "c", "d"}                      # open runs are not written
    assert row["d"]["Claude_iter"] == "Timeout" and row["c"]["LLaMA_iter"].startswith("ERROR: ")
    long = R.sheet_to_long(sheet)
    assert sorted(r["name"] for r in long.collect()) == ["a", "b"]  # only numeric iterations survive


def test_upsert_replaces_cells(spark):
    runs = R.run_rollup(attempts(spark))
    old = R.long_to_sheet(runs)
    new = R.long_to_sheet(runs.filter("job_id = 'A'").withColumn("iterations", runs["iterations"] + 4))
    up = {r["Benchmark Name"]: r for r in R.sheet_upsert(old, new).collect()}
    assert up["a"]["GPT4o_iter"] == "5" and up["b"]["Gemini_iter"] == "3"


def test_stream_state_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="chartlake-stream-")
    attempts(spark).repartition(3).write.parquet(os.path.join(root, "feed"))
    s = run_state_stream(spark, os.path.join(root, "feed"), os.path.join(root, "state"))
    got = {r["job_id"]: (r["status"], r["iterations"], r["tokens"], r["secs"]) for r in s.collect()}
    assert got == EXPECTED


def test_streams_go_on_after_a_restart(spark):
    from pyspark.sql import functions as F
    from chartlake.streaming.runs import sheet_upsert_stream
    root = tempfile.mkdtemp(prefix="chartlake-restart-")
    feed, state = os.path.join(root, "feed"), os.path.join(root, "state")
    odd = attempts(spark).filter("attempt_no % 2 = 1").withColumn("message", F.when(F.col("error"), F.lit("own text")))
    even = attempts(spark).filter("attempt_no % 2 = 0").withColumn("message", F.when(F.col("error"), F.lit("own text")))
    even.coalesce(1).write.parquet(feed)                        # later attempts first
    run_state_stream(spark, feed, state)
    odd.coalesce(1).write.mode("append").parquet(feed)
    s = run_state_stream(spark, feed, state).collect()
    assert {r["job_id"]: (r["status"], r["iterations"], r["tokens"], r["secs"]) for r in s} == EXPECTED
    assert {r["message"] for r in s if r["status"] == "error"} == {"ERROR: own text"}
    runs = R.run_rollup(attempts(spark))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema.fields)
    feed, out = os.path.join(root, "runs"), os.path.join(root, "sheet")
    runs.filter("job_id = 'A'").coalesce(1).write.parquet(feed)
    assert sheet_upsert_stream(spark, feed, out, schema).count() == 1
    runs.filter("job_id <> 'A'").coalesce(1).write.mode("append").parquet(feed)
    assert {r["Benchmark Name"] for r in sheet_upsert_stream(spark, feed, out, schema).collect()} == {"a", "b", "c", "d"}
    assert sheet_upsert_stream(spark, feed, out, schema).count() == 4   # no new data


def test_positions_of_a_hot_group(spark):
    from pyspark.sql import functions as F
    from chartlake.operators.ranking import positions
    from chartlake.sources.derived import seq_number
    df = spark.range(4000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(F.lit(None)).alias("g"), (-F.col("id")).alias("v"))
    got = positions(df, ["g"], [F.desc("v")])
    want = df.groupBy("g").agg(F.sort_array(F.collect_list(-F.col("v"))).alias("l")).select("g", F.posexplode("l").alias("p", "id"))
    assert got.count() == 4000
    assert {(r["g"], r["rank"], -r["v"]) for r in got.collect()} == {(r["g"], r["p"] + 1, r["id"]) for r in want.collect()}
    first = seq_number(df, ["g"], ["v"], F.floor(F.col("v") / 100), first=3).filter("g is not null")
    assert first.groupBy("g").count().filter("count <> 3").count() == 0 and first.agg(F.max("seq")).first()[0] == 3


def test_job_success_rate(spark):
    rows = [("outputs/m/success/job.txt", "job.txt", "txt", "m", "success"),
            ("outputs/m/failed/job_1.txt", "job_1.txt", "txt", "m", "failed"),
            ("outputs/m/failed/other_2.json", "other_2.json", "json", "m", "failed"),
            ("outputs/m/failed/skip.html", "skip.html", "html", "m", "failed")]
    art = spark.createDataFrame(rows, "path string, file string, ext string, model string, status string")
    r = R.job_success_rate(art).collect()[0]
    assert r["total_jobs"] == 2 and abs(r["success_rate"] - 50.0) < 1e-9
    assert [x["job"] for x in R.truly_failed(art).collect()] == ["other.json"]


def test_fold_of_gaps_and_attempts_that_come_twice(spark):
    from chartlake.streaming.runs import fold_attempts
    att = "array<struct<attempt_no:int,at:timestamp,ok:boolean,error:boolean,tokens:bigint,secs:double,message:string>>"
    rows = [("gap", "n", "t", "m", [(3, None, True, False, 1, 1.0, None), (1, None, False, False, 2, None, None)]),
            ("late", "n", "t", "m", [(2, None, True, False, 9, 9.0, None)]),
            ("twice", "n", "t", "m", [(1, None, False, True, 4, 2.0, "x" * 200), (1, None, False, True, 4, 2.0, "x" * 200), (2, None, True, False, 1, 1.0, None)])]
    got = {r["job_id"]: tuple(r)[4:] for r in fold_attempts(spark.createDataFrame(rows, f"job_id string, name string, type string, model string, _a {att}")).collect()}
    assert got == {"gap": ("open", 1, 2, 0.0, None), "late": ("open", 0, 0, 0.0, None), "twice": ("error", 1, 4, 2.0, "ERROR: " + "x" * 100)}
