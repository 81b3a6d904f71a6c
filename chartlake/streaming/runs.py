"""Structured Streaming jobs over attempt / run feeds (ST1, ST2).

ST2 keeps the attempts of every job as keyed state of a streaming aggregation (at most the iteration cap per job, and what
arrives twice): they may arrive out of order, and each micro-batch folds the jobs it touched by column expressions;
a run moves open -> success / error / timeout exactly like the batch roll-up.

ST1 upserts the results sheet after every micro-batch into a new snapshot folder (the batch id
is in the path, so a replayed batch rewrites its own snapshot and never the one being read).

Both write through ``foreachBatch`` into the shared I/O folder; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.operators import runs as R

ATTEMPT_SCHEMA = ("job_id string, name string, type string, model string, attempt_no int, ok boolean, error boolean, "
                  "tokens bigint, secs double, message string")
RUN_OUT = ["name", "type", "model", "status", "iterations", "tokens", "secs", "message"]


def fold_attempts(seen: DataFrame, cap: int = R.MAX_ITERATIONS) -> DataFrame:
    """The run of each job from the attempts that have arrived (``_a``): the attempts from the first one up to the first gap, folded
    like the batch roll-up. Of an attempt that arrives twice the earlier arrival counts."""
    sorted_ = seen.withColumn("_a", F.array_sort("_a"))
    once = sorted_.withColumn("_a", F.filter("_a", lambda x, i: (i == 0) | (F.get("_a", i - 1)["attempt_no"] != x["attempt_no"])))
    run = once.withColumn("_a", F.filter("_a", lambda x, i: x["attempt_no"] == i + 1))
    run = run.withColumn("_e", F.get(F.filter("_a", lambda x: x["ok"] | x["error"]), F.lit(0)))
    end, error = F.col("_e.attempt_no"), F.col("_e.error") & ~F.col("_e.ok")
    status = F.when(F.col("_e.ok"), "success").when(error, "error").when(F.size("_a") >= cap, "timeout").otherwise("open")
    run = run.withColumn("_n", F.filter("_a", lambda x: F.coalesce((x["attempt_no"] < end) | ((x["attempt_no"] == end) & ~x["ok"]), F.lit(True))))
    total = lambda name, zero: F.aggregate("_n", zero, lambda t, x: t + F.coalesce(x[name], zero))
    return run.select(
        "job_id", "name", "type", "model", status.alias("status"), F.coalesce(end, F.size("_a")).cast("int").alias("iterations"),
        total("tokens", F.lit(0).cast("bigint")).alias("tokens"), total("secs", F.lit(0.0)).alias("secs"),
        F.when(error, F.concat(F.lit("ERROR: "), F.substring(F.coalesce("_e.message", F.lit("")), 1, 100))).alias("message"))


def run_state_stream(spark: SparkSession, attempts_path: str, out_path: str, files_per_trigger: int = 1) -> DataFrame:
    """ST2: stream the attempt files, keep per-job state, append every micro-batch's updates
    under ``out_path/batch=<id>``; return the final state (last update per job)."""
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    src = (spark.readStream.schema(ATTEMPT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(attempts_path)
           .filter(F.col("attempt_no").between(1, R.MAX_ITERATIONS)))
    # the time of the micro-batch, the same when it is run again
    att = F.struct("attempt_no", F.current_timestamp().alias("at"), no("ok"), no("error"), "tokens", "secs", "message")
    upd = fold_attempts(src.select("job_id", "name", "type", "model", att.alias("a")).groupBy("job_id").agg(
        F.max("name").alias("name"), F.max("type").alias("type"), F.max("model").alias("model"), F.collect_list("a").alias("_a")))

    def sink(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_path}/updates/batch={batch_id}")

    q = (upd.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", f"{out_path}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    u = spark.read.parquet(f"{out_path}/updates")
    last = u.groupBy("job_id").agg(F.max_by(F.struct(*RUN_OUT), "batch").alias("s"))
    return last.select("job_id", "s.*").withColumn("secs", F.round("secs", 2))


def sheet_upsert_stream(spark: SparkSession, runs_path: str, out_path: str, runs_schema: str,
                        files_per_trigger: int = 1) -> DataFrame:
    """ST1: after every micro-batch of finished runs, upsert them into the sheet and write the
    result as snapshot ``out_path/v=<batch_id>``; return the final snapshot."""
    def snapshot(batch_id: int) -> str:
        return f"{out_path}/v={batch_id:09d}"

    def sink(df: DataFrame, batch_id: int) -> None:
        # batch ids go on after a restart, so the sheet before is always the one of the id before
        new = R.long_to_sheet(df)
        merged = R.sheet_upsert(spark.read.parquet(snapshot(batch_id - 1)), new) if batch_id > 0 else new
        merged.write.mode("overwrite").parquet(snapshot(batch_id))

    src = spark.readStream.schema(runs_schema).option("maxFilesPerTrigger", files_per_trigger).parquet(runs_path)
    q = (src.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out_path}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    try:
        last = spark.read.parquet(f"{out_path}/v=*").select(F.max(F.regexp_extract(F.col("_metadata.file_path"), r"/v=(\d+)/", 1))).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return R.long_to_sheet(spark.read.schema(runs_schema).parquet(runs_path))
    return spark.read.parquet(snapshot(int(last)))
