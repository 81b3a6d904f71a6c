"""Registered streaming queries (ST1, ST2): the attempt log / run feed is written as files
into the shared I/O folder and consumed by Structured Streaming (``availableNow``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartlake.operators import runs as R
from chartlake.plans import q_runs  # noqa: F401  (runs / sheet CTEs)
from chartlake.plans.registry import query
from chartlake.plans.sql import compose
from chartlake.sinks.text import io_root
from chartlake.sources.derived import load_attempts
from chartlake.streaming.runs import ATTEMPT_SCHEMA, run_state_stream, sheet_upsert_stream

@query("stream_run_state", compose("SELECT job_id, name, type, model, status, iterations, tokens, secs, message FROM runs", "runs"))
def q_stream_run_state(spark, sf):
    root = io_root(spark, "attempt-stream")
    att = load_attempts(spark, sf, first=R.MAX_ITERATIONS).select(*[c.split()[0] for c in ATTEMPT_SCHEMA.split(", ")])
    # several files, rows spread without regard to order: attempts of a job arrive out of order
    att.repartition(F.xxhash64("job_id", "attempt_no")).write.parquet(root + "/feed")
    return run_state_stream(spark, root + "/feed", root + "/state")


@query("stream_sheet_upsert", compose("SELECT * FROM sheet_all", "sheet_all"))
def q_stream_sheet_upsert(spark, sf):
    root = io_root(spark, "run-stream")
    runs = R.run_rollup(load_attempts(spark, sf, first=R.MAX_ITERATIONS))
    runs.repartition("job_id").write.parquet(root + "/feed")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema.fields)
    return sheet_upsert_stream(spark, root + "/feed", root + "/sheet", schema)
