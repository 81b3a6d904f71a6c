"""Registered run-log queries over D-ATTEMPT / D-SHEET / D-ARTIFACT."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartlake.operators import runs as R
from chartlake.plans.registry import query
from chartlake.plans.sql import compose, cte
from chartlake.sources.derived import ERROR_MESSAGE, MODELS, artifacts, load_attempts

SINCE = "2024-01-15 00:00:00"
MODEL_LIST = "[" + ", ".join(f"'{m}'" for m in MODELS) + "]"

cte("att", ["ev"], f"""
SELECT CAST(user_id AS VARCHAR) || '/' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS job_id,
       'chart_' || CAST(user_id AS VARCHAR) AS name,
       'w' || strftime(date_trunc('week', ts), '%Y%m%d') AS type,
       {MODEL_LIST}[user_id % 5 + 1] AS model,
       CAST(row_number() OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id) AS INTEGER) AS attempt_no,
       (event_type = 'purchase' AND k >= 50) AS ok,
       (event_type = 'error' AND k < 30) AS error,
       CASE WHEN k % 10 <> 0 THEN CAST(k * 10 AS BIGINT) END AS tokens,
       value AS secs, ts, event_id
FROM ev""")
cte("runs0", ["att"], """
SELECT job_id, name, type, model,
       min(CASE WHEN ok OR error THEN attempt_no END) AS t, count(*) AS n,
       bool_or(ok AND attempt_no = 0) AS dummy
FROM att WHERE attempt_no <= 10 GROUP BY job_id, name, type, model""")
cte("runs1", ["runs0", "att"], """
SELECT r.job_id, r.name, r.type, r.model, r.t, r.n,
       CASE WHEN r.t IS NOT NULL AND a.ok THEN 'success' WHEN r.t IS NOT NULL THEN 'error'
            WHEN r.n >= 10 THEN 'timeout' ELSE 'open' END AS status
FROM runs0 r LEFT JOIN att a ON a.job_id = r.job_id AND a.attempt_no = r.t""")
cte("runs", ["runs1", "att"], f"""
SELECT r.job_id, r.name, r.type, r.model, r.status,
       CAST(CASE WHEN r.status IN ('success', 'error') THEN r.t ELSE r.n END AS INTEGER) AS iterations,
       CAST(coalesce(sum(a.tokens), 0) AS BIGINT) AS tokens,
       round(coalesce(sum(a.secs), 0.0), 2) AS secs,
       CASE WHEN r.status = 'error' THEN 'ERROR: {ERROR_MESSAGE[:100]}' END AS message
FROM runs1 r LEFT JOIN att a ON a.job_id = r.job_id
 AND a.attempt_no <= CASE WHEN r.status = 'success' THEN r.t - 1 WHEN r.status = 'error' THEN r.t ELSE r.n END
GROUP BY r.job_id, r.name, r.type, r.model, r.status, r.t, r.n""")
cte("run_cells", ["runs"], f"""
SELECT name, type, model,
       CASE WHEN status = 'success' THEN CAST(iterations AS VARCHAR) WHEN status = 'timeout' THEN 'Timeout'
            ELSE 'ERROR: {ERROR_MESSAGE}' END AS iter,
       CAST(tokens AS DOUBLE) AS tokens, secs AS time, job_id
FROM runs WHERE status <> 'open'""")


def _pivot_sql(src: str) -> str:
    cols = []
    for kind in ("iter", "tokens", "time"):
        for m in MODELS:
            cols.append(f"max(CASE WHEN model = '{m}' THEN {kind} END) AS {m}_{kind}")
    return f'SELECT name AS "Benchmark Name", type AS "Type", ' + ", ".join(cols) + f" FROM {src} GROUP BY name, type"


cte("sheet_all", ["run_cells"], _pivot_sql("run_cells"))
cte("sheet_a", ["run_cells"], _pivot_sql("(SELECT * FROM run_cells WHERE week(strptime(substr(type, 2), '%Y%m%d')) % 2 = 0)"))
cte("sheet_b", ["run_cells"], _pivot_sql("(SELECT * FROM run_cells WHERE week(strptime(substr(type, 2), '%Y%m%d')) % 2 = 1)"))
cte("sheet_even_users", ["run_cells"], _pivot_sql(
    "(SELECT * FROM run_cells WHERE CAST(substr(name, 7) AS BIGINT) % 2 = 0)"))


def _long_sql(sheet: str, source: str) -> str:
    parts = []
    for m in MODELS:
        parts.append(f"""SELECT "Benchmark Name" AS name, "Type" AS type, '{m}' AS model,
  TRY_CAST(trim(CAST({m}_iter AS VARCHAR)) AS DOUBLE) AS iteration,
  coalesce(TRY_CAST({m}_time AS DOUBLE), 0.0) AS time,
  coalesce(TRY_CAST({m}_tokens AS DOUBLE), 0.0) AS tokens,
  coalesce(TRY_CAST({m}_tokens AS DOUBLE), 0.0) / 1000000 * 5.0 AS cost,
  '{source}' AS source
FROM {sheet} WHERE TRY_CAST(trim(CAST({m}_iter AS VARCHAR)) AS DOUBLE) IS NOT NULL""")
    return "\nUNION ALL\n".join(parts)


cte("sheet_long", ["sheet_a", "sheet_b"], _long_sql("sheet_a", "batch_report_a.csv") + "\nUNION ALL\n" +
    _long_sql("sheet_b", "batch_report_b.csv"))


# ---- Spark side --------------------------------------------------------------------
def _parity(col_type):
    return F.weekofyear(F.to_date(F.substring(col_type, 2, 8), "yyyyMMdd")) % 2


def _runs(spark, sf):
    return R.run_rollup(load_attempts(spark, sf, first=R.MAX_ITERATIONS))


def _sheets(spark, sf):
    runs = _runs(spark, sf).persist()
    a = R.long_to_sheet(runs.filter(_parity(F.col("type")) == 0))
    b = R.long_to_sheet(runs.filter(_parity(F.col("type")) == 1))
    return runs, a, b


def _long(spark, sf):
    _, a, b = _sheets(spark, sf)
    return R.sheet_to_long(a.withColumn("source", F.lit("batch_report_a.csv"))).unionByName(
        R.sheet_to_long(b.withColumn("source", F.lit("batch_report_b.csv"))))


@query("attempt_log", compose("""
SELECT job_id, name, type, model, attempt_no, ok, error, tokens, round(secs, 6) AS secs FROM att""", "att"))
def q_attempt_log(spark, sf):
    a = load_attempts(spark, sf)
    return a.select("job_id", "name", "type", "model", "attempt_no", "ok", "error", "tokens", F.round("secs", 6).alias("secs"))


@query("run_rollup", compose("SELECT job_id, name, type, model, status, iterations, tokens, secs, message FROM runs", "runs"))
def q_run_rollup(spark, sf):
    return _runs(spark, sf)


@query("long_to_sheet", compose("SELECT * FROM sheet_all", "sheet_all"))
def q_long_to_sheet(spark, sf):
    return R.long_to_sheet(_runs(spark, sf))


@query("sheet_upsert", compose(
    'SELECT coalesce(n."Benchmark Name", o."Benchmark Name") AS "Benchmark Name", coalesce(n."Type", o."Type") AS "Type", '
    + ", ".join(f"coalesce(n.{m}_{k}, o.{m}_{k}) AS {m}_{k}" for k in ("iter", "tokens", "time") for m in MODELS)
    + ' FROM sheet_a o FULL OUTER JOIN sheet_even_users n ON n."Benchmark Name" = o."Benchmark Name" AND n."Type" = o."Type"',
    "sheet_a", "sheet_even_users"))
def q_sheet_upsert(spark, sf):
    runs, a, _ = _sheets(spark, sf)
    new = R.long_to_sheet(runs.filter(F.substring("name", 7, 20).cast("bigint") % 2 == 0))
    return R.sheet_upsert(a, new)


@query("sheet_lookup", compose("""
SELECT n."Benchmark Name", n."Type", EXISTS (SELECT 1 FROM sheet_a o WHERE o."Benchmark Name" = n."Benchmark Name"
   AND o."Type" = n."Type") AS found FROM sheet_even_users n""", "sheet_a", "sheet_even_users"))
def q_sheet_lookup(spark, sf):
    runs, a, _ = _sheets(spark, sf)
    new = R.long_to_sheet(runs.filter(F.substring("name", 7, 20).cast("bigint") % 2 == 0))
    return R.sheet_lookup(a, new)


@query("append_rows", compose("""
SELECT *, 'batch_report_a.csv' AS source FROM sheet_a UNION ALL SELECT *, 'batch_report_b.csv' FROM sheet_b""",
                              "sheet_a", "sheet_b"))
def q_append_rows(spark, sf):
    _, a, b = _sheets(spark, sf)
    return R.append_rows(a.withColumn("source", F.lit("batch_report_a.csv")), b.withColumn("source", F.lit("batch_report_b.csv")))


@query("sheet_to_long", compose("SELECT name, type, model, iteration, time, tokens, round(cost, 9) AS cost, source FROM sheet_long",
                                "sheet_long"))
def q_sheet_to_long(spark, sf):
    return _long(spark, sf).withColumn("cost", F.round("cost", 9))


@query("kpi_means", compose("""
SELECT round(avg(time), 6) AS mean_time, round(avg(tokens), 6) AS mean_tokens, count(*) AS total_runs FROM sheet_long""",
                            "sheet_long"))
def q_kpi_means(spark, sf):
    k = R.kpi_means(_long(spark, sf))
    return k.select(F.round("mean_time", 6).alias("mean_time"), F.round("mean_tokens", 6).alias("mean_tokens"), "total_runs")


@query("model_usage", compose("SELECT model, count(*) AS n FROM sheet_long GROUP BY model", "sheet_long"))
def q_model_usage(spark, sf):
    return R.model_usage(_long(spark, sf))


@query("positive_time_rows", compose("SELECT name, type, model, iteration, time, tokens FROM sheet_long WHERE time > 0",
                                     "sheet_long"))
def q_positive_time_rows(spark, sf):
    return R.positive_time_rows(_long(spark, sf)).select("name", "type", "model", "iteration", "time", "tokens")


@query("token_sheet_accumulate", compose(
    "SELECT name AS \"Name\", " + ", ".join(
        f"CAST(coalesce(sum(CASE WHEN model = '{m}' THEN tokens END), 0) AS BIGINT) AS {m}" for m in MODELS)
    + " FROM runs GROUP BY name", "runs"))
def q_token_sheet_accumulate(spark, sf):
    runs = _runs(spark, sf).persist()
    par = _parity(F.col("type"))
    old = R.token_sheet(runs.filter(par == 0))
    return R.token_sheet_accumulate(old, runs.filter(par == 1).select("name", "model", "tokens"))


# ---- artifacts ---------------------------------------------------------------------
cte("art", ["att"], """
SELECT 'outputs/' || model || '/' || CASE WHEN ok THEN 'success' ELSE 'failed' END || '/' || file AS path, file, ext, model,
       CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, ts AS mtime, attempt_no
FROM (SELECT *, name || '_' || type || CASE WHEN attempt_no - 1 > 0 THEN '_' || CAST(attempt_no - 1 AS VARCHAR) ELSE '' END
                || '.' || ['txt', 'html', 'json'][event_id % 3 + 1] AS file,
             ['txt', 'html', 'json'][event_id % 3 + 1] AS ext FROM att)""")
cte("jobs", ["art"], f"""
SELECT regexp_replace(file, '_[0-9]+([.][a-z]+)$', '\\1') AS job, bool_or(status = 'success') AS succeeded
FROM art WHERE status IN ('success', 'failed') AND ext IN ('txt', 'json') AND mtime >= TIMESTAMP '{SINCE}'
GROUP BY 1""")


def _art(spark, sf):
    return artifacts(load_attempts(spark, sf))


@query("scan_artifacts_since", compose(f"""
SELECT path, file, ext, model, status, strftime(mtime, '%Y-%m-%d %H:%M:%S') AS mtime FROM art WHERE mtime >= TIMESTAMP '{SINCE}'""",
                                       "art"))
def q_scan_artifacts_since(spark, sf):
    a = _art(spark, sf)
    return a.filter(F.col("mtime") >= F.lit(SINCE).cast(a.schema["mtime"].dataType)).select(
        "path", "file", "ext", "model", "status", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss").alias("mtime"))


@query("artifact_name", compose("SELECT path, file FROM art", "art"))
def q_artifact_name(spark, sf):
    a = load_attempts(spark, sf)
    ext = F.element_at(F.array(*[F.lit(e) for e in ("txt", "html", "json")]), (F.col("event_id") % 3 + 1).cast("int"))
    f = R.artifact_name(F.concat_ws("_", "name", "type"), F.col("attempt_no") - 1, ext)
    status = F.when(F.col("ok"), "success").otherwise("failed")
    return a.select(F.concat_ws("/", F.lit("outputs"), "model", status, f).alias("path"), f.alias("file"))


@query("job_base_name", compose("SELECT file, regexp_replace(file, '_[0-9]+([.][a-z]+)$', '\\1') AS base FROM art", "art"))
def q_job_base_name(spark, sf):
    return _art(spark, sf).select("file", R.job_base_name(F.col("file")).alias("base"))


@query("is_artifact", compose("""
SELECT path FROM art WHERE status IN ('success', 'failed') AND ext IN ('txt', 'json')""", "art"))
def q_is_artifact(spark, sf):
    return _art(spark, sf).filter(R.is_artifact(F.col("status"), F.col("ext"))).select("path")


@query("job_success_rate", compose("""
SELECT count(*) AS total_jobs, count(*) FILTER (WHERE succeeded) AS successful_jobs,
       round(coalesce(avg(CASE WHEN succeeded THEN 1.0 ELSE 0.0 END) * 100.0, 0.0), 6) AS success_rate FROM jobs""", "jobs"))
def q_job_success_rate(spark, sf):
    r = R.job_success_rate(_art(spark, sf), SINCE)
    return r.select("total_jobs", "successful_jobs", F.round("success_rate", 6).alias("success_rate"))


@query("truly_failed", compose("SELECT job FROM jobs WHERE NOT succeeded", "jobs"))
def q_truly_failed(spark, sf):
    return R.truly_failed(_art(spark, sf), SINCE)


@query("latest_artifact_per_run", compose("""
SELECT status, model, base,
       arg_min(CASE WHEN ext = 'html' THEN path END, CASE WHEN ext = 'html' THEN (mtime, path) END) AS html_path,
       arg_min(CASE WHEN ext = 'txt' THEN path END, CASE WHEN ext = 'txt' THEN (mtime, path) END) AS txt_path
FROM (SELECT *, left(file, length(file) - length(ext) - 1) AS base FROM art)
GROUP BY status, model, base""", "art"))
def q_latest_artifact_per_run(spark, sf):
    return R.latest_artifact_per_run(_art(spark, sf))
