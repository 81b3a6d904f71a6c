"""Verify-and-repair run logs: attempts -> runs -> results sheets -> dashboard figures
(A1-A4, U1, U2, W5, W8, J6, J8, J10, P4, P7, P8, R3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartlake.sources.derived import MODELS

MAX_ITERATIONS = 10
COST_PER_MTOKEN = 5.0


# A4 ------------------------------------------------------------------------------
def run_rollup(att: DataFrame, cap: int = MAX_ITERATIONS) -> DataFrame:
    """Fold attempts into runs: success at the first passing verification (that attempt adds
    no tokens / seconds), error at the first failed repair (its tokens / seconds count),
    timeout after ``cap`` attempts, ``open`` when fewer than ``cap`` attempts and no
    terminal one. Only the first ``cap`` attempts of a job are read."""
    a = att.filter(F.col("attempt_no") <= cap)
    text = F.col("message") if "message" in att.columns else F.lit(None).cast("string")
    term = F.when(F.col("ok") | F.col("error"), F.col("attempt_no"))
    g = a.groupBy("job_id", "name", "type", "model").agg(
        F.min(term).alias("_t"),
        F.count(F.lit(1)).alias("_n"),
        F.array_sort(F.collect_list(F.struct("attempt_no", "ok", "error", "tokens", "secs"))).alias("_a"),
        # the error text of the first failed attempt, as the attempt told it
        F.min(F.when(F.col("error"), F.struct("attempt_no", text.alias("text")))).alias("_e"),
    )
    t = F.col("_t")
    first_ok = F.exists("_a", lambda x: (x["attempt_no"] == t) & x["ok"])
    status = (
        F.when(t.isNotNull() & first_ok, "success")
        .when(t.isNotNull(), "error")
        .when(F.col("_n") >= cap, "timeout")
        .otherwise("open")
    )
    g = g.withColumn("status", status)
    last = (
        F.when(F.col("status") == "success", t - 1)
        .when(F.col("status") == "error", t)
        .otherwise(F.col("_n"))
    )
    used = F.filter("_a", lambda x: x["attempt_no"] <= last)
    tokens = F.aggregate(used, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x["tokens"], F.lit(0).cast("bigint")))
    secs = F.aggregate(used, F.lit(0.0).cast("double"), lambda s, x: s + F.coalesce(x["secs"], F.lit(0.0)))
    iters = F.when(F.col("status").isin("success", "error"), t).otherwise(F.col("_n"))
    return g.select(
        "job_id", "name", "type", "model", "status",
        iters.cast("int").alias("iterations"),
        tokens.alias("tokens"),
        F.round(secs, 2).alias("secs"),
        F.when(F.col("status") == "error", F.concat(F.lit("ERROR: "), F.substring(F.coalesce("_e.text", F.lit("")), 1, 100))).alias("message"),
    )


def iter_cell(status: str = "status") -> F.Column:
    """Sheet text of a run: iteration number, ``Timeout`` or ``ERROR: <message>``."""
    return (
        F.when(F.col(status) == "success", F.col("iterations").cast("string"))
        .when(F.col(status) == "timeout", F.lit("Timeout"))
        .when(F.col(status) == "error", F.substring("message", 1, 107))
    )


# U2 ------------------------------------------------------------------------------
def long_to_sheet(runs: DataFrame, models: list[str] = MODELS) -> DataFrame:
    """Finished runs to the wide sheet ``Benchmark Name, Type, <M>_iter, <M>_tokens, <M>_time``."""
    r = runs.filter(F.col("status") != "open").select(
        F.col("name").alias("Benchmark Name"), F.col("type").alias("Type"), "model",
        iter_cell().alias("iter"), F.col("tokens").cast("double").alias("tokens"), F.col("secs").alias("time"), F.col("job_id").alias("_job"),
    )
    # of several runs of one cell the one of the latest job counts
    last = lambda c: F.max_by(c, F.struct("_job", "iter", "tokens", "time")).alias(c)
    p = r.groupBy("Benchmark Name", "Type").pivot("model", models).agg(last("iter"), last("tokens"), last("time"))
    cols = ["Benchmark Name", "Type"]
    for kind in ("iter", "tokens", "time"):
        cols += [F.col(f"{m}_{kind}").alias(f"{m}_{kind}") for m in models]
    return p.select(*cols)


# W5 / J6 ---------------------------------------------------------------------------
def sheet_upsert(old: DataFrame, new: DataFrame, models: list[str] = MODELS) -> DataFrame:
    """Update-or-insert by (Benchmark Name, Type): a cell of ``new`` replaces the old cell
    when present; rows only in ``new`` are appended; columns of either sheet stay."""
    key = ["Benchmark Name", "Type"]
    o = old.select(*key, *[F.col(c).alias(f"__o_{c}") for c in old.columns if c not in key])
    n = new.select(*key, *[F.col(c).alias(f"__n_{c}") for c in new.columns if c not in key])
    j = o.join(n, key, "full")
    vals = list(dict.fromkeys(c for c in [*new.columns, *old.columns] if c not in key))
    cell = lambda c: [F.col(f"__{k}_{c}") for k, d in (("n", new), ("o", old)) if c in d.columns]
    return j.select(*key, *[F.coalesce(*cell(c)).alias(c) for c in vals])


def sheet_lookup(old: DataFrame, new: DataFrame) -> DataFrame:
    key = ["Benchmark Name", "Type"]
    hit = old.select(*key).distinct().withColumn("found", F.lit(True))
    return new.select(*key).distinct().join(hit, key, "left").select(*key, F.coalesce("found", F.lit(False)).alias("found"))


# U1 ------------------------------------------------------------------------------
def sheet_to_long(sheet: DataFrame, models: list[str] = MODELS) -> DataFrame:
    """Wide sheet to ``(name, type, model, iteration, time, tokens, cost, source)``; only
    numeric iteration cells survive (Timeout / ERROR rows drop out); blank time / tokens -> 0."""
    src = F.col("source") if "source" in sheet.columns else F.lit("unknown")
    st = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"{m}_iter").cast("string").alias("it"),
                 F.col(f"{m}_time").cast("string").alias("tm"), F.col(f"{m}_tokens").cast("string").alias("tk"))
        for m in models
    ]))
    x = sheet.select(F.col("Benchmark Name").alias("name"), F.col("Type").alias("type"), src.alias("source"), st.alias("s"))
    it = F.expr("try_cast(trim(s.it) as double)")
    tm = F.coalesce(F.expr("try_cast(s.tm as double)"), F.lit(0.0))
    tk = F.coalesce(F.expr("try_cast(s.tk as double)"), F.lit(0.0))
    return x.filter(it.isNotNull()).select(
        "name", "type", F.col("s.model").alias("model"), it.alias("iteration"), tm.alias("time"), tk.alias("tokens"),
        (tk / 1_000_000 * COST_PER_MTOKEN).alias("cost"), "source",
    )


# A2 / A3 / P8 --------------------------------------------------------------------------
def kpi_means(long: DataFrame) -> DataFrame:
    return long.agg(
        F.avg("time").alias("mean_time"), F.avg("tokens").alias("mean_tokens"), F.count(F.lit(1)).alias("total_runs")
    )


def model_usage(long: DataFrame) -> DataFrame:
    return long.groupBy("model").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "model")


def positive_time_rows(long: DataFrame) -> DataFrame:
    return long.filter(F.col("time") > 0)


# W8 ------------------------------------------------------------------------------
def token_sheet_accumulate(old: DataFrame, usages: DataFrame, models: list[str] = MODELS) -> DataFrame:
    """Add new token counts to each (name, model) cell; unseen names start at zero."""
    o = old.select("Name", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).cast("bigint").alias("tokens")) for m in models
    ])).alias("s")).select("Name", "s.model", "s.tokens")
    u = usages.select(F.col("name").alias("Name"), "model", F.col("tokens").cast("bigint"))
    tot = o.unionByName(u).groupBy("Name").pivot("model", models).agg(F.sum("tokens"))
    return tot.select("Name", *[F.coalesce(F.col(m), F.lit(0)).cast("bigint").alias(m) for m in models])


def token_sheet(runs: DataFrame, models: list[str] = MODELS) -> DataFrame:
    return token_sheet_accumulate(
        runs.sparkSession.createDataFrame([], "Name string, " + ", ".join(f"{m} bigint" for m in models)),
        runs.select("name", "model", "tokens"), models,
    )


# J10 -----------------------------------------------------------------------------
def append_rows(*sheets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)


# P4 / P7 / W7 ----------------------------------------------------------------------
JOB_SUFFIX = r"_\d+(\.[a-z]+)$"


def job_base_name(file: F.Column) -> F.Column:
    return F.regexp_replace(file, JOB_SUFFIX, "$1")


def is_artifact(status: F.Column, ext: F.Column) -> F.Column:
    return status.isin("success", "failed") & ext.isin("txt", "json")


def artifact_name(base: F.Column, iteration: F.Column, ext: F.Column) -> F.Column:
    """``base[_iter].ext`` with the suffix only when iteration > 0."""
    return F.concat(base, F.when(iteration > 0, F.concat(F.lit("_"), iteration.cast("string"))).otherwise(F.lit("")),
                    F.lit("."), ext)


# A1 / J8 ---------------------------------------------------------------------------
def job_outcomes(art: DataFrame, since=None) -> DataFrame:
    """Per job base name: succeeded if any artifact of it is in a success folder."""
    a = art.filter(is_artifact(F.col("status"), F.col("ext")))
    if since is not None:
        a = a.filter(F.col("mtime") >= F.lit(since).cast(art.schema["mtime"].dataType))
    return a.groupBy(job_base_name(F.col("file")).alias("job")).agg(
        F.bool_or(F.col("status") == "success").alias("succeeded")
    )


def job_success_rate(art: DataFrame, since=None) -> DataFrame:
    j = job_outcomes(art, since)
    return j.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if("succeeded").alias("successful_jobs"),
        F.coalesce(F.avg(F.col("succeeded").cast("double")) * 100.0, F.lit(0.0)).alias("success_rate"),
    )


def truly_failed(art: DataFrame, since=None) -> DataFrame:
    return job_outcomes(art, since).filter(~F.col("succeeded")).select("job")


# R3 ------------------------------------------------------------------------------
def latest_artifact_per_run(art: DataFrame, policy: str = "compat") -> DataFrame:
    """Per (status, model, file stem): one html and one txt path; every iteration of a job is a run of its own. ``compat`` keeps the oldest file
    (what the upstream loop ends with), ``latest`` the newest."""
    pick = F.min_by if policy == "compat" else F.max_by
    a = art.withColumn("base", F.regexp_replace("file", r"\.[^.]*$", ""))
    order = F.struct("mtime", "path")
    return a.groupBy("status", "model", "base").agg(
        pick(F.when(F.col("ext") == "html", F.col("path")), F.when(F.col("ext") == "html", order)).alias("html_path"),
        pick(F.when(F.col("ext") == "txt", F.col("path")), F.when(F.col("ext") == "txt", order)).alias("txt_path"),
    )
