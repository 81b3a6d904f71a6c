"""Derived inputs (FIXTURES.md part B), built by Spark from the shared tables so that
every operator's work grows with the data.

D-CHART: one chart per (user, day) and per (user, week) from ``events``; steps are event
types, transitions link each event to the next one of the same chart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartlake.charts import Charts
from chartlake.session import table

# Fixed values of the derived-chart rule (FIXTURES.md, D-CHART).
CHART_VARIABLES = ["k", "acc", "last"]
GUARD_SPLIT = 50
# Sort bucket of the next-event link: a hot user's day chart is sorted in 24 parallel pieces,
# a week chart in 168 (finer units spread further at the price of a larger bucket summary).
NEXT_BUCKET = "hour"


def _k(props):
    return F.get_json_object(props, "$.k").cast("int")


def chart_events(events: DataFrame, periods: tuple[str, ...] = ("day", "week")) -> DataFrame:
    """Events tagged with the chart of each of the given periods they belong to."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "value", _k(F.col("props")).alias("k"))
    return in_periods(ev, periods)


def in_periods(ev: DataFrame, periods: tuple[str, ...]) -> DataFrame:
    """Rows once for each of the given periods, with ``period``, ``period_start`` and ``model_id``."""
    per = F.explode(F.array(*[
        F.struct(F.lit(p).alias("period"), F.date_trunc(p, "ts").alias("period_start")) for p in periods]))
    ev = ev.select("*", per.alias("_p")).select(
        *ev.columns, F.col("_p.period").alias("period"), F.col("_p.period_start").alias("period_start"),
    )
    return ev.withColumn(
        "model_id",
        F.concat_ws("/", F.col("user_id").cast("string"), "period", F.date_format("period_start", "yyyy-MM-dd")),
    )


def with_next(df: DataFrame, keys: list[str], order: list[str], payload: list[str], bucket) -> DataFrame:
    """Attach the next row (by ``order``) of the same ``keys`` group as struct ``_next``.

    Skew-safe: the sort happens per (keys, bucket) so a hot key is spread over its
    buckets; the link from the last row of a bucket to the first row of the next
    non-empty bucket goes through a one-row-per-bucket summary.
    """
    o = F.struct(*order)
    b = df.withColumn("_b", bucket).withColumn("_o", o)
    row = F.struct("_o", *payload)
    inb = b.withColumn("_next", F.lead(row).over(Window.partitionBy(*keys, "_b").orderBy("_o")))
    firsts = b.groupBy(*keys, "_b").agg(F.min(row).alias("_first"))
    nb = firsts.withColumn("_nb", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_b"))).select(
        *keys, "_b", "_nb"
    )
    return (
        inb.join(nb, [*keys, "_b"], "left")
        .withColumn("_next", F.coalesce("_next", "_nb"))
        .drop("_nb", "_b", "_o")
    )


def dialect_guard(k, event_type, event_id, nxt):
    """D-CHART-G guard spelling and target by ``event_id % 9``: plain, ``=``, ``<>``, ``&&``,
    ``AND`` with the constant first, ``not``, quoted ``'True'``, a bad ``>>`` operator, and a
    missing guard whose target names an unknown step."""
    v = event_id % 9
    ks = k.cast("string")
    base = F.when(k >= GUARD_SPLIT, F.lit(f"k >= {GUARD_SPLIT}")).otherwise(F.lit(f"k < {GUARD_SPLIT}"))
    guard = (
        F.when(v == 1, F.concat(F.lit("k = "), ks))
        .when(v == 2, F.concat(F.lit("k <> "), ks))
        .when(v == 3, F.concat(F.lit(f"k >= {GUARD_SPLIT} && is_"), event_type))
        .when(v == 4, F.concat(ks, F.lit(" < k AND flag")))
        .when(v == 5, F.concat(F.lit("not k > "), ks))
        .when(v == 6, F.lit("'True'"))
        .when(v == 7, F.lit("x >> 1"))
        .when(v == 8, F.lit(""))
        .otherwise(base)
    )
    tgt = F.when(v == 8, F.concat(F.lit("Unknown_"), nxt)).otherwise(nxt)
    return guard, tgt


def event_charts(events: DataFrame, periods: tuple[str, ...] = ("day", "week"), dialects: bool = False) -> tuple[Charts, DataFrame]:
    """D-CHART as exploded chart tables plus a model index
    ``(model_id, user_id, period, period_start)``; ``dialects=True`` gives D-CHART-G
    (guards in several spellings, some faulty)."""
    ev = chart_events(events, tuple(periods))
    first = F.min(F.struct("ts", "event_id"))
    models = ev.groupBy("model_id", "user_id", "period", "period_start").agg(
        F.min(F.struct("ts", "event_id", "event_type")).alias("_f")
    )
    meta = models.select(
        "model_id",
        F.array(*[F.lit(v) for v in CHART_VARIABLES]).alias("variables"),
        F.col("_f.event_type").alias("initial_step"),
    )
    index = models.select("model_id", "user_id", "period", "period_start")

    st = ev.groupBy("model_id", "event_type").agg(first.alias("_f"))
    steps = st.select(
        "model_id",
        (F.row_number().over(Window.partitionBy("model_id").orderBy("_f")) - 1).alias("ord"),
        F.col("event_type").alias("name"),
        F.concat(F.lit("acc := acc + "), F.length("event_type").cast("string"), F.lit("; last := k")).alias("function"),
    )

    # a chart's events follow each other in its user's events, so each event is linked once, whatever the periods
    own = events.select("event_id", "ts", "user_id", "event_type", _k(F.col("props")).alias("k"),
                        F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("_user"))
    after = in_periods(with_next(own, ["_user"], ["ts", "event_id"], ["event_type"], F.date_trunc(NEXT_BUCKET, "ts")).filter(
        F.col("_next").isNotNull()), tuple(periods))
    linked = after.filter(" or ".join(
        f"(period = '{p}' and date_trunc('{p}', _next._o.ts) <=> period_start)" for p in periods))
    if dialects:
        guard, tgt = dialect_guard(F.col("k"), F.col("event_type"), F.col("event_id"), F.col("_next.event_type"))
    else:
        guard = F.when(F.col("k") >= GUARD_SPLIT, F.lit(f"k >= {GUARD_SPLIT}")).otherwise(F.lit(f"k < {GUARD_SPLIT}"))
        tgt = F.col("_next.event_type")
    tr = linked.select(
        "model_id", "ts", "event_id",
        F.col("event_type").alias("s"), tgt.alias("t"), guard.alias("guard"),
    ).groupBy("model_id", "s", "t", "guard").agg(first.alias("_f"))
    transitions = tr.select(
        "model_id",
        (F.row_number().over(Window.partitionBy("model_id").orderBy("_f")) - 1).alias("t_idx"),
        F.array("s").alias("src"),
        F.array("t").alias("tgt"),
        "guard",
    )
    return Charts(steps, transitions, meta), index


def load_event_charts(spark: SparkSession, sf_dir: str, periods=("day", "week"), dialects: bool = False):
    return event_charts(table(spark, sf_dir, "events"), periods, dialects)


def day_week_pairs(index: DataFrame) -> DataFrame:
    """D-PAIR: model 1 = a user's day chart, model 2 = the same user's chart of the previous week."""
    day = index.filter(F.col("period") == "day").select(
        "user_id", F.col("model_id").alias("model1"),
        F.date_sub(F.date_trunc("week", "period_start").cast("date"), 7).alias("_pw"),
    )
    week = index.filter(F.col("period") == "week").select(
        "user_id", F.col("model_id").alias("model2"), F.col("period_start").cast("date").alias("_pw")
    )
    return day.join(week, ["user_id", "_pw"]).select(F.col("model1").alias("pair_id"), "model1", "model2")


def seq_number(df: DataFrame, keys: list[str], order: list[str], bucket, first: int | None = None) -> DataFrame:
    """1-based position of each row in its ``keys`` group by ``order`` as column ``seq``.

    Skew-safe: rows are ranked inside (keys, bucket) and shifted by the row counts of the
    earlier buckets of the same group (a one-row-per-bucket running sum). With ``first`` only the
    first rows of each group are returned; later rows of a bucket are cut before any join."""
    b = df.withColumn("_b", bucket)
    inb = b.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    cnt = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    off = cnt.withColumn(
        "_off",
        F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select(*keys, "_b", "_off")
    if first is not None:
        inb, off = inb.filter(F.col("_r") <= first), off.filter(F.col("_off") < first)
    out = inb.join(off, [*keys, "_b"]).withColumn("seq", (F.col("_r") + F.col("_off")).cast("int")).drop("_b", "_r", "_off")
    return out if first is None else out.filter(F.col("seq") <= first)


# The five model names of the results sheet, in sheet order.
MODELS = ["GPT4o", "Gemini", "LLaMA", "Claude", "Perplexity"]
EXTS = ["txt", "html", "json"]
ERROR_MESSAGE = "LLM failed to improve code."


def attempts(events: DataFrame, first: int | None = None) -> DataFrame:
    """D-ATTEMPT: one repair-loop attempt per event; job = (user, week). ``first``: only so many attempts of each job.

    A failed attempt carries its own error text in ``message``."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "value", _k(F.col("props")).alias("k"))
    week = F.date_trunc("week", "ts")
    ev = ev.select(
        "*",
        F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format(week, "yyyy-MM-dd")).alias("job_id"),
        F.concat(F.lit("chart_"), F.col("user_id").cast("string")).alias("name"),
        F.concat(F.lit("w"), F.date_format(week, "yyyyMMdd")).alias("type"),
        F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % 5 + 1).cast("int")).alias("model"),
    )
    ev = seq_number(ev, ["job_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"), first)
    return ev.select(
        "job_id", "name", "type", "model", F.col("seq").alias("attempt_no"),
        ((F.col("event_type") == "purchase") & (F.col("k") >= 50)).alias("ok"),
        ((F.col("event_type") == "error") & (F.col("k") < 30)).alias("error"),
        F.when(F.col("k") % 10 != 0, F.col("k") * 10).cast("bigint").alias("tokens"),
        F.col("value").alias("secs"),
        F.when((F.col("event_type") == "error") & (F.col("k") < 30), F.lit(ERROR_MESSAGE)).alias("message"),
        "ts", "event_id",
    )


def load_attempts(spark: SparkSession, sf_dir: str, first: int | None = None) -> DataFrame:
    return attempts(table(spark, sf_dir, "events"), first)


def artifacts(att: DataFrame) -> DataFrame:
    """D-ARTIFACT: one output file per attempt,
    ``outputs/<model>/<success|failed>/<name>_<type>[_<iter>].<ext>``, mtime = attempt time."""
    it = F.col("attempt_no") - 1
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTS]), (F.col("event_id") % 3 + 1).cast("int"))
    base = F.concat_ws("_", "name", "type")
    file = F.concat(base, F.when(it > 0, F.concat(F.lit("_"), it.cast("string"))).otherwise(F.lit("")), F.lit("."), ext)
    status = F.when(F.col("ok"), "success").otherwise("failed")
    return att.select(
        F.concat_ws("/", F.lit("outputs"), "model", status, file).alias("path"),
        file.alias("file"), ext.alias("ext"), "model", status.alias("status"),
        F.col("ts").alias("mtime"), "attempt_no",
    )


# Fixed values of the derived document rule (FIXTURES.md, D-DOCS).
LANG_STRATEGY = {"en": "Cost-Effective", "de": "Sweet Spot", "fr": "Accuracy-Effective", "es": "Semantic-View"}
FILE_KINDS = ["iterative_prompting.txt", "prompt_refiner.txt", "PromptForUpgrade.txt", "PythonCodePrompt.txt", "notes.txt"]


def prompt_docs(documents: DataFrame) -> DataFrame:
    """D-DOCS: documents as prompt files with a strategy (by language), a version
    (original / enhanced by doc id parity), an A/B pair key and a file kind (by source)."""
    strat = F.create_map(*[x for k, v in LANG_STRATEGY.items() for x in (F.lit(k), F.lit(v))])
    kind = F.element_at(F.array(*[F.lit(k) for k in FILE_KINDS]),
                        (F.regexp_extract("source", r"(\d+)", 1).cast("int") % 5 + 1).cast("int"))
    return documents.select(
        "doc_id", (F.col("doc_id") / 2).cast("bigint").alias("pair_key"),
        F.coalesce(strat[F.col("lang")], F.lit("Cost-Effective")).alias("strategy"),
        F.when(F.col("doc_id") % 2 == 0, "original").otherwise("enhanced").alias("version"),
        F.col("source").alias("prompt_type"), kind.alias("file_name"), "text",
    )


def replies(conversations: DataFrame) -> DataFrame:
    """D-RESP: assistant turns wrapped as model replies by ``turn % 5``: fenced python with
    chart lists, bare fence, unfenced ``steps2`` / ``transitions2`` lines, an API error, plain."""
    c = F.col("conv_id").cast("string")
    t = F.col("turn").cast("string")
    r0 = F.concat(
        F.lit('Here is the fix:\n```python\nsteps2 = [{"name": "S'), c, F.lit('", "function": "x := '), t,
        F.lit('"}]\ntransitions2 = [{"src": "S'), c, F.lit('", "tgt": "S'), c, F.lit('", "guard": "x >= '), t,
        F.lit('"}]\n```\n'), F.col("text"))
    r1 = F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```"))
    r2 = F.concat(
        F.lit('steps2 = [\n  {"name": "S'), c, F.lit('", "function": "x := 1"}\n]\ntransitions2 = [{"src": "S'), c,
        F.lit('", "tgt": "T'), t, F.lit('", "guard": "x >= 1"}]\n'), F.col("text"))
    r3 = F.concat(F.lit("Error 403: the api key was rejected for request "), c, F.lit(". "), F.col("text"))
    m = F.col("turn") % 5
    reply = F.when(m == 0, r0).when(m == 1, r1).when(m == 2, r2).when(m == 3, r3).otherwise(F.col("text"))
    return conversations.filter(F.col("role") == "assistant").select("conv_id", "turn", reply.alias("reply"))


def file_lists(part: DataFrame) -> DataFrame:
    """D-FILES: an original and an upgraded file list per folder (``p_brand``); the upgraded
    list only has the parts larger than size 5, so it is shorter in most folders."""
    typ = F.lower(F.split("p_type", " ")[0])
    base = F.regexp_replace("p_name", " ", "_")
    src = part.select(F.col("p_brand").alias("folder"), F.lit("src").alias("side"),
                      F.concat(F.lit("/data/new_benchmarks/"), typ, F.lit("/orig/"), base, F.lit(".txt")).alias("path"))
    mod = part.filter(F.col("p_size") > 5).select(
        F.col("p_brand").alias("folder"), F.lit("mod").alias("side"),
        F.concat(F.lit("/data/new_benchmarks/"), typ, F.lit("/mod/"), base, F.lit("_SFC2.txt")).alias("path"))
    return src.unionByName(mod)
