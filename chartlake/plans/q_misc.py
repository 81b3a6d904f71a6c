"""Registered queries for model configuration (S8, P6), result sheets read from CSV (S9),
repair prompts and the repair batch hook (X10, F2) and the chart type check (P2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartlake.charts import nest
from chartlake.operators import containment as ct
from chartlake.operators import repair as RP
from chartlake.operators import runs as R
from chartlake.operators.typecheck import type_check
from chartlake.plans import q_runs  # noqa: F401  (sheet CTEs)
from chartlake.plans.registry import query
from chartlake.plans.sql import compose, cte
from chartlake.sinks.text import io_root
from chartlake.sources import config as CF
from chartlake.sources.derived import _k, day_week_pairs, load_event_charts
from chartlake.session import table

# ---- S8 / P6 -------------------------------------------------------------------------------
NAMES6 = ["gpt4o", "Gemini", "LLaMA", "claude", "PERPLEXITY", "grok"]


def config_records(events):
    """Config entries derived from events (some incomplete, some with blank keys)."""
    k = _k(F.col("props"))
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES6]), (F.col("event_id") % 6 + 1).cast("int"))
    rec = F.struct(
        F.col("event_id").alias("entry_id"), name.alias("llm_name"),
        F.when(F.col("event_type") != "error", F.concat(F.col("event_type"), F.lit("-"), F.col("user_id").cast("string"))).alias("model_name"),
        F.when(k % 7 == 0, F.lit("")).when(k % 11 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("key-"), F.col("event_id").cast("string"))).alias("api_key"),
        F.when(k >= 50, k * 20).alias("max_tokens"),
        F.when(F.col("event_type") == "click", F.col("value") / 100).alias("temperature"),
    )
    return events.select(F.to_json(rec).alias("value"))


def _config(spark, sf):
    root = io_root(spark, "model-config")
    config_records(table(spark, sf, "events")).write.text(root)
    return CF.read_model_config(spark, root)


cte("cfg", ["ev"], """
SELECT event_id AS entry_id, ['gpt4o', 'Gemini', 'LLaMA', 'claude', 'PERPLEXITY', 'grok'][event_id % 6 + 1] AS llm_name,
       event_type || '-' || CAST(user_id AS VARCHAR) AS model_name,
       CASE WHEN k % 7 = 0 THEN '' ELSE 'key-' || CAST(event_id AS VARCHAR) END AS api_key,
       CAST(coalesce(CASE WHEN k >= 50 THEN k * 20 END, 1000) AS INTEGER) AS max_tokens, 3 AS max_retries,
       CAST(coalesce(CASE WHEN event_type = 'click' THEN value / 100 END, 0.0) AS DOUBLE) AS temperature,
       CAST(1.0 AS DOUBLE) AS top_p, 0 AS top_k, 1 AS n, CAST(NULL AS VARCHAR) AS stop
FROM ev WHERE event_type <> 'error' AND NOT (k % 11 = 0 AND k % 7 <> 0)""")


@query("scan_model_config", compose("SELECT * FROM cfg", "cfg"))
def q_scan_model_config(spark, sf):
    return _config(spark, sf)


@query("select_models", compose("""
SELECT CAST(list_position(['gpt4o', 'gemini', 'llama', 'claude', 'perplexity'], name) - 1 AS INTEGER) AS req_ord, name,
       c.entry_id, c.llm_name, c.model_name, c.api_key, c.max_tokens, c.max_retries, c.temperature, c.top_p, c.top_k, c.n, c.stop
FROM (SELECT lower(llm_name) AS name, arg_max(cfg, entry_id) AS c FROM cfg GROUP BY lower(llm_name))
WHERE name IN ('gpt4o', 'gemini', 'llama', 'claude', 'perplexity') AND trim(c.api_key) <> ''""", "cfg"))
def q_select_models(spark, sf):
    return CF.select_models(_config(spark, sf), ["all"])


# ---- S9 -------------------------------------------------------------------------------------
@query("scan_result_sheets", compose(
    "SELECT name, type, model, iteration, time, tokens, round(cost, 9) AS cost, source FROM sheet_long", "sheet_long"))
def q_scan_result_sheets(spark, sf):
    _, a, b = q_runs._sheets(spark, sf)
    root = io_root(spark, "sheets")
    a.write.option("header", "true").csv(root + "/batch_report_a.csv")
    b.write.option("header", "true").csv(root + "/batch_report_b.csv")
    sheets = CF.read_result_sheets(spark, root)
    return R.sheet_to_long(sheets).withColumn("cost", F.round("cost", 9))


# ---- X10 / F2 -------------------------------------------------------------------------------
cte("code_of", ["ch_steps", "ch_trans"], """
SELECT s.model_id,
       (SELECT string_agg('{' || x.name || ': ' || x.function || '}', ', ' ORDER BY x.ord) FROM ch_steps x WHERE x.model_id = s.model_id) AS s_txt,
       coalesce((SELECT string_agg(t.src || ' > ' || t.tgt || ' [' || t.guard || ']', ', ' ORDER BY t.t_idx) FROM ch_trans t
                 WHERE t.model_id = s.model_id), '') AS t_txt
FROM (SELECT DISTINCT model_id FROM ch_steps) s""")
cte("prompts", ["c_p1", "c_match", "g_sem", "d_pair", "code_of"], f"""
SELECT d.pair_id,
       replace(replace(replace({"'" + RP.DEFAULT_TEMPLATE.replace("'", "''") + "'"}, '{{non_equiv_paths_str}}', u.tbl),
               '{{sfc1_code}}', 'steps1 = [' || c1.s_txt || ']' || chr(10) || 'transitions1 = [' || c1.t_txt || ']'),
               '{{sfc2_code}}', 'steps2 = [' || c2.s_txt || ']' || chr(10) || 'transitions2 = [' || c2.t_txt || ']') AS prompt
FROM (SELECT a.pair_id, 'From' || chr(9) || 'To' || chr(9) || 'Transitions' || chr(9) || 'Condition' || chr(9) || 'Data Transformation'
             || chr(10) || string_agg(s.from_place || chr(9) || s.to_place || chr(9) || split_part(a.path_key, '>', 1) || chr(9)
             || a.cond_key || chr(9) || a.xform_key, chr(10) ORDER BY a.path_key) AS tbl
      FROM c_p1 a JOIN d_pair p ON p.pair_id = a.pair_id JOIN g_sem s ON s.model_id = p.model1 AND s.path_key = a.path_key
      WHERE NOT EXISTS (SELECT 1 FROM c_match m WHERE m.pair_id = a.pair_id AND m.path_key = a.path_key)
      GROUP BY a.pair_id) u
JOIN d_pair d ON d.pair_id = u.pair_id
JOIN code_of c1 ON c1.model_id = d.model1 JOIN code_of c2 ON c2.model_id = d.model2""")


def _prompts(spark, sf):
    c, idx = load_event_charts(spark, sf)
    idx = idx.persist()
    c = c.persist()
    pairs = day_week_pairs(idx)
    p1, p2 = ct.pair_paths(c, pairs, expand=False)
    un = ct.path_unmatched(p1, ct.path_match(p1, p2)).drop("model2", "common_vars")
    return RP.repair_prompts(c, pairs, un)


@query("render_prompt", compose("SELECT pair_id, prompt FROM prompts", "prompts"))
def q_render_prompt(spark, sf):
    return _prompts(spark, sf)


@query("repair_batch")
def q_repair_batch(spark, sf):
    return RP.repair_batch(_prompts(spark, sf), RP.echo_improve)


# ---- P2 ----------------------------------------------------------------------------------------
@query("type_check", compose("""
SELECT model_id, true AS steps_ok, true AS transitions_ok, true AS variables_ok, true AS initial_ok, true AS ok FROM ch_meta""",
                             "ch_meta"))
def q_type_check(spark, sf):
    c, _ = load_event_charts(spark, sf)
    return type_check(nest(c))


# ---- F1 -------------------------------------------------------------------------------------
@query("rule_tables", r"""
WITH b AS (SELECT regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
rules AS (
  SELECT DISTINCT term, 'word' AS category, 1.0 AS weight FROM (SELECT unnest(w) AS term FROM b) WHERE length(term) >= 6
  UNION ALL
  SELECT DISTINCT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 'phrase', 3.0 FROM b, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT doc_id, unnest(w) AS term FROM d
  UNION ALL
  SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
hits AS (SELECT doc_id, category, term, count(*) AS n, max(weight) AS weight FROM runs JOIN rules USING (term) GROUP BY ALL)
SELECT doc_id, category, count(*) AS n_terms, CAST(sum(n) AS BIGINT) AS n_hits, CAST(sum(weight * n) AS DOUBLE) AS score
FROM hits GROUP BY doc_id, category""")
def q_rule_tables(spark, sf):
    """Rules derived from the benchmark texts (long words, and runs of three words), over all documents."""
    from chartlake.operators.rules import WORD, rule_scores
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 0)
    b = table(spark, sf, "benchmark").select(w.alias("w"))
    words = b.select(F.explode("w").alias("term")).filter(F.length("term") >= 6).select("term", F.lit("word").alias("category"), F.lit(1.0).alias("weight"))
    three = b.filter(F.size("w") >= 3).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))).alias("term"))
    return rule_scores(table(spark, sf, "documents"), words.unionByName(three.select("term", F.lit("phrase").alias("category"), F.lit(3.0).alias("weight"))))
