"""Registered text queries over D-DOCS (documents as prompt files), D-RESP (assistant
turns as model replies) and pages: measures, flags, scorers and their roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartlake.functions import text as X
from chartlake.operators import scoring as S
from chartlake.plans.registry import query
from chartlake.plans.sql import compose, cte
from chartlake.session import table
from chartlake.sources.derived import FILE_KINDS, LANG_STRATEGY, prompt_docs, replies

# Extra lexicon words frequent in the invented-prose documents, so scores vary.
EXTRA_FEATURES = {"examples": ["that"], "requirements": ["with"], "guidelines": ["this"], "error_handling": ["from"],
                  "validation": ["und"], "documentation": ["der"]}
EXTRA_SEMANTIC = ["les"]
EXTRA_PATTERNS = {"examples": ["that"], "instructions": ["with"], "validation": ["this"], "requirements": ["from"],
                  "guidelines": ["und"], "best_practices": ["der"], "error_handling": ["les"], "success_criteria": ["los"],
                  "deliverables": ["die"], "documentation": ["the "]}
EXTRA_TERMS = ["and", "the", "of", "de", "la", "le", "der", "und", "die"]
FEATURES = S.extend(S.FEATURES, EXTRA_FEATURES)
SEMANTIC = S.SEMANTIC_WORDS + EXTRA_SEMANTIC
PATTERNS = S.extend(S.PATTERNS, EXTRA_PATTERNS)
TERMS = S.PROFESSIONAL_TERMS + EXTRA_TERMS
QUICK_SECTIONS = S.QUICK_SECTIONS + ["that", "with"]
QUICK_TERMS = S.QUICK_TERMS + ["this", "from"]
FW_QUALITY = S.FW_QUALITY + ["that"]
FW_DOCS = S.FW_DOCS + ["with"]
FW_TECH = S.FW_TECH + ["from"]


# ---- DuckDB expression helpers (independent of the Spark column code) ----------------
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def s_words(t):
    return f"CAST(len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda x: x <> '')) AS BIGINT)"


def s_lines(t):
    return f"CAST(len(string_split({t}, chr(10))) AS BIGINT)"


def s_has(t, words, lower=True):
    src = f"lower({t})" if lower else t
    return "(" + " OR ".join(f"contains({src}, {q(w)})" for w in words) + ")"


def s_count(t, pat):
    return f"CAST(len(regexp_extract_all({t}, {q(pat)})) AS BIGINT)"


def s_b(cond, pts):
    return f"(CASE WHEN {cond} THEN {pts} ELSE 0 END)"


def s_int(cond):
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def s_arr(pairs):
    """list of (cond, message SQL) -> list of messages whose condition holds."""
    items = ", ".join(f"CASE WHEN {c} THEN {m} END" for c, m in pairs)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


STRAT_CASE = "CASE lang " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in LANG_STRATEGY.items()) + " ELSE 'Cost-Effective' END"
KIND_LIST = "[" + ", ".join(q(k) for k in FILE_KINDS) + "]"
cte("ddocs", [], f"""
SELECT doc_id, CAST(doc_id // 2 AS BIGINT) AS pair_key, {STRAT_CASE} AS strategy,
       CASE WHEN doc_id % 2 = 0 THEN 'original' ELSE 'enhanced' END AS version,
       source AS prompt_type, {KIND_LIST}[CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 5 + 1] AS file_name, text
FROM documents""")
cte("dresp", [], """
SELECT conv_id, turn, CASE turn % 5
  WHEN 0 THEN 'Here is the fix:' || chr(10) || '```python' || chr(10) || 'steps2 = [{"name": "S' || CAST(conv_id AS VARCHAR)
       || '", "function": "x := ' || CAST(turn AS VARCHAR) || '"}]' || chr(10) || 'transitions2 = [{"src": "S'
       || CAST(conv_id AS VARCHAR) || '", "tgt": "S' || CAST(conv_id AS VARCHAR) || '", "guard": "x >= '
       || CAST(turn AS VARCHAR) || '"}]' || chr(10) || '```' || chr(10) || text
  WHEN 1 THEN '```' || chr(10) || text || chr(10) || '```'
  WHEN 2 THEN 'steps2 = [' || chr(10) || '  {"name": "S' || CAST(conv_id AS VARCHAR) || '", "function": "x := 1"}' || chr(10)
       || ']' || chr(10) || 'transitions2 = [{"src": "S' || CAST(conv_id AS VARCHAR) || '", "tgt": "T' || CAST(turn AS VARCHAR)
       || '", "guard": "x >= 1"}]' || chr(10) || text
  WHEN 3 THEN 'Error 403: the api key was rejected for request ' || CAST(conv_id AS VARCHAR) || '. ' || text
  ELSE text END AS reply
FROM conversations WHERE role = 'assistant'""")


def _docs(spark, sf):
    return prompt_docs(table(spark, sf, "documents"))


def _resp(spark, sf):
    return replies(table(spark, sf, "conversations"))


# ---- X5 / X6 / X7 / X9 ---------------------------------------------------------------
@query("text_measures", compose(f"""
SELECT doc_id, {s_words('text')} AS word_count, {s_lines('text')} AS line_count,
       CAST(length(text) AS BIGINT) AS char_count, CAST(strlen(text) AS BIGINT) AS byte_count FROM documents""", "ddocs"))
def q_text_measures(spark, sf):
    d = table(spark, sf, "documents")
    t = F.col("text")
    return d.select("doc_id", X.word_count(t).alias("word_count"), X.line_count(t).alias("line_count"),
                    X.char_count(t).alias("char_count"), X.byte_count(t).alias("byte_count"))


@query("estimate_tokens", f"""
SELECT doc_id, CAST(floor({s_words('text')} / 0.75) AS BIGINT) AS token_count,
       round(CAST(floor({s_words('text')} / 0.75) AS BIGINT) / 1000.0 * 0.002, 9) AS cost_estimate,
       round(CAST(floor({s_words('text')} / 0.75) AS BIGINT) / 1000000.0 * 5.0, 9) AS dashboard_cost
FROM documents""")
def q_estimate_tokens(spark, sf):
    d = table(spark, sf, "documents")
    tok = X.estimate_tokens(X.word_count(F.col("text")))
    return d.select("doc_id", tok.alias("token_count"), F.round(X.estimate_cost(tok), 9).alias("cost_estimate"),
                    F.round(tok / 1_000_000.0 * 5.0, 9).alias("dashboard_cost"))


@query("keyword_flags", "SELECT doc_id, regexp_matches(text, '(?m)^#') AS has_headers, "
       + ", ".join(f"{s_has('text', v)} AS has_{k}" for k, v in FEATURES.items())
       + ", contains(text, '```') AS has_code_blocks FROM documents")
def q_keyword_flags(spark, sf):
    d = table(spark, sf, "documents")
    t = F.col("text")
    return d.select("doc_id", X.has_header_line(t).alias("has_headers"),
                    *[X.has_any(t, v).alias(f"has_{k}") for k, v in FEATURES.items()],
                    t.contains("```").alias("has_code_blocks"))


_COUNT_PATS = {"headers": S.HEADER_RE, "bullets": S.BULLET_RE, "code_blocks": S.CODE_BLOCK_RE,
               **{f"explain_{i}": p for i, p in enumerate(S.EXPLANATION_RES)},
               **{f"step_{i}": p for i, p in enumerate(S.STEP_RES)},
               **{f"named_{k}": "(?i)(" + "|".join(v) + ")" for k, v in S.PATTERNS.items()}, "sentences": r"[.!?](\s|$)", "commas": ","}


@query("pattern_counts", "SELECT doc_id, " + ", ".join(f"{s_count('text', p)} AS {k}" for k, p in _COUNT_PATS.items())
       + " FROM documents")
def q_pattern_counts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", *[X.count_matches(F.col("text"), p).alias(k) for k, p in _COUNT_PATS.items()])


# ---- X8 / X1 / X4 ----------------------------------------------------------------------
@query("html_escape", """
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
       '''', '&#x27;') AS escaped FROM pages""")
def q_html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped"))


@query("sanitize_controls", """
SELECT conv_id, turn, regexp_replace(replace(replace(replace(replace(coalesce(text, ''), '→', '->'), '←', '<-'), '⇒', '=>'),
       '⇐', '<='), '[\\x00-\\x08\\x0B-\\x1F\\x{10FFFF}]', '', 'g') AS clean FROM conversations""")
def q_sanitize_controls(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.sanitize_text(F.col("text"), nfkc=False).alias("clean"))


@query("sanitize_text", """
SELECT conv_id, turn, regexp_replace(replace(replace(replace(replace(nfc_normalize(coalesce(text, '')), '→', '->'), '←', '<-'), '⇒', '=>'),
       '⇐', '<='), '[\\x00-\\x08\\x0B-\\x1F\\x{10FFFF}]', '', 'g') AS clean FROM conversations""")
def q_sanitize_text(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.sanitize_text(F.col("text")).alias("clean"))


_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@query("strip_markdown_fence", compose(
    "SELECT conv_id, turn, regexp_replace(" + _STRIP.format(x="regexp_replace(" + _STRIP.format(x="reply")
                                                            + ", '^```[a-zA-Z]*\\n', '')") + ", '\\n```$', '') AS code FROM dresp",
    "dresp"))
def q_strip_markdown_fence(spark, sf):
    return _resp(spark, sf).select("conv_id", "turn", X.strip_markdown_fence(F.col("reply")).alias("code"))


# ---- X2 / X14 / P5 ---------------------------------------------------------------------
_CODE_SQL = (f"CASE WHEN regexp_matches(reply, {q(X.FENCE_RE)}) THEN regexp_extract(reply, {q(X.FENCE_RE)}, 1) "
             f"ELSE array_to_string(regexp_extract_all(reply, {q(X.LIST_LINES_RE)}), chr(10)) END")


@query("extract_code_block", compose(f"SELECT conv_id, turn, {_CODE_SQL} AS code FROM dresp", "dresp"))
def q_extract_code_block(spark, sf):
    return _resp(spark, sf).select("conv_id", "turn", X.extract_code_block(F.col("reply")).alias("code"))


_S_RE = r"steps2\s*=\s*(\[[\s\S]*?\])\s*(?:\n|$)"
_T_RE = r"transitions2\s*=\s*(\[[\s\S]*?\])\s*(?:\n|$)"


@query("parse_code_reply", compose(f"""
SELECT conv_id, turn,
       CASE WHEN code = '' THEN 'no_code_block'
            WHEN s = '' OR t = '' OR NOT json_valid(s) OR NOT json_valid(t) THEN 'missing_lists' ELSE 'ok' END AS status,
       CASE WHEN s <> '' AND t <> '' AND json_valid(s) AND json_valid(t) THEN CAST(json_array_length(s) AS INTEGER) END AS n_steps,
       CASE WHEN s <> '' AND t <> '' AND json_valid(s) AND json_valid(t) THEN CAST(json_array_length(t) AS INTEGER) END AS n_transitions,
       CASE WHEN s <> '' AND t <> '' AND json_valid(s) AND json_valid(t) THEN json_extract_string(s, '$[0].name') END AS first_step
FROM (SELECT conv_id, turn, code, regexp_extract(code, {q(_S_RE)}, 1) AS s, regexp_extract(code, {q(_T_RE)}, 1) AS t
      FROM (SELECT conv_id, turn, {_CODE_SQL} AS code FROM dresp))""", "dresp"))
def q_parse_code_reply(spark, sf):
    p = _resp(spark, sf).select("conv_id", "turn", X.parse_code_reply(F.col("reply")).alias("p"))
    ok = F.col("p.status") == "ok"
    return p.select("conv_id", "turn", F.col("p.status").alias("status"),
                    F.when(ok, F.size("p.steps2")).alias("n_steps"), F.when(ok, F.size("p.transitions2")).alias("n_transitions"),
                    F.when(ok, F.col("p.steps2")[0]["name"]).alias("first_step"))


@query("api_error_flag", compose("""
SELECT conv_id, turn, contains(lower(reply), 'error') AND (contains(lower(reply), '403') OR contains(lower(reply), 'api key')
       OR contains(lower(reply), 'not found')) AS is_api_error FROM dresp""", "dresp"))
def q_api_error_flag(spark, sf):
    return _resp(spark, sf).select("conv_id", "turn", X.api_error_flag(F.col("reply")).alias("is_api_error"))


# ---- T1 / T2 ---------------------------------------------------------------------------
def _t1_sql():
    w = s_words("text")
    tok = f"floor({w} / 0.75)"
    cost = f"({tok} / 1000.0 * 0.002)"
    f = {k: s_has("text", v) for k, v in FEATURES.items()}
    heads = "regexp_matches(text, '(?m)^#')"
    edv = f"({f['error_handling']} AND {f['validation']} AND {f['documentation']})"
    raw = (f"((CASE WHEN {w} > 400 THEN 15 WHEN {w} > 200 THEN 10 WHEN {w} > 100 THEN 5 ELSE 0 END)"
           f" + {s_b(heads, 15)} + {s_b(f['examples'], 10)} + {s_b(f['requirements'], 10)} + {s_b(f['guidelines'], 10)}"
           f" + {s_b(f['error_handling'], 10)} + {s_b(f['validation'], 10)} + {s_b(f['documentation'], 5)}"
           f" + {s_b(chr(99) + 'ontains(text, ' + q('```') + ')', 10)}"
           f" + (CASE strategy WHEN 'Cost-Effective' THEN (CASE WHEN {w} > 300 THEN -5 WHEN {w} < 150 THEN 5 ELSE 0 END)"
           f" WHEN 'Sweet Spot' THEN {s_b(f'{w} BETWEEN 200 AND 600', 10)}"
           f" WHEN 'Accuracy-Effective' THEN {s_b(edv, 15)}"
           f" WHEN 'Semantic-View' THEN {s_b(edv, 20)} + {s_b(s_has('text', SEMANTIC), 10)} ELSE 0 END))")
    return f"""
SELECT doc_id, strategy, prompt_type, CAST({tok} AS BIGINT) AS token_count, round({cost}, 9) AS cost_estimate,
       CAST(least({raw}, 100) AS INTEGER) AS quality_score, round({raw} / greatest({tok}, 1), 9) AS quality_per_token,
       round({raw} / greatest({cost}, 0.001), 6) AS cost_efficiency
FROM ddocs"""


cte("t1", ["ddocs"], _t1_sql())


def _t1(spark, sf):
    d = _docs(spark, sf)
    s = S.score_cost_accuracy(F.col("text"), F.col("strategy"), FEATURES, SEMANTIC)
    return d.select("doc_id", "strategy", "prompt_type", s.alias("m")).select(
        "doc_id", "strategy", "prompt_type", "m.token_count", F.round("m.cost_estimate", 9).alias("cost_estimate"),
        F.col("m.quality_score").cast("int").alias("quality_score"),
        F.round("m.quality_per_token", 9).alias("quality_per_token"), F.round("m.cost_efficiency", 6).alias("cost_efficiency"))


@query("score_cost_accuracy", compose("SELECT * FROM t1", "t1"))
def q_score_cost_accuracy(spark, sf):
    return _t1(spark, sf)


def _t2_sql(tcol, orig: bool):
    w = s_words(tcol)
    f = {k: s_has(tcol, v) for k, v in FEATURES.items()}
    heads = f"regexp_matches({tcol}, '(?m)^#')"
    raw = (f"((CASE WHEN {w} > 500 THEN 20 WHEN {w} > 200 THEN 10 WHEN {w} > 100 THEN 5 ELSE 0 END)"
           f" + {s_b(heads, 15)} + {s_b(f['examples'], 10)} + {s_b(f['requirements'], 10)} + {s_b(f['guidelines'], 10)}"
           f" + {s_b(f['error_handling'], 10)} + {s_b(f['validation'], 10)} + {s_b(f['documentation'], 5)}"
           f" + {s_b('contains(' + tcol + ', ' + q('```') + ')', 10)} + {s_b(s_has(tcol, ['class']), 5)}"
           f" + {s_b(s_has(tcol, ['type']), 5)})")
    if orig:
        lst = s_arr([(f"NOT {heads}", q("Lacks structured headers and organization")),
                     (f"NOT {f['requirements']}", q("Missing clear requirements specification")),
                     (f"NOT {f['error_handling']}", q("No error handling guidance")),
                     (f"NOT {f['validation']}", q("Lacks validation instructions")),
                     (f"{w} < 200", q("Very brief, lacks comprehensive guidance")),
                     (f"NOT {f['documentation']}", q("No documentation standards specified"))])
    else:
        lst = s_arr([(heads, q("Well-structured with clear headers")),
                     (f['requirements'], q("Comprehensive requirements specification")),
                     (f['error_handling'], q("Includes error handling guidance")),
                     (f['validation'], q("Validation and testing instructions")),
                     (f"{w} > 500", q("Comprehensive and detailed guidance")),
                     (f['documentation'], q("Documentation standards included"))])
    return f"CAST(least({raw}, 100) AS INTEGER)", w, heads, lst


def _ab_sql():
    o_s, o_w, o_h, o_l = _t2_sql("orig_text", True)
    e_s, e_w, e_h, e_l = _t2_sql("enh_text", False)
    return f"""
SELECT pair_key, {o_s} AS orig_score, {e_s} AS enh_score, {e_s} - {o_s} AS quality_gain,
       round({e_w} / greatest({o_w}, 1), 9) AS word_count_ratio, ({e_h} AND NOT {o_h}) AS structure_improved,
       CAST(len({o_l}) AS INTEGER) AS orig_issues, CAST(len({e_l}) AS INTEGER) AS enh_improvements,
       array_to_string({o_l}, ' | ') AS issues_text
FROM ab_pairs"""


cte("ab_pairs", ["ddocs"], """
SELECT coalesce(o.pair_key, e.pair_key) AS pair_key, o.doc_id AS orig_id, e.doc_id AS enh_id,
       coalesce(o.text, 'FILE NOT FOUND: original/' || CAST(coalesce(o.pair_key, e.pair_key) AS VARCHAR)) AS orig_text,
       coalesce(e.text, 'FILE NOT FOUND: enhanced/' || CAST(coalesce(o.pair_key, e.pair_key) AS VARCHAR)) AS enh_text
FROM (SELECT * FROM ddocs WHERE version = 'original') o
FULL OUTER JOIN (SELECT * FROM ddocs WHERE version = 'enhanced') e ON o.pair_key = e.pair_key""")
cte("ab_res", ["ab_pairs"], _ab_sql())


def _ab(spark, sf):
    return S.ab_results(S.ab_pairs(_docs(spark, sf)), FEATURES)


@query("ab_pairs", compose("SELECT pair_key, orig_id, enh_id, orig_text, enh_text FROM ab_pairs", "ab_pairs"))
def q_ab_pairs(spark, sf):
    return S.ab_pairs(_docs(spark, sf))


@query("score_ab", compose("SELECT * FROM ab_res", "ab_res"))
def q_score_ab(spark, sf):
    p = S.ab_pairs(_docs(spark, sf))
    o = S.score_ab(F.col("orig_text"), F.lit(True), FEATURES)
    r = S.ab_results(p, FEATURES)
    iss = p.select("pair_key", F.array_join(o["issues"], " | ").alias("issues_text"))
    return r.join(iss, "pair_key").select(
        "pair_key", F.col("orig_score").cast("int").alias("orig_score"), F.col("enh_score").cast("int").alias("enh_score"),
        F.col("quality_gain").cast("int").alias("quality_gain"), F.round("word_count_ratio", 9).alias("word_count_ratio"),
        "structure_improved", F.col("orig_issues").cast("int").alias("orig_issues"),
        F.col("enh_improvements").cast("int").alias("enh_improvements"), "issues_text")


@query("ab_summary", compose("""
SELECT CAST(count(*) AS BIGINT) AS tests_run, round(avg(orig_score), 6) AS average_original_score,
       round(avg(enh_score), 6) AS average_enhanced_score, round(avg(enh_score) - avg(orig_score), 6) AS overall_improvement,
       round(CASE WHEN avg(orig_score) > 0 THEN (avg(enh_score) - avg(orig_score)) / avg(orig_score) * 100 ELSE 0.0 END, 6)
         AS improvement_percentage,
       round(avg(CASE WHEN quality_gain > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS success_rate,
       CASE WHEN avg(enh_score) - avg(orig_score) > 40 THEN 'OUTSTANDING' WHEN avg(enh_score) - avg(orig_score) > 25 THEN 'EXCELLENT'
            WHEN avg(enh_score) - avg(orig_score) > 15 THEN 'GOOD' ELSE 'MARGINAL' END AS conclusion
FROM ab_res""", "ab_res"))
def q_ab_summary(spark, sf):
    s = S.ab_summary(_ab(spark, sf))
    return s.select("tests_run", *[F.round(c, 6).alias(c) for c in (
        "average_original_score", "average_enhanced_score", "overall_improvement", "improvement_percentage", "success_rate")],
        "conclusion")


# ---- A6 / A7 / J9 / P10 ------------------------------------------------------------------
_SO = "list_position(" + "[" + ", ".join(q(s) for s in S.STRATEGIES) + "], strategy)"


@query("best_by_metric", compose(f"""
SELECT prompt_type, metric, strategy, doc_id, quality_score, cost_estimate, quality_per_token FROM (
  SELECT *, 'best_quality' AS metric, row_number() OVER (PARTITION BY prompt_type ORDER BY quality_score DESC, {_SO}, doc_id) AS r FROM t1
  UNION ALL
  SELECT *, 'most_cost_effective', row_number() OVER (PARTITION BY prompt_type ORDER BY cost_estimate ASC, {_SO}, doc_id) FROM t1
  UNION ALL
  SELECT *, 'best_efficiency', row_number() OVER (PARTITION BY prompt_type ORDER BY quality_per_token DESC, {_SO}, doc_id) FROM t1
) WHERE r = 1""", "t1"))
def q_best_by_metric(spark, sf):
    return S.best_by_metric(_t1(spark, sf))


cte("strat_costs", ["t1"], """
SELECT strategy, round(avg(token_count), 6) AS tokens_per_prompt, avg(token_count) / 1000.0 * 0.002 AS cost_per_prompt,
       round(avg(quality_score), 6) AS mean_quality, count(*) AS n_docs FROM t1 GROUP BY strategy""")


def _costs(spark, sf):
    c = S.strategy_costs(_t1(spark, sf))
    return c.select("strategy", F.round("tokens_per_prompt", 6).alias("tokens_per_prompt"),
                    (F.col("tokens_per_prompt") / 1000.0 * 0.002).alias("cost_per_prompt"),
                    F.round("mean_quality", 6).alias("mean_quality"), "n_docs")


_UC = " UNION ALL ".join(f"SELECT {q(n)} AS use_case, {v} AS monthly_prompts" for n, v in S.USE_CASES)


@query("strategy_volume_cross", compose(f"""
SELECT c.strategy, u.use_case, u.monthly_prompts FROM strat_costs c, ({_UC}) u""", "strat_costs"))
def q_strategy_volume_cross(spark, sf):
    return S.cost_projection(_costs(spark, sf)).select("strategy", "use_case", F.col("monthly_prompts").cast("int"))


@query("cost_projection", compose(f"""
SELECT c.strategy, u.use_case, round(c.cost_per_prompt * u.monthly_prompts, 6) AS monthly_cost,
       round(c.cost_per_prompt * u.monthly_prompts * 12, 6) AS annual_cost FROM strat_costs c, ({_UC}) u""", "strat_costs"))
def q_cost_projection(spark, sf):
    p = S.cost_projection(_costs(spark, sf))
    return p.select("strategy", "use_case", F.round("monthly_cost", 6).alias("monthly_cost"),
                    F.round("annual_cost", 6).alias("annual_cost"))


_SC = " UNION ALL ".join(f"SELECT {q(a)} AS scenario, {q(b)} AS strategy" for a, b in S.SCENARIOS)


@query("scenario_recommendation", compose(f"""
SELECT s.scenario, s.strategy, round(c.cost_per_prompt, 9) AS cost_per_prompt, c.mean_quality
FROM ({_SC}) s LEFT JOIN strat_costs c ON c.strategy = s.strategy""", "strat_costs"))
def q_scenario_recommendation(spark, sf):
    r = S.scenario_recommendation(_costs(spark, sf))
    return r.select("scenario", "strategy", F.round("cost_per_prompt", 9).alias("cost_per_prompt"), "mean_quality")


# ---- T3-T7 / A10 / R1 ----------------------------------------------------------------------
def _t3_sql(t="text"):
    h, b, cb = s_count(t, S.HEADER_RE), s_count(t, S.BULLET_RE), s_count(t, S.CODE_BLOCK_RE)
    sec = "(" + " + ".join(s_int(s_has(t, PATTERNS[s])) for s in S.STRUCTURE_SECTIONS) + ")"
    n = f"length({t})"
    score = (f"((CASE WHEN {h} >= 5 THEN 15 WHEN {h} >= 3 THEN 10 ELSE 5 END) + (CASE WHEN {b} >= 10 THEN 10 WHEN {b} >= 5 THEN 7 ELSE 3 END)"
             f" + (CASE WHEN {cb} >= 3 THEN 10 WHEN {cb} >= 1 THEN 5 ELSE 0 END) + (CASE WHEN {sec} >= 4 THEN 15 WHEN {sec} >= 3 THEN 10 ELSE 5 END)"
             f" + (CASE WHEN {n} > 5000 THEN 10 WHEN {n} > 2000 THEN 7 ELSE 3 END))")
    issues = s_arr([(f"{h} < 3", q("Limited structural organization")), (f"{b} < 5", q("Limited use of structured formatting")),
                    (f"{cb} < 1", q("No code examples provided")),
                    (f"{sec} < 3", f"'Limited coverage (' || CAST({sec} AS VARCHAR) || '/5 key sections)'"),
                    (f"{n} <= 2000", q("May be too brief for comprehensive guidance"))])
    strengths = f"({s_int(f'{h} >= 3')} + {s_int(f'{b} >= 5')} + {s_int(f'{cb} >= 1')} + {s_int(f'{sec} >= 3')} + {s_int(f'{n} > 2000')} + {sec})"
    return f"CAST(least({score}, 100) AS DOUBLE)", issues, strengths


def _t4_sql(t="text"):
    found = {k: s_has(t, PATTERNS[k]) for k, _ in S.CONTENT_INDICATORS}
    pc = "(" + " + ".join(s_int(f"contains(lower({t}), {q(w)})") for w in TERMS) + ")"
    score = "(" + " + ".join(s_b(found[k], p) for k, p in S.CONTENT_INDICATORS) + f" + (CASE WHEN {pc} >= 10 THEN 10 WHEN {pc} >= 5 THEN 5 ELSE 0 END))"
    issues = s_arr([(f"NOT {found[k]}", q("Missing " + k.replace("_", " "))) for k, _ in S.CONTENT_INDICATORS]
                   + [(f"{pc} < 5", f"'Limited professional terminology (' || CAST({pc} AS VARCHAR) || ' terms)'")])
    strengths = "(" + " + ".join(s_int(found[k]) for k, _ in S.CONTENT_INDICATORS) + f" + {s_int(f'{pc} >= 5')})"
    return f"CAST(least({score}, 100) AS DOUBLE)", issues, strengths


def _t5_sql(t="text"):
    ex = "(" + " + ".join(s_count(t, p) for p in S.EXPLANATION_RES) + ")"
    st = "(" + " + ".join(s_count(t, p) for p in S.STEP_RES) + ")"
    fmt = "(" + " + ".join(s_b(f"contains({t}, {q(e)})", 5) for e in S.MARKDOWN_ELEMENTS) + ")"
    ln = s_lines(t)
    score = (f"((CASE WHEN {ex} >= 15 THEN 20 WHEN {ex} >= 10 THEN 15 WHEN {ex} >= 5 THEN 10 ELSE 0 END)"
             f" + (CASE WHEN {st} >= 5 THEN 20 WHEN {st} >= 3 THEN 15 ELSE 5 END) + least({fmt}, 40)"
             f" + (CASE WHEN {ln} >= 100 THEN 20 WHEN {ln} >= 50 THEN 15 ELSE 5 END))")
    issues = s_arr([(f"{ex} < 5", f"'Limited explanatory content (' || CAST({ex} AS VARCHAR) || ' instances)'"),
                    (f"{st} < 3", f"'Limited step-by-step guidance (' || CAST({st} AS VARCHAR) || ' steps)'"),
                    (f"{fmt} < 20", q("Limited markdown formatting")), (f"{ln} < 50", q("Documentation may be too brief"))])
    strengths = f"({s_int(f'{ex} >= 5')} + {s_int(f'{st} >= 3')} + {s_int(f'{fmt} >= 20')} + {s_int(f'{ln} >= 50')})"
    return f"CAST(least({score}, 100) AS DOUBLE)", issues, strengths


def _t6_sql(t="text", name="file_name"):
    chosen = "CASE " + " ".join(f"WHEN contains({name}, {q(p)}) THEN [" + ", ".join(q(e) for e in els) + "]"
                                for p, els in S.COMPLETENESS_RULES) + " END"
    return chosen


cte("t3t6", ["ddocs"], f"""
SELECT doc_id, file_name, text, {_t6_sql()} AS chosen FROM ddocs""")


def _t7_sql():
    s3, i3, n3 = _t3_sql()
    s4, i4, n4 = _t4_sql()
    s5, i5, n5 = _t5_sql()
    k = "len(list_filter(chosen, lambda e: contains(lower(text), e)))"
    n = "len(chosen)"
    s6 = f"least({k} * (100.0 / {n}), 100.0)"
    i6 = (f"list_concat(list_transform(list_filter(chosen, lambda e: NOT contains(lower(text), e)), lambda e: 'Missing ' || e),"
          f" CASE WHEN {k} < {n} * 0.8 THEN ['Incomplete domain coverage'] ELSE [] END)")
    n6 = f"({k} + CASE WHEN {k} >= {n} * 0.8 THEN 1 ELSE 0 END)"
    return f"""
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS file_size, {s_lines('text')} AS line_count, {s_words('text')} AS word_count,
       {s3} AS structure_score, {s4} AS content_score, {s5} AS documentation_score, {s6} AS completeness_score,
       ({s3} + {s4} + {s5} + {s6}) / 4 AS overall_score,
       list_concat(list_concat(list_concat({i3}, {i4}), {i5}), {i6}) AS issues,
       CAST({n3} + {n4} + {n5} + {n6} AS INTEGER) AS n_strengths
FROM t3t6"""


cte("t7", ["t3t6"], _t7_sql())


def _t7(spark, sf):
    d = _docs(spark, sf).select("doc_id", "file_name", "text")
    return S.score_overall(d, "text", "file_name", PATTERNS, TERMS).drop("text", "file_name")


_T7_COLS = ("doc_id, file_size, line_count, word_count, round(structure_score, 6) AS structure_score, round(content_score, 6) AS content_score, "
            "round(documentation_score, 6) AS documentation_score, round(completeness_score, 6) AS completeness_score, "
            "round(overall_score, 6) AS overall_score, array_to_string(issues, ' | ') AS issues_text, n_strengths")


@query("score_overall", compose(f"SELECT {_T7_COLS} FROM t7", "t7"))
def q_score_overall(spark, sf):
    s = _t7(spark, sf)
    r = lambda c: F.round(c, 6).alias(c)
    return s.select("doc_id", "file_size", "line_count", "word_count", r("structure_score"), r("content_score"),
                    r("documentation_score"), r("completeness_score"), r("overall_score"),
                    F.array_join("issues", " | ").alias("issues_text"), "n_strengths")


for _key, _col, _fn in (("score_structure", "structure_score", lambda t, lt: S.score_structure(t, PATTERNS, lt)),
                        ("score_content", "content_score", lambda t, lt: S.score_content(t, PATTERNS, TERMS, lt)),
                        ("score_documentation", "documentation_score", lambda t, lt: S.score_documentation(t, None, lt))):
    def _mk(col=_col, fn=_fn):
        def run(spark, sf):
            d = table(spark, sf, "documents").withColumn("_lt", F.lower("text"))
            s = fn(F.col("text"), F.col("_lt"))
            return d.select("doc_id", s["score"].alias(col), F.size(s["issues"]).cast("int").alias("n_issues"))
        return run

    _iss = {"structure_score": _t3_sql, "content_score": _t4_sql, "documentation_score": _t5_sql}[_col]()[1]
    query(_key, compose(
        f"SELECT t7.doc_id, t7.{_col}, CAST(len({_iss}) AS INTEGER) AS n_issues FROM t7 JOIN ddocs USING (doc_id)",
        "t7", "ddocs"))(_mk())


@query("score_completeness", compose("""
SELECT doc_id, file_name, round(least(len(list_filter(chosen, lambda e: contains(lower(text), e))) * (100.0 / len(chosen)), 100.0), 6) AS score,
       CASE WHEN len(list_filter(chosen, lambda e: contains(lower(text), e))) = len(chosen) THEN 'complete'
            WHEN len(list_filter(chosen, lambda e: contains(lower(text), e))) >= len(chosen) * 0.8 THEN 'good' ELSE 'incomplete' END AS coverage
FROM t3t6""", "t3t6"))
def q_score_completeness(spark, sf):
    d = _docs(spark, sf)
    c = S.score_completeness(F.col("text"), F.col("file_name"))
    return d.select("doc_id", "file_name", F.round(c["score"], 6).alias("score"), c["coverage"].alias("coverage"))


@query("quality_report", compose("""
SELECT CAST(count(*) AS BIGINT) AS total_files, round(avg(overall_score), 6) AS average_score, round(avg(file_size), 6) AS average_size,
       round(avg(line_count), 6) AS average_lines, CAST(sum(len(issues)) AS BIGINT) AS total_issues,
       CAST(sum(n_strengths) AS BIGINT) AS total_strengths,
       count(*) FILTER (WHERE overall_score >= 90) AS excellent_files,
       count(*) FILTER (WHERE overall_score >= 75 AND overall_score < 90) AS good_files,
       count(*) FILTER (WHERE overall_score >= 60 AND overall_score < 75) AS adequate_files,
       count(*) FILTER (WHERE overall_score < 60) AS needs_improvement
FROM t7""", "t7"))
def q_quality_report(spark, sf):
    r = S.quality_report(_t7(spark, sf))
    return r.select("total_files", *[F.round(c, 6).alias(c) for c in ("average_score", "average_size", "average_lines")],
                    F.col("total_issues").cast("bigint"), F.col("total_strengths").cast("bigint"),
                    "excellent_files", "good_files", "adequate_files", "needs_improvement")


@query("score_grade", compose("""
SELECT doc_id, CASE WHEN overall_score >= 90 THEN 'excellent' WHEN overall_score >= 75 THEN 'good'
       WHEN overall_score >= 60 THEN 'adequate' ELSE 'needs_improvement' END AS grade FROM t7""", "t7"))
def q_score_grade(spark, sf):
    s = _t7(spark, sf)
    return s.select("doc_id", X.grade(F.col("overall_score"), S.GRADE_REPORT, "needs_improvement").alias("grade"))


_RANK_SQL = " UNION ALL ".join(
    f"SELECT doc_id, {q(n)} AS ranking, CAST({c} AS DOUBLE) AS score FROM t7" for n, c in S.RANKINGS)


@query("rank_by_each_score", compose(f"""
SELECT doc_id, ranking, round(score, 6) AS score, row_number() OVER (PARTITION BY ranking ORDER BY score DESC, doc_id) AS rank
FROM ({_RANK_SQL})""", "t7"))
def q_rank_by_each_score(spark, sf):
    r = S.rank_by_each_score(_t7(spark, sf))
    return r.select("doc_id", "ranking", F.round("score", 6).alias("score"), F.col("rank"))


# ---- T8 / R2 / A11 -------------------------------------------------------------------------
def _t8_sql(t="text"):
    found = "(" + " + ".join(s_int(f"contains(lower({t}), {q(w)})") for w in QUICK_SECTIONS) + ")"
    ft = "(" + " + ".join(s_int(f"contains(lower({t}), {q(w)})") for w in QUICK_TERMS) + ")"
    hashes = f"(length({t}) - length(replace({t}, '#', '')))"
    n = f"length({t})"
    score = (f"least({s_b(f'{hashes} >= 5', 20)} + {s_b(f'contains({t}, {q(chr(42) * 2)})', 10)} + {s_b(f'contains({t}, {q(chr(96) * 3)})', 15)}"
             f" + {found} * 10 + (CASE WHEN {n} > 3000 THEN 15 WHEN {n} > 1000 THEN 10 ELSE 0 END) + {ft} * 5, 100)")
    issues = s_arr([(f"{hashes} < 5", q("Limited header structure")), (f"NOT contains({t}, '**')", q("No bold formatting")),
                    (f"NOT contains({t}, '```')", q("No code blocks")),
                    (f"{found} < 3", f"'Only ' || CAST({found} AS VARCHAR) || '/5 key sections found'"),
                    (f"{n} <= 1000", q("Prompt may be too brief"))])
    return score, issues


cte("t8", ["ddocs"], "SELECT doc_id, CAST({0} AS INTEGER) AS score, {1} AS issues, round(length(text) / 1024.0, 9) AS size_kb FROM ddocs"
    .format(*_t8_sql()))


def _t8(spark, sf):
    d = _docs(spark, sf)
    s = S.score_quick(F.col("text"), QUICK_SECTIONS, QUICK_TERMS)
    return d.select("doc_id", s["score"].cast("int").alias("score"), s["issues"].alias("issues"),
                    F.round(X.char_count(F.col("text")) / 1024.0, 9).alias("size_kb"))


@query("score_quick", compose("SELECT doc_id, score, array_to_string(issues, ' | ') AS issues_text, size_kb FROM t8", "t8"))
def q_score_quick(spark, sf):
    return _t8(spark, sf).select("doc_id", "score", F.array_join("issues", " | ").alias("issues_text"), "size_kb")


@query("top_k", compose("""
SELECT doc_id, score, array_to_string(issues[1:3], ' | ') AS first_issues,
       CASE WHEN len(issues) > 3 THEN '... and ' || CAST(len(issues) - 3 AS VARCHAR) || ' more' END AS more
FROM t8 ORDER BY score DESC, doc_id LIMIT 3""", "t8"))
def q_top_k(spark, sf):
    t = S.top_k(_t8(spark, sf))
    return t.select("doc_id", "score", F.array_join("first_issues", " | ").alias("first_issues"), "more")


@query("run_quality_summary", compose("""
SELECT CAST(count(*) AS BIGINT) AS files, round(avg(score), 6) AS average_score, round(sum(size_kb), 6) AS total_kb,
       round(avg(size_kb), 6) AS average_kb, CAST(sum(len(issues)) AS BIGINT) AS total_issues,
       round(sum(size_kb) / (count(*) * 0.5), 6) AS enhancement_factor,
       CASE WHEN avg(score) >= 85 THEN 'EXCELLENT' WHEN avg(score) >= 75 THEN 'GOOD' WHEN avg(score) >= 60 THEN 'ADEQUATE'
            ELSE 'NEEDS_IMPROVEMENT' END AS status
FROM t8""", "t8"))
def q_run_quality_summary(spark, sf):
    r = S.run_quality_summary(_t8(spark, sf))
    return r.select("files", *[F.round(c, 6).alias(c) for c in ("average_score", "total_kb", "average_kb")],
                    F.col("total_issues").cast("bigint"), F.round("enhancement_factor", 6).alias("enhancement_factor"), "status")


# ---- T9 / A12 --------------------------------------------------------------------------------
def _t9_sql(t):
    h = s_count(t, r"(?m)^#+\s+")
    fq = "(" + " + ".join(s_int(f"contains(lower({t}), {q(w)})") for w in FW_QUALITY) + ")"
    fd = "(" + " + ".join(s_int(f"contains(lower({t}), {q(w)})") for w in FW_DOCS) + ")"
    ft = "(" + " + ".join(s_int(f"contains(lower({t}), {q(w)})") for w in FW_TECH) + ")"
    score = f"CAST(least((CASE WHEN {h} >= 5 THEN 25 WHEN {h} >= 3 THEN 15 ELSE 5 END) + {fq} * 5 + {fd} * 6 + {ft} * 5, 100) AS DOUBLE)"
    return score, fq, fd, ft


@query("score_framework", compose("""
SELECT doc_id, {0} AS score, {1} >= 4 AS comprehensive_content, {2} >= 3 AS well_documented, {3} >= 4 AS technically_complete
FROM ddocs""".format(*_t9_sql("text")), "ddocs"))
def q_score_framework(spark, sf):
    d = _docs(spark, sf)
    s = S.score_framework(F.col("text"), FW_QUALITY, FW_DOCS, FW_TECH)
    return d.select("doc_id", s["score"].alias("score"), s["comprehensive_content"].alias("comprehensive_content"),
                    s["well_documented"].alias("well_documented"), s["technically_complete"].alias("technically_complete"))


@query("effect_summary", compose("""
SELECT CAST(count(*) AS BIGINT) AS pairs, round(avg(e - o), 6) AS average_quality_improvement,
       round(avg(es / os), 6) AS average_size_factor,
       round(avg(CASE WHEN o > 0 THEN (e - o) / o * 100 ELSE 0.0 END), 6) AS average_improvement_pct
FROM (SELECT {0} AS o, {1} AS e, CAST(length(orig_text) AS DOUBLE) AS os, CAST(length(enh_text) AS DOUBLE) AS es FROM ab_pairs)
""".format(_t9_sql("orig_text")[0], _t9_sql("enh_text")[0]), "ab_pairs"))
def q_effect_summary(spark, sf):
    p = S.ab_pairs(_docs(spark, sf))
    r = S.effect_summary(p, FW_QUALITY, FW_DOCS, FW_TECH)
    return r.select("pairs", *[F.round(c, 6).alias(c) for c in (
        "average_quality_improvement", "average_size_factor", "average_improvement_pct")])


# ---- X3 / X11 / X12 / X13 / T10 / A9 ---------------------------------------------------
DOMAINS = ["factorial", "dec2hex_r1", "dec2hex_r2"]




# X3 oracle: the same priority rules written with DuckDB list functions
cte("x3_s", ['dresp'], r"""
SELECT conv_id, turn, regexp_replace(replace(replace(replace(replace(coalesce(reply, ''), '→', '->'), '←', '<-'), '⇒', '=>'), '⇐', '<='),
         '[\x00-\x08\x0B-\x1F\x{10FFFF}]', '', 'g') AS o FROM dresp""")
cte("x3_b", ['x3_s'], r"""
SELECT conv_id, turn, o,
    list_filter(list_transform(regexp_extract_all(o, '```(?:\w*\n)?([\s\S]*?)```', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS fenced,
    list_filter(list_transform(regexp_extract_all(o, '(?:^|\n)((?: {4}.+(?:\n|$))+)', 1),
                lambda x: regexp_replace(regexp_replace(x, '(?m)^ {4}', '', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ind,
    regexp_extract(o, '(?i)(steps\s*=\s*\[([\s\S]*?)\])', 1) AS st,
    list_filter([regexp_replace(regexp_extract(o, '(?i)(steps\s*=\s*\[([\s\S]*?)\])', 1), '^\s+|\s+$', '', 'g'),
                 regexp_replace(regexp_extract(o, '(?i)(transitions\s*=\s*\[([\s\S]*?)\])', 1), '^\s+|\s+$', '', 'g'),
                 regexp_replace(regexp_extract(o, '(?i)(variables\s*=\s*\[([\s\S]*?)\])', 1), '^\s+|\s+$', '', 'g'),
                 regexp_replace(regexp_extract(o, '(?i)(initial_step\s*=\s*[''"].+?[''"])', 1), '^\s+|\s+$', '', 'g')], lambda x: x <> '') AS parts,
    list_filter(string_split_regex(o, '\r\n|\r|\n'), lambda ln: contains(ln, 'STEP') OR contains(ln, 'STATE') OR contains(ln, 'TRANSITION')
                OR contains(ln, 'IF') OR contains(ln, 'THEN') OR contains(ln, 'ELSE') OR contains(ln, ':=') OR contains(ln, '=')) AS lines
  FROM x3_s""")
cte("x3_c", ['x3_b'], r"""
SELECT conv_id, turn, lines,
         list_concat(list_concat(CASE WHEN st <> '' THEN [array_to_string(parts, chr(10) || chr(10))] ELSE [] END, fenced), ind) AS blocks FROM x3_b""")
cte("x3_d", ['x3_c'], r"""
SELECT conv_id, turn, CASE WHEN len(blocks) = 0 AND len(lines) >= 3 THEN [array_to_string(lines, chr(10))] ELSE blocks END AS blocks FROM x3_c""")
X3_SQL = compose(r"""SELECT conv_id, turn, CAST(generate_subscripts(blocks, 1) - 1 AS INTEGER) AS pos, unnest(blocks) AS block FROM x3_d""", "x3_d")


@query("extract_blocks", X3_SQL)
def q_extract_blocks(spark, sf):
    r = _resp(spark, sf)
    return r.select("conv_id", "turn", F.posexplode(X.extract_blocks(F.col("reply"))).alias("pos", "block")).select(
        "conv_id", "turn", F.col("pos").cast("int"), "block")


@query("chart_blocks_validate", compose(f"""
SELECT conv_id, turn, CAST({s_b("contains(reply, 'steps') AND contains(reply, '=')", 25)} + {s_b("contains(reply, 'transitions') AND contains(reply, '=')", 25)}
       + {s_b(f"regexp_matches(reply, {q(S.DICT_STRUCTURE_RE)})", 25)} + {s_b("contains(reply, '" + '"name"' + "') OR contains(reply, '''name''')", 25)} AS DOUBLE) AS score
FROM dresp""", "dresp"))
def q_chart_blocks_validate(spark, sf):
    r = _resp(spark, sf)
    return r.select("conv_id", "turn", S.chart_blocks_validate(F.col("reply"))["score"].alias("score"))


def _rule_sql(r, t="reply"):
    parts = [f"contains({t}, {q(w)})" for w in r.get("all_cs", [])]
    if r.get("any_cs"):
        parts.append(s_has(t, r["any_cs"], lower=False))
    parts += [f"NOT contains({t}, {q(w)})" for w in r.get("none_cs", [])]
    if r.get("any_lc"):
        parts.append(s_has(t, r["any_lc"]))
    parts += [f"NOT contains(lower({t}), {q(w)})" for w in r.get("none_lc", [])]
    return "(" + " AND ".join(parts) + ")"


_DOMAIN_SCORE = "CASE " + " ".join(
    f"WHEN domain = {q(d)} THEN (" + " + ".join(s_int(_rule_sql(r)) for r in rs) + ") * 50.0" for d, rs in S.DOMAIN_RULES.items()
) + " ELSE 0.0 END"
_DOMAIN_LIST = "[" + ", ".join(q(d) for d in DOMAINS) + "]"


@query("domain_validate", compose(f"""
SELECT conv_id, turn, domain, CAST({_DOMAIN_SCORE} AS DOUBLE) AS score
FROM (SELECT *, {_DOMAIN_LIST}[conv_id % 3 + 1] AS domain FROM dresp)""", "dresp"))
def q_domain_validate(spark, sf):
    r = _resp(spark, sf).withColumn("domain", F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (F.col("conv_id") % 3 + 1).cast("int")))
    return r.select("conv_id", "turn", "domain", S.domain_validate(F.col("reply"), F.col("domain"))["score"].alias("score"))


@query("syntax_valid")
def q_syntax_valid(spark, sf):
    c = _resp(spark, sf).select("conv_id", "turn", X.extract_code_block(F.col("reply")).alias("code"))
    e = X.syntax_error(F.col("code"))
    return c.select("conv_id", "turn", F.when(e.isNull(), 100.0).otherwise(0.0).alias("syntax_score"), e.alias("error"))


def _scored_replies(spark, sf):
    r = _resp(spark, sf).withColumn("domain", F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (F.col("conv_id") % 3 + 1).cast("int")))
    r = r.withColumn("version", F.when(F.col("conv_id") % 2 == 0, "original").otherwise("improved"))
    s = S.score_reply(X.extract_code_block(F.col("reply")), F.col("domain"))
    return r.select("conv_id", "turn", "domain", "version", s.alias("s")).select("conv_id", "turn", "domain", "version", "s.*")


@query("score_reply")
def q_score_reply(spark, sf):
    return _scored_replies(spark, sf).select("conv_id", "turn", "syntax_valid", "structure_score", "domain_score",
                                             F.round("overall_score", 6).alias("overall_score"), F.size("errors").alias("n_errors"))


@query("version_compare")
def q_version_compare(spark, sf):
    return S.version_compare(_scored_replies(spark, sf))
