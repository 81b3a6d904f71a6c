"""Composite text scorers and their roll-ups.

Every scorer is one projection: measures (X5), keyword flags (X7) and pattern counts (X9)
feed sums of ``when`` terms, so a whole corpus is scored in a single scan. Lexicons and
thresholds are parameters (``F1 rule_tables``); the defaults are the fixed values below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.functions import text as X
from chartlake.operators.ranking import positions

# ---- fixed values ------------------------------------------------------------------
STRATEGIES = ["Cost-Effective", "Sweet Spot", "Accuracy-Effective", "Semantic-View"]

# T1 / T2 feature words (lower-case containment)
FEATURES = {
    "examples": ["example", "sample"],
    "requirements": ["requirement", "must"],
    "guidelines": ["guideline", "rule"],
    "error_handling": ["error", "exception"],
    "validation": ["validat", "verify"],
    "documentation": ["docstring", "comment"],
}
SEMANTIC_WORDS = ["semantic", "ontology", "knowledge"]

# T3 / T4 quality patterns (searched case-insensitively, all literal alternatives)
PATTERNS = {
    "examples": ["example"],
    "instructions": ["instruction"],
    "validation": ["validation", "checklist"],
    "requirements": ["requirement"],
    "guidelines": ["guideline"],
    "best_practices": ["best practice"],
    "error_handling": ["error", "exception"],
    "success_criteria": ["success", "criteria"],
    "deliverables": ["deliverable", "output"],
    "documentation": ["documentation", "docstring"],
}
HEADER_RE = r"(?m)^#+\s+\w+"
BULLET_RE = r"(?m)^\s*[-*]\s+\*\*"
CODE_BLOCK_RE = r"(?s)```\w*\n.*?\n```"
STRUCTURE_SECTIONS = ["requirements", "guidelines", "validation", "deliverables", "examples"]
CONTENT_INDICATORS = [
    ("best_practices", 15), ("error_handling", 15), ("success_criteria", 15), ("documentation", 10),
    ("validation", 15), ("examples", 10), ("instructions", 10), ("requirements", 10),
]
PROFESSIONAL_TERMS = [
    "implementation", "specification", "framework", "methodology", "validation", "verification",
    "optimization", "integration", "architecture", "design", "quality", "standards", "compliance",
]
EXPLANATION_RES = [
    r"(?i)(explains?|explanation|clarifies?|clarification)",
    r"(?i)(describes?|description|details?|detailed)",
    r"(?i)(specifies?|specification|defines?|definition)",
    r"(?i)(outlines?|overview|summary|summarizes?)",
]
STEP_RES = [r"(?i)\d+\.\s+\*\*.*?\*\*", r"(?i)Step\s+\d+", r"(?i)Phase\s+\d+", r"(?i)###\s+\d+\."]
# literal stems every match of the pattern at the same position contains (exact prefilters)
EXPLANATION_GATES = [["expla", "clarif"], ["descri", "detail"], ["specif", "defin"], ["outline", "overview", "summar"]]
STEP_GATES = [["**"], ["step"], ["phase"], ["###"]]
HEADER_GATE, BULLET_GATE, CODE_GATE = ["#"], ["**"], ["```"]
MARKDOWN_ELEMENTS = ["**", "`", "```", "###", "####", "- **", "1. **"]
# Required elements chosen by file-name pattern (first match wins; last row = default)
COMPLETENESS_RULES = [
    ("iterative_prompting", ["z3", "equivalence", "path", "behavioral", "sfc1", "sfc2"]),
    ("prompt_refiner", ["refin", "bug", "validation", "quality", "integration"]),
    ("PromptForUpgrade", ["upgrade", "rule", "factorial", "hex", "hardware", "string"]),
    ("PythonCodePrompt", ["class", "file", "exception", "validation", "documentation", "type"]),
    ("", ["requirement", "guideline", "validation", "output", "example"]),
]
# T8
QUICK_SECTIONS = ["requirement", "guideline", "validation", "example", "deliverable"]
QUICK_TERMS = ["implementation", "validation", "framework", "specification"]
# T9
FW_QUALITY = ["requirement", "guideline", "validation", "example", "best practice"]
FW_DOCS = ["explanation", "instruction", "specification", "framework"]
FW_TECH = ["implementation", "validation", "error", "success", "criteria"]
# P9 grade scales
GRADE_REPORT = [(90, "excellent"), (75, "good"), (60, "adequate")]
GRADE_STATUS = [(85, "EXCELLENT"), (75, "GOOD"), (60, "ADEQUATE")]
AB_CONCLUSION = [(40, "OUTSTANDING"), (25, "EXCELLENT"), (15, "GOOD")]
# P10 scenario -> strategy
SCENARIOS = [
    ("High-Volume Production", "Cost-Effective"),
    ("General Production Use", "Sweet Spot"),
    ("Critical Applications", "Accuracy-Effective"),
    ("Development/Testing", "Cost-Effective"),
    ("Client-Facing Applications", "Sweet Spot"),
]
# J9 / A7 use cases (name, prompts per month)
USE_CASES = [("Development Testing", 100), ("Production App", 1000), ("Enterprise Scale", 10000)]


def extend(lex: dict[str, list[str]], extra: dict[str, list[str]] | None) -> dict[str, list[str]]:
    if not extra:
        return lex
    return {k: v + [w for w in extra.get(k, []) if w not in v] for k, v in lex.items()}


def _pts(cond: Column, pts) -> Column:
    return F.when(cond, F.lit(pts)).otherwise(F.lit(0))


def _bands(x: Column, bands: list[tuple[float, float]], default=0, strict=True) -> Column:
    out = None
    for th, pts in bands:
        c = x > th if strict else x >= th
        out = F.when(c, F.lit(pts)) if out is None else out.when(c, F.lit(pts))
    return out.otherwise(F.lit(default))


def _issues(*pairs) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in pairs]), lambda x: x.isNotNull())


# T1 ------------------------------------------------------------------------------
def score_cost_accuracy(t: Column, strategy: Column, features=None, semantic=None) -> Column:
    fe = features or FEATURES
    sem = semantic or SEMANTIC_WORDS
    words = X.word_count(t)
    tokens = X.estimate_tokens(words)
    cost = X.estimate_cost(tokens)
    lo = F.lower(t)
    f = {k: X.has_any(t, v, lt=lo) for k, v in fe.items()}
    heads = X.has_header_line(t)
    code = t.contains("```")
    edv = f["error_handling"] & f["validation"] & f["documentation"]
    raw = (
        _bands(words, [(400, 15), (200, 10), (100, 5)])
        + _pts(heads, 15) + _pts(f["examples"], 10) + _pts(f["requirements"], 10) + _pts(f["guidelines"], 10)
        + _pts(f["error_handling"], 10) + _pts(f["validation"], 10) + _pts(f["documentation"], 5) + _pts(code, 10)
        + F.when(strategy == "Cost-Effective", F.when(words > 300, -5).when(words < 150, 5).otherwise(0))
        .when(strategy == "Sweet Spot", _pts((words >= 200) & (words <= 600), 10))
        .when(strategy == "Accuracy-Effective", _pts(edv, 15))
        .when(strategy == "Semantic-View", _pts(edv, 20) + _pts(X.has_any(t, sem), 10))
        .otherwise(0)
    )
    return F.struct(
        words.alias("word_count"), X.line_count(t).alias("line_count"), X.char_count(t).alias("char_count"),
        tokens.alias("token_count"), cost.alias("cost_estimate"),
        F.least(raw, F.lit(100)).alias("quality_score"),
        (raw / F.greatest(tokens, F.lit(1))).alias("quality_per_token"),
        (raw / F.greatest(cost, F.lit(0.001))).alias("cost_efficiency"),
        heads.alias("has_headers"), f["examples"].alias("has_examples"), f["requirements"].alias("has_requirements"),
        f["guidelines"].alias("has_guidelines"), f["error_handling"].alias("has_error_handling"),
        f["validation"].alias("has_validation"), f["documentation"].alias("has_documentation"),
        code.alias("has_code_blocks"),
    )


# T2 ------------------------------------------------------------------------------
def score_ab(t: Column, is_original: Column, features=None) -> Column:
    fe = features or FEATURES
    words = X.word_count(t)
    f = {k: X.has_any(t, v) for k, v in fe.items()}
    heads = X.has_header_line(t)
    raw = (
        _bands(words, [(500, 20), (200, 10), (100, 5)])
        + _pts(heads, 15) + _pts(f["examples"], 10) + _pts(f["requirements"], 10) + _pts(f["guidelines"], 10)
        + _pts(f["error_handling"], 10) + _pts(f["validation"], 10) + _pts(f["documentation"], 5)
        + _pts(t.contains("```"), 10) + _pts(X.has_any(t, ["class"]), 5) + _pts(X.has_any(t, ["type"]), 5)
    )
    issues = _issues(
        (~heads, "Lacks structured headers and organization"),
        (~f["requirements"], "Missing clear requirements specification"),
        (~f["error_handling"], "No error handling guidance"),
        (~f["validation"], "Lacks validation instructions"),
        (words < 200, "Very brief, lacks comprehensive guidance"),
        (~f["documentation"], "No documentation standards specified"),
    )
    improvements = _issues(
        (heads, "Well-structured with clear headers"),
        (f["requirements"], "Comprehensive requirements specification"),
        (f["error_handling"], "Includes error handling guidance"),
        (f["validation"], "Validation and testing instructions"),
        (words > 500, "Comprehensive and detailed guidance"),
        (f["documentation"], "Documentation standards included"),
    )
    empty = F.array().cast("array<string>")
    return F.struct(
        F.least(raw, F.lit(100)).alias("quality_score"), words.alias("word_count"),
        X.line_count(t).alias("line_count"), X.char_count(t).alias("char_count"), heads.alias("has_structure"),
        F.when(is_original, issues).otherwise(empty).alias("issues"),
        F.when(is_original, empty).otherwise(improvements).alias("improvements"),
    )


# T3 ------------------------------------------------------------------------------
def score_structure(t: Column, patterns=None, lt: Column | None = None) -> Column:
    pa = patterns or PATTERNS
    h = X.count_matches(t, HEADER_RE, HEADER_GATE, lt)
    b = X.count_matches(t, BULLET_RE, BULLET_GATE, lt)
    cb = X.count_matches(t, CODE_BLOCK_RE, CODE_GATE, lt)
    sec = sum(X.has_any(t, pa[s], lt=lt).cast("int") for s in STRUCTURE_SECTIONS)
    n = X.char_count(t)
    score = (
        F.when(h >= 5, 15).when(h >= 3, 10).otherwise(5)
        + F.when(b >= 10, 10).when(b >= 5, 7).otherwise(3)
        + F.when(cb >= 3, 10).when(cb >= 1, 5).otherwise(0)
        + F.when(sec >= 4, 15).when(sec >= 3, 10).otherwise(5)
        + F.when(n > 5000, 10).when(n > 2000, 7).otherwise(3)
    )
    issues = _issues(
        (h < 3, "Limited structural organization"),
        (b < 5, "Limited use of structured formatting"),
        (cb < 1, "No code examples provided"),
        (sec < 3, F.concat(F.lit("Limited coverage ("), sec.cast("string"), F.lit("/5 key sections)"))),
        (n <= 2000, "May be too brief for comprehensive guidance"),
    )
    strengths = F.size(F.filter(F.array(h >= 3, b >= 5, cb >= 1, sec >= 3, n > 2000), lambda x: x)) + sec
    return F.struct(F.least(score, F.lit(100)).cast("double").alias("score"), issues.alias("issues"),
                    strengths.cast("int").alias("n_strengths"))


# T4 ------------------------------------------------------------------------------
def score_content(t: Column, patterns=None, terms=None, lt: Column | None = None) -> Column:
    pa = patterns or PATTERNS
    te = terms or PROFESSIONAL_TERMS
    lo = lt if lt is not None else F.lower(t)
    found = {k: X.has_any(t, pa[k], lt=lo) for k, _ in CONTENT_INDICATORS}
    pc = sum(lo.contains(w).cast("int") for w in te)
    score = sum(_pts(found[k], p) for k, p in CONTENT_INDICATORS) + F.when(pc >= 10, 10).when(pc >= 5, 5).otherwise(0)
    issues = _issues(*[(~found[k], f"Missing {k.replace('_', ' ')}") for k, _ in CONTENT_INDICATORS],
                     (pc < 5, F.concat(F.lit("Limited professional terminology ("), pc.cast("string"), F.lit(" terms)"))))
    strengths = sum(found[k].cast("int") for k, _ in CONTENT_INDICATORS) + (pc >= 5).cast("int")
    return F.struct(F.least(score, F.lit(100)).cast("double").alias("score"), issues.alias("issues"),
                    strengths.cast("int").alias("n_strengths"))


# T5 ------------------------------------------------------------------------------
def score_documentation(t: Column, explanation_res=None, lt: Column | None = None) -> Column:
    if explanation_res:
        ex = sum(X.count_matches(t, p) for p in explanation_res)
    else:
        ex = sum(X.count_matches(t, p, g, lt) for p, g in zip(EXPLANATION_RES, EXPLANATION_GATES))
    st = sum(X.count_matches(t, p, g, lt) for p, g in zip(STEP_RES, STEP_GATES))
    fmt = sum(_pts(t.contains(e), 5) for e in MARKDOWN_ELEMENTS)
    ln = X.line_count(t)
    score = (
        F.when(ex >= 15, 20).when(ex >= 10, 15).when(ex >= 5, 10).otherwise(0)
        + F.when(st >= 5, 20).when(st >= 3, 15).otherwise(5)
        + F.least(fmt, F.lit(40))
        + F.when(ln >= 100, 20).when(ln >= 50, 15).otherwise(5)
    )
    issues = _issues(
        (ex < 5, F.concat(F.lit("Limited explanatory content ("), ex.cast("string"), F.lit(" instances)"))),
        (st < 3, F.concat(F.lit("Limited step-by-step guidance ("), st.cast("string"), F.lit(" steps)"))),
        (fmt < 20, "Limited markdown formatting"),
        (ln < 50, "Documentation may be too brief"),
    )
    strengths = (ex >= 5).cast("int") + (st >= 3).cast("int") + (fmt >= 20).cast("int") + (ln >= 50).cast("int")
    return F.struct(F.least(score, F.lit(100)).cast("double").alias("score"), issues.alias("issues"),
                    strengths.cast("int").alias("n_strengths"), ex.alias("explanations"), st.alias("steps"))


# T6 ------------------------------------------------------------------------------
def completeness_elements(name: Column, rules=None) -> Column:
    """Required-element list of the first rule whose pattern occurs in the file name (the
    last rule, with an empty pattern, is the default)."""
    out = None
    for pat, els in rules or COMPLETENESS_RULES:
        arr = F.array(*[F.lit(e) for e in els])
        out = F.when(name.contains(pat), arr) if out is None else out.when(name.contains(pat), arr)
    return out


def score_completeness(t: Column, name: Column, rules=None, lt: Column | None = None) -> Column:
    lo = lt if lt is not None else F.lower(t)
    chosen = completeness_elements(name, rules)
    found = F.filter(chosen, lambda e: lo.contains(e))
    n = F.size(chosen)
    k = F.size(found)
    score = F.least(k * (F.lit(100.0) / n), F.lit(100.0))
    issues = F.concat(
        F.transform(F.filter(chosen, lambda e: ~lo.contains(e)), lambda e: F.concat(F.lit("Missing "), e)),
        F.when(k < n * 0.8, F.array(F.lit("Incomplete domain coverage"))).otherwise(F.array().cast("array<string>")),
    )
    cov = F.when(k == n, "complete").when(k >= n * 0.8, "good").otherwise("incomplete")
    return F.struct(score.alias("score"), issues.alias("issues"),
                    (k + (k >= n * 0.8).cast("int")).cast("int").alias("n_strengths"), cov.alias("coverage"))


# T7 ------------------------------------------------------------------------------
def score_overall(docs: DataFrame, text_col: str = "text", name_col: str = "file_name", patterns=None,
                  terms=None, rules=None) -> DataFrame:
    t = F.col(text_col)
    lt = F.col("_lt")
    parts = {"structure": score_structure(t, patterns, lt), "content": score_content(t, patterns, terms, lt),
             "documentation": score_documentation(t, None, lt), "completeness": score_completeness(t, F.col(name_col), rules, lt)}
    # a column for each field, not one struct a part: what a caller does not read is not computed
    d = docs.withColumn("_lt", F.lower(t)).select(
        "*", *[part[f].alias(f"_{p}_{f}") for p, part in parts.items() for f in ("score", "issues", "n_strengths")])
    return d.select(
        *docs.columns,
        X.byte_count(t).alias("file_size"), X.line_count(t).alias("line_count"), X.word_count(t).alias("word_count"),
        *[F.col(f"_{p}_score").alias(f"{p}_score") for p in parts],
        (sum(F.col(f"_{p}_score") for p in parts) / 4).alias("overall_score"),
        F.concat(*[F.col(f"_{p}_issues") for p in parts]).alias("issues"),
        sum(F.col(f"_{p}_n_strengths") for p in parts).cast("int").alias("n_strengths"),
    )


# T8 ------------------------------------------------------------------------------
def score_quick(t: Column, sections=None, terms=None) -> Column:
    se = sections or QUICK_SECTIONS
    te = terms or QUICK_TERMS
    found = sum(F.lower(t).contains(s).cast("int") for s in se)
    ft = sum(F.lower(t).contains(s).cast("int") for s in te)
    hashes = X.count_substr(t, "#")
    n = X.char_count(t)
    score = (
        _pts(hashes >= 5, 20) + _pts(t.contains("**"), 10) + _pts(t.contains("```"), 15) + found * 10
        + F.when(n > 3000, 15).when(n > 1000, 10).otherwise(0) + ft * 5
    )
    issues = _issues(
        (hashes < 5, "Limited header structure"), (~t.contains("**"), "No bold formatting"),
        (~t.contains("```"), "No code blocks"),
        (found < 3, F.concat(F.lit("Only "), found.cast("string"), F.lit("/5 key sections found"))),
        (n <= 1000, "Prompt may be too brief"),
    )
    return F.struct(F.least(score, F.lit(100)).alias("score"), issues.alias("issues"))


# T9 ------------------------------------------------------------------------------
def score_framework(t: Column, quality=None, docs=None, tech=None) -> Column:
    h = X.count_matches(t, r"(?m)^#+\s+")
    fq = sum(F.lower(t).contains(s).cast("int") for s in (quality or FW_QUALITY))
    fd = sum(F.lower(t).contains(s).cast("int") for s in (docs or FW_DOCS))
    ft = sum(F.lower(t).contains(s).cast("int") for s in (tech or FW_TECH))
    score = F.when(h >= 5, 25).when(h >= 3, 15).otherwise(5) + fq * 5 + fd * 6 + ft * 5
    return F.struct(
        F.least(score, F.lit(100)).cast("double").alias("score"),
        F.when(h >= 5, "excellent").when(h >= 3, "good").otherwise("limited").alias("structure"),
        (fq >= 4).alias("comprehensive_content"), (fd >= 3).alias("well_documented"), (ft >= 4).alias("technically_complete"),
    )


# A6 ------------------------------------------------------------------------------
def best_by_metric(scored: DataFrame, group: str = "prompt_type") -> DataFrame:
    """Per group: best quality, cheapest, most efficient; ties go to the earlier strategy
    (then the smaller doc id)."""
    so = F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("strategy"))
    s = scored.withColumn("_so", so)

    shown = [c for c in ("strategy", "doc_id", "quality_score", "cost_estimate", "quality_per_token")]

    def pick(first, name):
        # the least row by (first, strategy order, doc id), combined in each task before the shuffle
        row = F.struct(first.isNull().alias("none"), first.alias("first"), F.col("_so").alias("so"), F.col("doc_id").alias("id"),
                       F.struct(*shown).alias("row"))
        return F.min(row).alias(name)

    best = s.groupBy(group).agg(
        pick(-F.col("quality_score"), "best_quality"), pick(F.col("cost_estimate"), "most_cost_effective"),
        pick(-F.col("quality_per_token"), "best_efficiency"))
    names = ("best_quality", "most_cost_effective", "best_efficiency")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"{n}.row").alias("row")) for n in names]))
    return best.select(group, each.alias("e")).select(group, "e.metric", *[F.col(f"e.row.{c}").alias(c) for c in shown])


# A8 / J7 ---------------------------------------------------------------------------
def ab_pairs(docs: DataFrame) -> DataFrame:
    """original (version = original) joined with its enhanced counterpart by pair key; a
    missing side reads as the ``FILE NOT FOUND`` text."""
    o = docs.filter(F.col("version") == "original").select("pair_key", F.col("doc_id").alias("orig_id"), F.col("text").alias("orig_text"))
    e = docs.filter(F.col("version") == "enhanced").select("pair_key", F.col("doc_id").alias("enh_id"), F.col("text").alias("enh_text"))
    j = o.join(e, "pair_key", "full")
    nf = lambda side: F.concat(F.lit(f"FILE NOT FOUND: {side}/"), F.col("pair_key").cast("string"))
    return j.select("pair_key", "orig_id", "enh_id",
                    F.coalesce("orig_text", nf("original")).alias("orig_text"),
                    F.coalesce("enh_text", nf("enhanced")).alias("enh_text"))


def ab_results(pairs: DataFrame, features=None) -> DataFrame:
    o = score_ab(F.col("orig_text"), F.lit(True), features)
    e = score_ab(F.col("enh_text"), F.lit(False), features)
    p = pairs.select("pair_key", o.alias("o"), e.alias("e"))
    return p.select(
        "pair_key", F.col("o.quality_score").alias("orig_score"), F.col("e.quality_score").alias("enh_score"),
        (F.col("e.quality_score") - F.col("o.quality_score")).alias("quality_gain"),
        (F.col("e.word_count") / F.greatest(F.col("o.word_count"), F.lit(1))).alias("word_count_ratio"),
        (F.col("e.has_structure") & ~F.col("o.has_structure")).alias("structure_improved"),
        F.size("o.issues").alias("orig_issues"), F.size("e.improvements").alias("enh_improvements"),
    )


def ab_summary(res: DataFrame) -> DataFrame:
    a = res.agg(
        F.count(F.lit(1)).alias("tests_run"), F.avg("orig_score").alias("average_original_score"),
        F.avg("enh_score").alias("average_enhanced_score"),
        (F.avg((F.col("quality_gain") > 0).cast("double")) * 100).alias("success_rate"),
    )
    imp = F.col("average_enhanced_score") - F.col("average_original_score")
    return a.select(
        "tests_run", "average_original_score", "average_enhanced_score", imp.alias("overall_improvement"),
        F.when(F.col("average_original_score") > 0, imp / F.col("average_original_score") * 100).otherwise(0.0).alias("improvement_percentage"),
        "success_rate", X.grade(imp, AB_CONCLUSION, "MARGINAL", strict=True).alias("conclusion"),
    )


# A10 / R1 / R2 / A11 / A12 -----------------------------------------------------------
def quality_report(scored: DataFrame) -> DataFrame:
    s = F.col("overall_score")
    return scored.agg(
        F.count(F.lit(1)).alias("total_files"), F.avg(s).alias("average_score"), F.avg("file_size").alias("average_size"),
        F.avg("line_count").alias("average_lines"), F.sum(F.size("issues")).alias("total_issues"),
        F.sum("n_strengths").alias("total_strengths"),
        F.count_if(s >= 90).alias("excellent_files"), F.count_if((s >= 75) & (s < 90)).alias("good_files"),
        F.count_if((s >= 60) & (s < 75)).alias("adequate_files"), F.count_if(s < 60).alias("needs_improvement"),
    )


RANKINGS = [("by_overall_score", "overall_score"), ("by_structure", "structure_score"), ("by_content", "content_score"),
            ("by_documentation", "documentation_score"), ("by_completeness", "completeness_score")]


def rank_by_each_score(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Five descending rankings in long form; ties keep input (key) order."""
    st = F.explode(F.array(*[F.struct(F.lit(n).alias("ranking"), F.col(c).cast("double").alias("score")) for n, c in RANKINGS]))
    long = scored.select(key, st.alias("s")).select(key, "s.ranking", "s.score")
    return positions(long, ["ranking"], [F.desc("score"), F.col(key)])


def top_k(quick: DataFrame, k: int = 3, key: str = "doc_id") -> DataFrame:
    """Top k by quick score (TakeOrdered, ties by key) with the first three issues."""
    top = quick.orderBy(F.desc("score"), key).limit(k)
    n = F.size("issues")
    return top.select(key, "score", F.slice("issues", 1, 3).alias("first_issues"),
                      F.when(n > 3, F.concat(F.lit("... and "), (n - 3).cast("string"), F.lit(" more"))).alias("more"))


def run_quality_summary(quick: DataFrame, size_col: str = "size_kb") -> DataFrame:
    a = quick.agg(F.count(F.lit(1)).alias("files"), F.avg("score").alias("average_score"),
                  F.sum(size_col).alias("total_kb"), F.avg(size_col).alias("average_kb"),
                  F.sum(F.size("issues")).alias("total_issues"))
    return a.select("*", (F.col("total_kb") / (F.col("files") * 0.5)).alias("enhancement_factor"),
                    X.grade(F.col("average_score"), GRADE_STATUS, "NEEDS_IMPROVEMENT").alias("status"))


def effect_summary(pairs: DataFrame, quality=None, docs=None, tech=None) -> DataFrame:
    o = score_framework(F.col("orig_text"), quality, docs, tech)
    e = score_framework(F.col("enh_text"), quality, docs, tech)
    p = pairs.select("pair_key", o["score"].alias("o"), e["score"].alias("e"),
                     X.char_count(F.col("orig_text")).alias("os"), X.char_count(F.col("enh_text")).alias("es"))
    return p.agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(F.col("e") - F.col("o")).alias("average_quality_improvement"),
        F.avg(F.col("es") / F.col("os")).alias("average_size_factor"),
        F.avg(F.when(F.col("o") > 0, (F.col("e") - F.col("o")) / F.col("o") * 100).otherwise(0.0)).alias("average_improvement_pct"),
    )


# A7 / J9 / P10 ---------------------------------------------------------------------
def strategy_costs(scored: DataFrame) -> DataFrame:
    return scored.groupBy("strategy").agg(
        F.avg("token_count").alias("tokens_per_prompt"), F.avg("cost_estimate").alias("cost_per_prompt"),
        F.avg("quality_score").alias("mean_quality"), F.count(F.lit(1)).alias("n_docs"))


def cost_projection(costs: DataFrame, use_cases=None) -> DataFrame:
    """Strategy x use-case grid (the use-case table has a fixed handful of rows)."""
    uc = F.explode(F.array(*[F.struct(F.lit(n).alias("use_case"), F.lit(v).alias("monthly_prompts"))
                             for n, v in (use_cases or USE_CASES)]))
    g = costs.select("*", uc.alias("u")).select("*", "u.use_case", "u.monthly_prompts").drop("u")
    return g.select("strategy", "use_case", "monthly_prompts", "cost_per_prompt",
                    (F.col("cost_per_prompt") * F.col("monthly_prompts")).alias("monthly_cost"),
                    (F.col("cost_per_prompt") * F.col("monthly_prompts") * 12).alias("annual_cost"))


def scenario_recommendation(costs: DataFrame, scenarios=None) -> DataFrame:
    sc = costs.sparkSession.createDataFrame(scenarios or SCENARIOS, "scenario string, strategy string")
    return F.broadcast(sc).join(costs, "strategy", "left").select(
        "scenario", "strategy", "cost_per_prompt", "mean_quality")


# X11 -----------------------------------------------------------------------------
DICT_STRUCTURE_RE = r"(?s)\{\s*[\"']name[\"']\s*:\s*[\"'].*?[\"'].*?\}"


def chart_blocks_validate(code: Column) -> Column:
    """0-100 structure score (4 x 25) and the issue list of a generated chart reply."""
    has_eq = code.contains("=")
    c1 = code.contains("steps") & has_eq
    c2 = code.contains("transitions") & has_eq
    c3 = code.rlike(DICT_STRUCTURE_RE)
    c4 = code.contains('"name"') | code.contains("'name'")
    score = (_pts(c1, 25) + _pts(c2, 25) + _pts(c3, 25) + _pts(c4, 25)).cast("double")
    issues = _issues((~c1, "Missing 'steps' definition"), (~c2, "Missing 'transitions' definition"),
                     (~c3, "Invalid dictionary structure"), (~c4, "Missing proper key quoting"))
    return F.struct(score.alias("score"), issues.alias("issues"))


# X12 -----------------------------------------------------------------------------
# Per-domain feature rules. Each rule: case-sensitive all / any / none word lists,
# lower-case any / none lists, and the issue text when it fails.
DOMAIN_RULES = {
    "factorial": [
        dict(any_lc=["temp"], issue="Missing 'temp' variable for loop tracking"),
        dict(any_lc=["cleanup", "reset"], issue="Missing cleanup mechanism"),
    ],
    "dec2hex_r1": [
        dict(all_cs=["mod 16"], none_cs=["mod 15"], issue="Incorrect modulo operation (should be mod 16)"),
        dict(none_lc=["float"], none_cs=["/"], issue="Contains floating point operations"),
    ],
    "dec2hex_r2": [
        dict(any_cs=['"Error"', "'Error'"], issue="Missing string-based error handling"),
        dict(all_cs=["HexValue"], any_lc=["string", "str"], issue="HexValue not properly handled as string"),
    ],
}


def _rule_ok(code: Column, r: dict) -> Column:
    lo = F.lower(code)
    ok = F.lit(True)
    for w in r.get("all_cs", []):
        ok = ok & code.contains(w)
    if r.get("any_cs"):
        ok = ok & X.has_any(code, r["any_cs"], lower=False)
    for w in r.get("none_cs", []):
        ok = ok & ~code.contains(w)
    if r.get("any_lc"):
        ok = ok & X.has_any(lo, r["any_lc"], lower=False)
    for w in r.get("none_lc", []):
        ok = ok & ~lo.contains(w)
    return ok


def domain_validate(code: Column, domain: Column, n_features: Column | int = 2, rules=None) -> Column:
    """Points (100 / number of expected features) per satisfied domain rule, plus issues."""
    rules = rules or DOMAIN_RULES
    per = F.lit(100.0) / n_features if isinstance(n_features, int) else F.lit(100.0) / n_features
    score = F.lit(0.0)
    issues = F.array().cast("array<string>")
    for dom, rs in rules.items():
        d_score = sum(_pts(_rule_ok(code, r), 1) for r in rs) * per
        d_issues = _issues(*[(~_rule_ok(code, r), r["issue"]) for r in rs])
        score = F.when(domain == dom, d_score).otherwise(score)
        issues = F.when(domain == dom, d_issues).otherwise(issues)
    return F.struct(score.cast("double").alias("score"), issues.alias("issues"))


# T10 / A9 ----------------------------------------------------------------------------
def score_reply(code: Column, domain: Column) -> Column:
    """Mean of syntax (100 / 0), structure and domain scores, with all errors."""
    err = X.syntax_error(code)
    syn = F.when(err.isNull(), 100.0).otherwise(0.0)
    st = chart_blocks_validate(code)
    dm = domain_validate(code, domain)
    errors = F.concat(F.when(err.isNull(), F.array().cast("array<string>")).otherwise(F.array(err)), st["issues"], dm["issues"])
    return F.struct(syn.alias("syntax_valid"), st["score"].alias("structure_score"), dm["score"].alias("domain_score"),
                    ((syn + st["score"] + dm["score"]) / 3).alias("overall_score"), errors.alias("errors"))


def version_compare(scored: DataFrame, version_col: str = "version", original: str = "original") -> DataFrame:
    """Mean score per version, improvement %, error totals and reduction, recommendation."""
    is_o = F.col(version_col) == original
    a = scored.agg(
        F.avg(F.when(is_o, F.col("overall_score"))).alias("original_score"),
        F.avg(F.when(~is_o, F.col("overall_score"))).alias("improved_score"),
        F.sum(F.when(is_o, F.size("errors"))).alias("original_errors"),
        F.sum(F.when(~is_o, F.size("errors"))).alias("improved_errors"),
    )
    pct = F.when(F.col("original_score") > 0,
                 (F.col("improved_score") - F.col("original_score")) / F.col("original_score") * 100).otherwise(0.0)
    return a.select("*", pct.alias("improvement_percentage"),
                    (F.col("original_errors") - F.col("improved_errors")).alias("error_reduction"),
                    X.grade(pct, [(20, "deploy"), (10, "refine")], "review", strict=True).alias("recommendation"))
