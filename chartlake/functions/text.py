"""Scalar text functions as Spark columns (X1-X14, P5, P9): measures, keyword flags,
pattern counts, code-block extraction, escaping, grading. Everything is a built-in
expression except NFKC normalisation and the Python syntax check, which are vectorised
pandas UDFs (the only Python in this module)."""

from __future__ import annotations

import ast
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# X5 / X6 ---------------------------------------------------------------------------
TOKENS_PER_WORD = 1 / 0.75
COST_PER_1K = 0.002


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` (Spark ``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def word_count(t: Column) -> Column:
    """Python ``len(t.split())``: runs of non-whitespace."""
    return F.size(F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda x: x != "")).cast("bigint")


def line_count(t: Column) -> Column:
    """Python ``len(t.split('\\n'))`` (empty tail counts)."""
    return F.size(F.split(F.coalesce(t, F.lit("")), "\n", -1)).cast("bigint")


def char_count(t: Column) -> Column:
    return F.length(t).cast("bigint")


def byte_count(t: Column) -> Column:
    return F.octet_length(t).cast("bigint")


def estimate_tokens(words: Column) -> Column:
    return F.floor(words / F.lit(0.75)).cast("bigint")


def estimate_cost(tokens: Column, per_1k: float = COST_PER_1K) -> Column:
    return tokens / F.lit(1000.0) * F.lit(per_1k)


# X7 ------------------------------------------------------------------------------
def has_any(t: Column, words: list[str], lower: bool = True, lt: Column | None = None) -> Column:
    """Some word occurs (in the lower-cased text unless ``lower=False``); pass ``lt`` when a
    lower-cased column is already computed."""
    s = (lt if lt is not None else F.lower(t)) if lower else t
    out = F.lit(False)
    for w in words:
        out = out | s.contains(w)
    return out


def has_header_line(t: Column) -> Column:
    """Some line starts with ``#``."""
    return t.rlike(r"(?m)^#")


def keyword_flags(t: Column, lexicon: dict[str, list[str]]) -> Column:
    return F.struct(*[has_any(t, ws).alias(name) for name, ws in lexicon.items()])


# X9 ------------------------------------------------------------------------------
def count_matches(t: Column, pattern: str, gate: list[str] | None = None, lt: Column | None = None) -> Column:
    """Non-overlapping regex matches. ``gate``: lower-case literals of which every match must
    contain one; texts containing none of them are 0 without running the regex (exact)."""
    n = F.regexp_count(t, F.lit(pattern)).cast("bigint")
    if not gate:
        return n
    return F.when(has_any(t, gate, lt=lt), n).otherwise(F.lit(0).cast("bigint"))


def count_substr(t: Column, sub: str) -> Column:
    """Non-overlapping occurrences of a literal substring (Python ``str.count``)."""
    return ((F.length(t) - F.length(F.replace(t, F.lit(sub), F.lit("")))) / len(sub)).cast("bigint")


# X8 ------------------------------------------------------------------------------
def html_escape(t: Column) -> Column:
    """``& < > " '`` escaped, ``&`` first (Python ``html.escape`` spelling)."""
    s = F.coalesce(t.cast("string"), F.lit("None"))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


# X4 ------------------------------------------------------------------------------
def strip_markdown_fence(t: Column) -> Column:
    s = F.regexp_replace(strip_ws(t), r"^```[a-zA-Z]*\n", "")
    return F.regexp_replace(strip_ws(s), r"\n```$", "")


# X1 ------------------------------------------------------------------------------
# Arrow spellings replaced by ASCII.
ARROWS = [("→", "->"), ("←", "<-"), ("⇒", "=>"), ("⇐", "<=")]


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def sanitize_text(t: Column, nfkc: bool = True) -> Column:
    s = F.coalesce(t, F.lit(""))
    if nfkc:
        s = _nfkc(s)
    for a, b in ARROWS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(s, "[\\x00-\\x08\\x0B-\\x1F\\x{10FFFF}]", "")


# X2 ------------------------------------------------------------------------------
# The patterns that decide what counts as a code block of a reply.
FENCE_RE = r"```(?:python)?\s*([\s\S]*?)```"
LIST_LINES_RE = r"(?m)^[ \t]*(?:steps2|transitions2)[\s\S]*?\][ \t]*$"


def extract_code_block(reply: Column) -> Column:
    """Inside of the first fenced block, else the ``steps2`` / ``transitions2`` line runs
    (each from its first line to the first line ending with ``]``) joined by newlines."""
    fallback = F.array_join(F.regexp_extract_all(reply, F.lit(LIST_LINES_RE), 0), "\n")
    return F.when(reply.rlike(FENCE_RE), F.regexp_extract(reply, FENCE_RE, 1)).otherwise(fallback)


# X3 ------------------------------------------------------------------------------
# Keywords of the structured-text fallback, and the patterns of the candidate blocks.
PLC_KEYWORDS = ["STEP", "STATE", "TRANSITION", "IF", "THEN", "ELSE", ":=", "="]
FENCED_BLOCK = r"```(?:\w*\n)?([\s\S]*?)```"
INDENTED_BLOCK = r"(?:^|\n)((?: {4}.+(?:\n|$))+)"
STEPS_PART = r"(?i)(steps\s*=\s*\[([\s\S]*?)\])"
TRANSITIONS_PART = r"(?i)(transitions\s*=\s*\[([\s\S]*?)\])"
VARIABLES_PART = r"(?i)(variables\s*=\s*\[([\s\S]*?)\])"
INITIAL_PART = r"(?i)(initial_step\s*=\s*['\"].+?['\"])"


def extract_blocks(reply: Column) -> Column:
    """All candidate blocks in priority order: structured chart parts (one block), fenced
    blocks, 4-space indented blocks; keyword lines only when nothing else was found."""
    out = sanitize_text(reply, nfkc=False)
    fenced = F.transform(F.regexp_extract_all(out, F.lit(FENCED_BLOCK), 1), strip_ws)
    ind = F.regexp_extract_all(out, F.lit(INDENTED_BLOCK), 1)
    ind = F.transform(ind, lambda b: strip_ws(F.regexp_replace(b, r"(?m)^ {4}", "")))
    part = lambda p: F.regexp_extract(out, p, 1)
    steps = part(STEPS_PART)
    parts = F.filter(F.array(
        strip_ws(steps),
        strip_ws(part(TRANSITIONS_PART)),
        strip_ws(part(VARIABLES_PART)),
        strip_ws(part(INITIAL_PART)),
    ), lambda x: x != "")
    sfc = F.when(steps != "", F.array(F.array_join(parts, "\n\n"))).otherwise(F.array().cast("array<string>"))
    blocks = F.concat(sfc, F.filter(fenced, lambda x: x != ""), F.filter(ind, lambda x: x != ""))
    lines = F.filter(F.split(out, r"\r\n|\r|\n"), lambda ln: has_any(ln, PLC_KEYWORDS, lower=False))
    return F.when((F.size(blocks) == 0) & (F.size(lines) >= 3), F.array(F.array_join(lines, "\n"))).otherwise(blocks)


# X14 -----------------------------------------------------------------------------
def parse_code_reply(reply: Column) -> Column:
    """``steps2`` / ``transitions2`` lists of a reply as typed arrays plus a status; the
    reply is parsed as data, never executed."""
    code = extract_code_block(reply)
    s = F.regexp_extract(code, r"steps2\s*=\s*(\[[\s\S]*?\])\s*(?:\n|$)", 1)
    t = F.regexp_extract(code, r"transitions2\s*=\s*(\[[\s\S]*?\])\s*(?:\n|$)", 1)
    steps = F.from_json(F.when(s != "", s), "array<struct<name:string,function:string>>", {"allowSingleQuotes": "true"})
    trans = F.from_json(F.when(t != "", t), "array<struct<src:string,tgt:string,guard:string>>", {"allowSingleQuotes": "true"})
    status = (
        F.when(code == "", F.lit("no_code_block"))
        .when(steps.isNull() | trans.isNull(), F.lit("missing_lists"))
        .otherwise(F.lit("ok"))
    )
    return F.struct(status.alias("status"), steps.alias("steps2"), trans.alias("transitions2"))


# P5 ------------------------------------------------------------------------------
def api_error_flag(reply: Column) -> Column:
    lo = F.lower(reply)
    return lo.contains("error") & (lo.contains("403") | lo.contains("api key") | lo.contains("not found"))


# P9 ------------------------------------------------------------------------------
def grade(score: Column, thresholds: list[tuple[float, str]], default: str, strict: bool = False) -> Column:
    """Label from the first threshold reached (``>=``, or ``>`` when ``strict``)."""
    out = None
    for th, label in thresholds:
        cond = score > th if strict else score >= th
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


# X13 -----------------------------------------------------------------------------
def _syntax_error(code: str | None) -> str | None:
    try:
        ast.parse(code or "")
        return None
    except (SyntaxError, ValueError) as e:
        return f"Syntax Error: {e}"


@F.pandas_udf(StringType())
def syntax_error(code: pd.Series) -> pd.Series:
    """Parse-only Python syntax check (never executes); NULL when the code parses."""
    return code.map(_syntax_error)
