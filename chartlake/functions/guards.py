"""Guard and assignment expressions as column / table jobs.

Guards are normalised with an ordered ``regexp_replace`` chain (E2), split into DNF atoms
(E3, flat guards in Spark SQL; guards with parentheses go through one vectorised helper over
the *distinct* guard texts), and turned into an order-free text key (E4) so that "same
condition" becomes an equi-join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chartlake.charts import Charts
from chartlake.session import stored

# The name heuristic used when usage does not decide a variable's type
# (checked in this order, Bool list first, default Bool).
BOOL_NAME_HINTS = ["is_", "has_", "_ok", "_done", "_valid", "_active", "_enabled", "_error", "_alarm", "check", "start", "stop"]
INT_NAME_HINTS = ["cnt", "count", "timer", "num", "val", "level", "temp", "pressure", "speed"]
# Whole guards meaning "always true".
TRUE_GUARDS = ["", "true", "always", "init"]

_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
_STRING = r"'[^' ()]*'|\"[^\" ()]*\""
ATOM_RE = rf"^(not )?([A-Za-z_][A-Za-z0-9_.]*|{_NUMBER}|{_STRING})(?: (==|!=|>=|<=|>|<) (.+))?$"
FLIP = {">": "<", "<": ">", ">=": "<=", "<=": ">=", "==": "==", "!=": "!="}
NEGATE = {">": "<=", "<": ">=", ">=": "<", "<=": ">", "==": "!=", "!=": "=="}


# E1 ------------------------------------------------------------------------------
def assignments(steps: DataFrame) -> DataFrame:
    """``lhs := rhs`` fragments of every step function in order:
    ``(model_id, name, pos, lhs, rhs)``; fragments without ``:=`` are ignored."""
    frags = F.filter(
        F.transform(F.split(F.coalesce(F.col("function"), F.lit("")), ";"), lambda s: F.trim(s)),
        lambda s: s.contains(":="),
    )
    return steps.select("model_id", "name", F.posexplode(frags).alias("pos", "a")).select(
        "model_id", "name", "pos",
        F.trim(F.substring_index("a", ":=", 1)).alias("lhs"),
        F.trim(F.expr("substr(a, instr(a, ':=') + 2)")).alias("rhs"),
    )


# E2 ------------------------------------------------------------------------------
def normalize_guard(g: Column) -> Column:
    """IEC / C / Python spellings to one lower-case infix form with single spaces."""
    s = F.coalesce(g, F.lit(""))
    s = F.regexp_replace(s, r"[\r\n\t]+", " ")
    s = F.regexp_replace(s, r"'(?i:true)'|\"(?i:true)\"", " true ")
    s = F.regexp_replace(s, r"'(?i:false)'|\"(?i:false)\"", " false ")
    s = F.regexp_replace(s, "&&", " and ")
    s = F.regexp_replace(s, r"\|\|", " or ")
    s = F.regexp_replace(s, "<>", " != ")
    s = F.regexp_replace(s, r"!(?!=)", " not ")
    s = F.regexp_replace(s, r"(?<![=!<>:])=(?!=)", " == ")
    s = F.regexp_replace(s, r"(==|!=|>=|<=)", " $1 ")
    s = F.regexp_replace(s, r"(?<![<>=!])([<>])(?![<>=])", " $1 ")
    s = F.regexp_replace(s, r"(?i)\b(and|or|not|true|false)\b", "\u0000$1\u0000")
    s = F.regexp_replace(s, "\u0000(?i:and)\u0000", "and")
    s = F.regexp_replace(s, "\u0000(?i:or)\u0000", "or")
    s = F.regexp_replace(s, "\u0000(?i:not)\u0000", "not")
    s = F.regexp_replace(s, "\u0000(?i:true)\u0000", "true")
    s = F.regexp_replace(s, "\u0000(?i:false)\u0000", "false")
    s = F.regexp_replace(s, r"\(\s+", "(")
    s = F.regexp_replace(s, r"\s+\)", ")")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(F.lower(s).isin([*TRUE_GUARDS, "1"]), F.lit("true")).when(s == "0", F.lit("false")).otherwise(s)


def _atom_canonical(a: Column) -> Column:
    """One flat atom (already normalised) to canonical text, or NULL if unparsable."""
    neg = F.regexp_extract(a, ATOM_RE, 1) != ""
    lhs = F.regexp_extract(a, ATOM_RE, 2)
    op = F.regexp_extract(a, ATOM_RE, 3)
    rhs = F.regexp_extract(a, ATOM_RE, 4)
    ok = a.rlike(ATOM_RE) & ~rhs.rlike(r"[ ()]") & (lhs != "")
    literal = rf"^({_NUMBER}|{_STRING})$"
    lhs_num = lhs.rlike(literal)
    rhs_num = rhs.rlike(literal)
    flip_map = F.create_map(*[x for k, v in FLIP.items() for x in (F.lit(k), F.lit(v))])
    neg_map = F.create_map(*[x for k, v in NEGATE.items() for x in (F.lit(k), F.lit(v))])
    # put the variable on the left: 5 < x -> x > 5
    swap = lhs_num & ~rhs_num & (op != "")
    var = F.when(swap, rhs).otherwise(lhs)
    val = F.when(swap, lhs).otherwise(rhs)
    op1 = F.when(swap, flip_map[op]).otherwise(op)
    op2 = F.when(neg & (op1 != ""), neg_map[op1]).otherwise(op1)
    bare_neg = neg & (op1 == "")
    # x == true -> x ; x == false -> not x ; x != true -> not x ; x != false -> x
    boolcmp = (op2.isin("==", "!=")) & val.isin("true", "false")
    positive = (op2 == "==") == (val == "true")
    txt = (
        F.when(op2 == "", F.when(bare_neg, F.concat(F.lit("not "), var)).otherwise(var))
        .when(boolcmp, F.when(positive, var).otherwise(F.concat(F.lit("not "), var)))
        .otherwise(F.concat_ws(" ", var, op2, val))
    )
    return F.when(ok, txt)


# E3 / E4 -------------------------------------------------------------------------
def canonical_guard(g: Column) -> Column:
    """Order-free key of a guard: atoms canonical, sorted within clause, clauses sorted,
    duplicates dropped, ``' or '`` / ``' and '`` separators; ``'true'`` for always-true
    guards; NULL when the guard is not a flat boolean of comparisons (then it never
    equals anything by key, see ``guard_equivalent``)."""
    n = normalize_guard(g)
    clauses = F.split(n, " or ")
    atoms = F.transform(clauses, lambda c: F.array_distinct(F.array_sort(F.transform(F.split(c, " and "), _atom_canonical))))
    bad = F.exists(atoms, lambda c: F.exists(c, lambda a: a.isNull())) | n.contains("(") | n.contains(")")
    # constants: a false atom drops its clause, a true one is dropped from it; no clause left is false
    no, yes = F.array(F.lit("false"), F.lit("0"), F.lit("not true"), F.lit("not 1")), F.array(
        F.lit("true"), F.lit("1"), F.lit("not false"), F.lit("not 0"))
    live = F.transform(F.filter(atoms, lambda c: ~F.arrays_overlap(c, no)), lambda c: F.array_except(c, yes))
    joined = F.array_join(F.array_sort(F.array_distinct(F.transform(live, lambda c: F.array_join(c, " and ")))), " or ")
    folded = F.when(F.size(live) == 0, F.lit("false")).when(F.exists(live, lambda c: F.size(c) == 0), F.lit("true")).otherwise(joined)
    return F.when(n == "true", F.lit("true")).when(~bad, folded)


def canonical_guards(guards: DataFrame, guard_col: str = "guard") -> DataFrame:
    """``(guard, cg)`` over the *distinct* guard texts: flat guards in Spark SQL; only the
    remaining guards with parentheses go through the vectorised DNF helper.

    The distinct texts are written first: Spark would move the test for parentheses below the ``distinct`` and read
    every guard of the table. The result is written too: a join on ``guard`` would infer the same tests for its other side."""
    texts = stored(guards.select(F.col(guard_col).alias("guard")).distinct())
    d = texts.select(
        "guard", canonical_guard(F.col("guard")).alias("cg"), normalize_guard(F.col("guard")).alias("_n"))
    nested = F.col("cg").isNull() & F.col("_n").contains("(") & ~F.col("_n").rlike(r"[-+*/%;]|>>|<<")
    done = d.filter(~nested).select("guard", "cg")
    rest = d.filter(nested).select("guard", nested_canonical(F.col("_n")).alias("cg"))
    return stored(done.unionByName(rest))


def guard_atoms(guards: DataFrame, guard_col: str = "guard") -> DataFrame:
    """Flat DNF rows ``(guard, clause, atom_pos, var, op, val, negated)`` of the distinct guards."""
    d = guards.select(F.col(guard_col).alias("guard")).distinct()
    n = d.select("guard", normalize_guard(F.col("guard")).alias("n")).filter("n <> 'true'")
    # bracketed guards are read in their canonical form, where that exists
    bracketed = F.col("n").contains("(") & ~F.col("n").rlike(r"[-+*/%;]|>>|<<")
    n = n.filter(~bracketed).unionByName(n.filter(bracketed).select(
        "guard", F.coalesce(nested_canonical(F.col("n")), F.col("n")).alias("n")).filter("n <> 'true'"))
    cl = n.select("guard", F.posexplode(F.split("n", " or ")).alias("clause", "c"))
    at = cl.select("guard", "clause", F.posexplode(F.split("c", " and ")).alias("atom_pos", "a"))
    canon = _atom_canonical(F.col("a"))
    return at.select(
        "guard", "clause", "atom_pos",
        F.regexp_extract(canon, r"^(?:not )?([^ ]+)", 1).alias("var"),
        F.regexp_extract(canon, r"^(?:not )?[^ ]+ ([^ ]+) ", 1).alias("op"),
        F.regexp_extract(canon, r"^(?:not )?[^ ]+ [^ ]+ (.+)$", 1).alias("val"),
        F.coalesce(canon.startswith("not "), F.lit(False)).alias("negated"),
        canon.isNotNull().alias("parsed"),
    )


# E5 ------------------------------------------------------------------------------
def name_type(var: Column) -> Column:
    lv = F.lower(var)
    is_b = None
    for h in BOOL_NAME_HINTS:
        is_b = lv.contains(h) if is_b is None else (is_b | lv.contains(h))
    is_i = None
    for h in INT_NAME_HINTS:
        is_i = lv.contains(h) if is_i is None else (is_i | lv.contains(h))
    return F.when(is_b, "Bool").when(is_i, "Int").otherwise("Bool")


_ARITH = r"[-+*/%]"


def infer_var_types(c: Charts) -> DataFrame:
    """Bool / Int per (model, variable): ordering comparison or arithmetic => Int; bare use
    under and/or/not => Bool; otherwise the name heuristic."""
    g = c.transitions.select("model_id", "guard", normalize_guard(F.col("guard")).alias("n"))
    toks = g.select(
        "model_id", "n",
        F.regexp_extract_all("n", F.lit(rf"([A-Za-z_][A-Za-z0-9_]*)(?=\s*(?:<=|>=|<|>|{_ARITH}))|(?<=[<>+*/%-]|[<>]=)\s*([A-Za-z_][A-Za-z0-9_]*)"), 0).alias("cmp"),
    )
    ints = toks.select("model_id", F.explode("cmp").alias("m")).select(
        "model_id", F.regexp_extract("m", r"([A-Za-z_][A-Za-z0-9_]*)", 1).alias("var")
    ).withColumn("is_int", F.lit(True))
    logic = g.filter(F.col("n").rlike(r"\b(and|or|not)\b")).select(
        "model_id", F.explode(F.split("n", " (?:and|or) ")).alias("a")
    ).select("model_id", F.regexp_replace(F.trim("a"), "^not ", "").alias("a")).filter(
        F.col("a").rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") & ~F.col("a").isin("true", "false")
    ).select("model_id", F.col("a").alias("var"), F.lit(True).alias("is_bool"))
    used = ints.groupBy("model_id", "var").agg(F.max("is_int").alias("is_int")).join(
        logic.groupBy("model_id", "var").agg(F.max("is_bool").alias("is_bool")), ["model_id", "var"], "full"
    )
    vars_ = c.meta.select("model_id", F.explode("variables").alias("var"))
    return vars_.join(used, ["model_id", "var"], "left").select(
        "model_id", "var",
        F.when(F.col("is_int"), "Int").when(F.col("is_bool"), "Bool").otherwise(name_type(F.col("var"))).alias("type"),
    )


# E7 ------------------------------------------------------------------------------
WORD_SPLIT = r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"


def substitute(expr: Column, values: Column) -> Column:
    """Replace every whole-word variable of ``expr`` found in the map ``values`` by its
    parenthesised value, simultaneously (one tokenising pass, no re-substitution)."""
    toks = F.regexp_extract_all(expr, F.lit(WORD_SPLIT), 0)
    return F.array_join(
        F.transform(toks, lambda t: F.coalesce(F.concat(F.lit("("), F.element_at(values, t), F.lit(")")), t)), ""
    )


# E8 ------------------------------------------------------------------------------
#: Longest text a folded value is held as; a longer one becomes a node: its id stands for it wherever it is used.
LONGEST = 10_000


def node_or_text(value: Column, longest: int = LONGEST) -> Column:
    """A value as the fold carries it: its text, or ``#`` and the hash of the text where that is too long.

    The text of a value names its parts in the same way, so a node's id is a hash of its operator and the ids of its
    parts, equal expressions built alike share a node, and ``x := x + x`` grows by one node every few steps."""
    return F.get(F.transform(F.array(value), lambda v: F.when(F.length(v) > longest, F.concat(F.lit("#"), F.md5(v))).otherwise(v)), F.lit(0))


def fold_assignments(seq: Column) -> Column:
    """Fold an ordered ``ARRAY<STRUCT<hop, lhs, rhs>>`` into the final ``MAP<var, expr>`` (see ``node_or_text``).
    Assignments of one hop are parallel: they see the values from before that hop."""
    empty = F.create_map().cast("map<string,string>")
    init = F.struct(empty.alias("prev"), empty.alias("cur"), F.lit(-1).cast("int").alias("hop"))

    def step(acc, a):
        prev = F.when(a["hop"] != acc["hop"], acc["cur"]).otherwise(acc["prev"])
        val = node_or_text(substitute(a["rhs"], prev))
        cur = F.map_concat(F.map_filter(acc["cur"], lambda k, v: k != a["lhs"]), F.create_map(a["lhs"], val))
        return F.struct(prev.alias("prev"), cur.alias("cur"), a["hop"].cast("int").alias("hop"))

    return F.aggregate(seq, init, step, lambda acc: acc["cur"])


def parse_assignments(function: Column) -> Column:
    """``ARRAY<STRUCT<lhs, rhs>>`` of one step function (fragments without ``:=`` ignored;
    for a repeated left-hand side within the step the last one wins)."""
    frags = F.filter(F.transform(F.split(F.coalesce(function, F.lit("")), ";"), lambda s: F.trim(s)),
                     lambda s: s.contains(":="))
    pairs = F.transform(frags, lambda a: F.struct(
        F.trim(F.substring_index(a, ":=", 1)).alias("lhs"),
        F.trim(F.regexp_extract(a, r"^[^:]*:=(.*)$", 1)).alias("rhs")))
    return F.filter(pairs, lambda a, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda b: b["lhs"] == a["lhs"]))


def _after(m: Column, values: Column) -> Column:
    """The map ``m`` with the pairs of ``values`` (structs key, value) put in."""
    keys = F.transform(values, lambda x: x["key"])
    return F.map_concat(F.map_filter(m, lambda k, v: ~F.array_contains(keys, k)), F.map_from_entries(values))


def fold_functions(fun_seq: Column, longest: int = LONGEST) -> Column:
    """Fold an ordered ``ARRAY<STRING>`` of step functions into the final ``MAP<var, expr>`` (values as in ``node_or_text``);
    the assignments of one step are parallel (they see the values from before the step)."""
    def step(m, f):
        return _after(m, F.transform(parse_assignments(f), lambda a: F.struct(
            a["lhs"].alias("key"), node_or_text(substitute(a["rhs"], m), longest).alias("value"))))

    return F.aggregate(fun_seq, F.create_map().cast("map<string,string>"), step)


def expression_nodes(seqs: DataFrame, col: str = "fun_seq", longest: int = LONGEST) -> DataFrame:
    """``(node, expr)``: the shared table of the expressions behind the ``#`` ids that folding the sequences of a table makes.
    One row an expression, however many paths use it."""
    empty = F.struct(F.create_map().cast("map<string,string>").alias("m"), F.expr("cast(array() as array<string>)").alias("made"))

    def step(acc, f):
        full = F.transform(parse_assignments(f), lambda a: F.struct(a["lhs"].alias("key"), substitute(a["rhs"], acc["m"]).alias("value")))
        held = F.transform(full, lambda x: F.struct(x["key"], node_or_text(x["value"], longest).alias("value")))
        long = F.filter(F.transform(full, lambda x: x["value"]), lambda v: F.length(v) > longest)
        return F.struct(_after(acc["m"], held).alias("m"), F.concat(acc["made"], long).alias("made"))

    made = seqs.select(col).distinct().select(F.explode(F.aggregate(F.col(col), empty, step, lambda acc: acc["made"])).alias("expr"))
    return made.distinct().select(F.concat(F.lit("#"), F.md5("expr")).alias("node"), "expr")


# E10 / E11 -----------------------------------------------------------------------
def transform_key(m: Column, allowed: Column | None = None) -> Column:
    """Joinable text of a transform map restricted to ``allowed`` variables:
    sorted ``var=expr`` joined by ``'; '``, ``'true'`` when empty."""
    if allowed is not None:
        m = F.map_filter(m, lambda k, v: F.array_contains(allowed, k))
    ent = F.array_sort(F.map_entries(m))
    txt = F.array_join(F.transform(ent, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return F.when(F.size(ent) == 0, F.lit("true")).otherwise(txt)


def transform_map(key: Column) -> Column:
    """Inverse of ``transform_key``."""
    return F.when(key == "true", F.create_map().cast("map<string,string>")).otherwise(
        F.map_from_entries(F.transform(F.split(key, "; "), lambda e: F.struct(
            F.substring_index(e, "=", 1).alias("key"), F.regexp_extract(e, "^[^=]*=(.*)$", 1).alias("value")
        )))
    )


def transform_equal(m1: Column, m2: Column, allowed: Column) -> Column:
    """Same value (or both absent) for every allowed variable."""
    return F.forall(allowed, lambda v: F.element_at(m1, v).eqNullSafe(F.element_at(m2, v)))


# E3 (nested) ---------------------------------------------------------------------
_CMP = {"Eq": "==", "NotEq": "!=", "Lt": "<", "LtE": "<=", "Gt": ">", "GtE": ">="}


def _atom_text(var: str, op: str, val: str) -> str:
    if op in ("==", "!=") and val in ("true", "false"):
        return var if (op == "==") == (val == "true") else f"not {var}"
    return f"{var} {op} {val}"


def _minimal(clauses):
    """Clauses without those that another one's atoms already imply; no cap, as absorbed clauses never multiply."""
    kept = []
    for c in sorted(clauses, key=lambda c: (len(c), sorted(c))):
        if not any(k <= c for k in kept):
            kept.append(c)
    return kept


#: Clauses up to which a conjunction of bracketed alternatives is multiplied out.
CLAUSES = 1024


class _TooMany(Exception):
    """A product of more than ``CLAUSES`` clauses."""


def _dnf(node):
    """Python AST of a normalised guard -> list of factors, each a list of clauses (sets of canonical atoms), whose conjunction
    it is; or None. There is one factor unless multiplying out would pass ``CLAUSES``; then the alternatives of the outermost
    conjunction stay factors of their own."""
    import ast

    def lit(n):
        if isinstance(n, ast.Name):
            return n.id, n.id in ("true", "false")
        if isinstance(n, ast.Constant) and isinstance(n.value, bool):
            return str(n.value).lower(), True
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return str(n.value), True
        if isinstance(n, ast.Constant) and isinstance(n.value, str) and not set(n.value) & set(" ()'"):
            return f"'{n.value}'", True
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub) and isinstance(n.operand, ast.Constant) \
                and isinstance(n.operand.value, (int, float)) and not isinstance(n.operand.value, bool):
            return f"-{n.operand.value}", True
        return None, False

    def product(parts):
        out = [frozenset()]
        for p in parts:
            if len(out) * len(p) > CLAUSES:
                raise _TooMany
            out = _minimal({a | b for a in out for b in p})
        return out

    def outermost(n, neg):
        """The conjuncts of a node, brackets and negations looked through."""
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return outermost(n.operand, not neg)
        if isinstance(n, ast.BoolOp) and isinstance(n.op, ast.And) != neg:
            return [x for v in n.values for x in outermost(v, neg)]
        return [(n, neg)]

    def go(n, neg):
        if isinstance(n, ast.BoolOp):
            is_and = isinstance(n.op, ast.And) != neg
            parts = [go(v, neg) for v in n.values]
            if any(p is None for p in parts):
                return None
            if not is_and:
                return _minimal({c for p in parts for c in p})
            return product(parts)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return go(n.operand, not neg)
        if isinstance(n, ast.Compare) and len(n.ops) == 1:
            op = _CMP.get(type(n.ops[0]).__name__)
            (lv, lc), (rv, rc) = lit(n.left), lit(n.comparators[0])
            if op is None or lv is None or rv is None:
                return None
            if lc and not rc:
                lv, rv, op = rv, lv, {">": "<", "<": ">", ">=": "<=", "<=": ">="}.get(op, op)
            if neg:
                op = {">": "<=", "<": ">=", ">=": "<", "<=": ">", "==": "!=", "!=": "=="}[op]
            return [frozenset([_atom_text(lv, op, rv)])]
        v, is_lit = lit(n)
        if v is not None and not is_lit:
            return [frozenset([f"not {v}" if neg else v])]
        if v in ("true", "false", "1", "0"):
            return [frozenset()] if (v in ("true", "1")) != neg else []
        return None

    try:
        whole = go(node, False)
        return None if whole is None else [whole]
    except _TooMany:
        factors = [go(n, neg) for n, neg in outermost(node, False)]
        return None if any(f is None for f in factors) else factors


def nested_canonical_text(n: str | None) -> str | None:
    """Canonical key of a normalised guard with parentheses (same format as ``canonical_guard``)."""
    import ast

    if n is None:
        return None
    try:
        tree = ast.parse(n, mode="eval").body
    except (SyntaxError, ValueError):
        return None
    try:
        factors = _dnf(tree)
    except _TooMany:  # also within one factor: not readable as clauses
        return None
    if factors is None:
        return None
    if any(not d for d in factors):
        return "false"
    texts = {" or ".join(sorted({" and ".join(sorted(c)) for c in d})) for d in factors if not any(len(c) == 0 for c in d)}
    return " AND ".join(sorted(texts)) or "true"


@F.pandas_udf(StringType())
def nested_canonical(n: pd.Series) -> pd.Series:
    return n.map(nested_canonical_text)
