"""Registered guard and chart-quality queries over D-CHART-G (day charts whose guards come
in several spellings, some faulty) and D-CHART (E2-E6, L1-L6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartlake.functions.equivalence import guard_equivalent
from chartlake.functions.guards import canonical_guards, guard_atoms, infer_var_types, normalize_guard
from chartlake.operators import containment as ct
from chartlake.operators import quality as L
from chartlake.plans.registry import query
from chartlake.plans.sql import CTE, compose, cte
from chartlake.sources.derived import day_week_pairs, load_event_charts

cte("evg", ["evs"], """
SELECT model_id, seq, event_type, event_id % 9 AS v, k, nxt,
       CASE event_id % 9 WHEN 1 THEN 'k = ' || CAST(k AS VARCHAR) WHEN 2 THEN 'k <> ' || CAST(k AS VARCHAR)
            WHEN 3 THEN 'k >= 50 && is_' || event_type WHEN 4 THEN CAST(k AS VARCHAR) || ' < k AND flag'
            WHEN 5 THEN 'not k > ' || CAST(k AS VARCHAR) WHEN 6 THEN '''True''' WHEN 7 THEN 'x >> 1' WHEN 8 THEN ''
            ELSE CASE WHEN k >= 50 THEN 'k >= 50' ELSE 'k < 50' END END AS guard,
       CASE WHEN event_id % 9 = 8 THEN 'Unknown_' || nxt ELSE nxt END AS tgt,
       CASE event_id % 9 WHEN 1 THEN 'k == ' || CAST(k AS VARCHAR) WHEN 2 THEN 'k != ' || CAST(k AS VARCHAR)
            WHEN 3 THEN 'k >= 50 and is_' || event_type WHEN 4 THEN CAST(k AS VARCHAR) || ' < k and flag'
            WHEN 5 THEN 'not k > ' || CAST(k AS VARCHAR) WHEN 6 THEN 'true' WHEN 7 THEN 'x >> 1' WHEN 8 THEN 'true'
            ELSE CASE WHEN k >= 50 THEN 'k >= 50' ELSE 'k < 50' END END AS norm,
       CASE event_id % 9 WHEN 1 THEN 'k == ' || CAST(k AS VARCHAR) WHEN 2 THEN 'k != ' || CAST(k AS VARCHAR)
            WHEN 3 THEN 'is_' || event_type || ' and k >= 50' WHEN 4 THEN 'flag and k > ' || CAST(k AS VARCHAR)
            WHEN 5 THEN 'k <= ' || CAST(k AS VARCHAR) WHEN 6 THEN 'true' WHEN 7 THEN NULL WHEN 8 THEN 'true'
            ELSE CASE WHEN k >= 50 THEN 'k >= 50' ELSE 'k < 50' END END AS canon
FROM evs WHERE period = 'day' AND nxt IS NOT NULL""")
cte("gtrans", ["evg"], """
SELECT model_id, row_number() OVER (PARTITION BY model_id ORDER BY min(seq)) - 1 AS t_idx, event_type AS src, tgt, guard
FROM evg GROUP BY model_id, event_type, tgt, guard""")
cte("gsteps", ["ch_steps"], "SELECT * FROM ch_steps WHERE contains(model_id, '/day/')")
cte("gmeta", ["ch_meta"], "SELECT * FROM ch_meta WHERE contains(model_id, '/day/')")


def _g(spark, sf):
    c, _ = load_event_charts(spark, sf, periods=("day",), dialects=True)
    return c.persist()


def _guards(spark, sf):
    return _g(spark, sf).transitions.select("guard").distinct()


# E2 / E3 / E4 ------------------------------------------------------------------------
@query("normalize_guard", compose("SELECT DISTINCT guard, norm AS normalized FROM evg", "evg"))
def q_normalize_guard(spark, sf):
    return _guards(spark, sf).select("guard", normalize_guard(F.col("guard")).alias("normalized"))


@query("canonical_guard", compose("SELECT DISTINCT guard, canon AS canonical FROM evg", "evg"))
def q_canonical_guard(spark, sf):
    return canonical_guards(_guards(spark, sf)).select("guard", F.col("cg").alias("canonical"))


@query("guard_atoms", compose("""
SELECT DISTINCT guard, clause, atom_pos, var, op, val, negated, parsed FROM (
  SELECT guard, 0 AS clause, 0 AS atom_pos, 'k' AS var,
         CASE v WHEN 1 THEN '==' WHEN 2 THEN '!=' WHEN 3 THEN '>=' WHEN 4 THEN '>' WHEN 5 THEN '<='
                ELSE CASE WHEN k >= 50 THEN '>=' ELSE '<' END END AS op,
         CASE WHEN v IN (1, 2, 4, 5) THEN CAST(k AS VARCHAR) ELSE '50' END AS val, false AS negated, true AS parsed
  FROM evg WHERE v IN (0, 1, 2, 3, 4, 5)
  UNION ALL
  SELECT guard, 0, 1, CASE WHEN v = 3 THEN 'is_' || event_type ELSE 'flag' END, '', '', false, true FROM evg WHERE v IN (3, 4)
  UNION ALL
  SELECT guard, 0, 0, NULL, NULL, NULL, false, false FROM evg WHERE v = 7)""", "evg"))
def q_guard_atoms(spark, sf):
    a = guard_atoms(_guards(spark, sf))
    return a.select("guard", F.col("clause").cast("int"), F.col("atom_pos").cast("int"), "var", "op", "val", "negated", "parsed")


# E5 -----------------------------------------------------------------------------------
@query("infer_var_types", compose("""
SELECT model_id, 'k' AS var, CASE WHEN bool_or(v IN (0, 3, 4, 5)) THEN 'Int' ELSE 'Bool' END AS type FROM evg GROUP BY model_id
UNION ALL SELECT model_id, 'acc', 'Bool' FROM gmeta
UNION ALL SELECT model_id, 'last', 'Bool' FROM gmeta
UNION ALL SELECT m.model_id, 'k', 'Bool' FROM gmeta m WHERE NOT EXISTS (SELECT 1 FROM evg e WHERE e.model_id = m.model_id)""",
                                  "evg", "gmeta"))
def q_infer_var_types(spark, sf):
    return infer_var_types(_g(spark, sf))


# L1 / L2 / L3 / L5 / L6 ----------------------------------------------------------------
@query("undefined_variables", compose("""
SELECT DISTINCT model_id, CASE v WHEN 3 THEN 'is_' || event_type WHEN 4 THEN 'flag' ELSE 'x' END AS var
FROM evg WHERE v IN (3, 4, 7)""", "evg"))
def q_undefined_variables(spark, sf):
    return L.undefined_variables(_g(spark, sf))


@query("bad_operator_guards", compose("""
SELECT model_id, CAST(t_idx AS INTEGER) AS t_idx, guard,
       CASE WHEN guard = '' THEN 'missing_guard' WHEN guard = 'x >> 1' THEN 'shift_operator' ELSE 'single_equals' END AS issue
FROM gtrans WHERE guard = '' OR guard = 'x >> 1' OR starts_with(guard, 'k = ')""", "gtrans"))
def q_bad_operator_guards(spark, sf):
    return L.bad_operator_guards(_g(spark, sf)).select("model_id", F.col("t_idx").cast("int"), "guard", "issue")


@query("no_exit_steps", compose("""
SELECT s.model_id, s.name AS place FROM gsteps s
WHERE NOT EXISTS (SELECT 1 FROM gtrans t WHERE t.model_id = s.model_id AND t.src = s.name)""", "gsteps", "gtrans"))
def q_no_exit_steps(spark, sf):
    return L.no_exit_steps(_g(spark, sf))


@query("dangling_refs", compose("""
SELECT DISTINCT t.model_id, 'tgt' AS role, t.tgt AS ref FROM gtrans t
WHERE NOT EXISTS (SELECT 1 FROM gsteps s WHERE s.model_id = t.model_id AND s.name = t.tgt)""", "gtrans", "gsteps"))
def q_dangling_refs(spark, sf):
    return L.dangling_refs(_g(spark, sf))


cte("gedges", ["gtrans", "gsteps"], """
SELECT t.model_id, t.src, t.tgt AS dst FROM gtrans t JOIN gsteps s ON s.model_id = t.model_id AND s.name = t.src""")
cte("greach", ["gedges", "gmeta"], """
SELECT m.model_id, m.initial_step AS place FROM gmeta m
UNION
SELECT r.model_id, e.dst FROM greach r JOIN gedges e ON e.model_id = r.model_id AND e.src = r.place""")


@query("unreachable_steps", compose("""
SELECT s.model_id, s.name AS place FROM gsteps s
WHERE NOT EXISTS (SELECT 1 FROM greach r WHERE r.model_id = s.model_id AND r.place = s.name)""", "gsteps", "greach"))
def q_unreachable_steps(spark, sf):
    return L.unreachable_steps(_g(spark, sf))


# L4 on D-CHART -------------------------------------------------------------------------
@query("overlapping_branches", compose("""
SELECT DISTINCT t.model_id, t.src AS place FROM ch_trans t JOIN g_places p ON p.model_id = t.model_id AND p.place = t.src
GROUP BY t.model_id, t.src, t.guard HAVING count(*) >= 2""", "ch_trans", "g_places"))
def q_overlapping_branches(spark, sf):
    c, _ = load_event_charts(spark, sf)
    return L.overlapping_branches(c.persist()).filter("verdict = 'overlap'").select("model_id", "place")


# E6 on the containment leftovers --------------------------------------------------------
def _ev(cond, k):
    return (f"list_aggregate(list_transform(string_split({cond}, ' AND '), lambda g: CASE g WHEN 'k < 50' THEN {k} < 50 "
            f"WHEN 'k >= 50' THEN {k} >= 50 ELSE true END), 'bool_and')")


@query("guard_equivalent", compose(f"""
SELECT a.pair_id, a.path_key, b.path_key AS cand_key,
       CASE WHEN {_ev('a.cond_key', 49)} <> {_ev('b.cond_key', 49)} OR {_ev('a.cond_key', 50)} <> {_ev('b.cond_key', 50)}
              OR {_ev('a.cond_key', 51)} <> {_ev('b.cond_key', 51)} THEN 'different' ELSE 'equivalent' END AS verdict
FROM c_p1 a JOIN c_p2 b ON b.pair_id = a.pair_id AND b.xform_key = a.xform_key AND b.cond_key <> a.cond_key
WHERE NOT EXISTS (SELECT 1 FROM c_match m WHERE m.pair_id = a.pair_id AND m.path_key = a.path_key)""", "c_p1", "c_p2", "c_match"))
def q_guard_equivalent(spark, sf):
    c, idx = load_event_charts(spark, sf)
    idx = idx.persist()
    p1, p2 = ct.pair_paths(c.persist(), day_week_pairs(idx))
    un = ct.path_unmatched(p1, ct.path_match(p1, p2))
    cand = p2.select("pair_id", "xform_key", F.col("path_key").alias("cand_key"), F.col("cond_key").alias("cand_cond"))
    j = un.join(cand, ["pair_id", "xform_key"]).filter(F.col("cand_cond") != F.col("cond_key"))
    # verdicts over the distinct condition pairs only, joined back
    v = guard_equivalent(j.select("cond_key", "cand_cond").distinct(), "cond_key", "cand_cond")
    return j.join(v, ["cond_key", "cand_cond"]).select("pair_id", "path_key", "cand_key", "verdict")


# D-CHART-G for day and week charts: matching and overlap by what the guards mean ---------
# The SQL evaluates every guard at k = -1 .. 101 (all constants lie between) and collects the flags it needs;
# conjunctions are equal if both agree, or if no k is left on either side.
cte("gx_ev", ["evs"], CTE["evg"][1].replace("WHERE period = 'day' AND nxt", "WHERE nxt"))
cte("gx_trans", ["gx_ev"], """
SELECT model_id, row_number() OVER (PARTITION BY model_id ORDER BY min(seq)) - 1 AS t_idx, event_type AS src, tgt,
       min(v) AS v, min(k) AS k
FROM gx_ev GROUP BY model_id, event_type, tgt, guard""")
cte("gx_mean", ["gx_trans"], """
SELECT *, list_filter(range(-1, 102), lambda x: CASE v WHEN 1 THEN x = k WHEN 2 THEN x <> k WHEN 3 THEN x >= 50 WHEN 4 THEN x > k
          WHEN 5 THEN x <= k WHEN 0 THEN (x >= 50) = (k >= 50) ELSE v <> 7 END) AS ks,
       CASE v WHEN 3 THEN 'is_' || src WHEN 4 THEN 'flag' END AS flag
FROM gx_trans""")
for _name in ("g_edges", "g_deg", "g_reach", "g_cuts", "g_walk", "g_paths"):
    _deps, _body = CTE[_name]
    for _old in ("g_edges", "g_deg", "g_reach", "g_cuts", "g_walk", "ch_trans"):
        _body = _body.replace(_old, "gx_" + _old.split("_", 1)[1])
    cte("gx_" + _name.split("_", 1)[1], ["gx_" + d.split("_", 1)[1] if d.startswith("g_") and d != "g_places" or d == "ch_trans" else d
                                         for d in _deps], _body)
cte("gx_hops", ["gx_paths", "gx_mean"], """
SELECT p.model_id, p.path_key, h.hop, t.ks, t.flag, t.v, t.tgt
FROM gx_paths p, LATERAL (SELECT unnest(range(len(p.transitions))) AS hop) h
JOIN gx_mean t ON t.model_id = p.model_id AND t.t_idx = p.transitions[h.hop + 1]""")
cte("gx_sem", ["gx_hops"], """
SELECT model_id, path_key,
       CASE WHEN bool_or(v = 7) THEN NULL
            WHEN len(list_filter(range(-1, 102), lambda x: len(list_filter(list(ks), lambda s: list_contains(s, x))) = count(*))) = 0 THEN 'false'
            ELSE CAST(list_filter(range(-1, 102), lambda x: len(list_filter(list(ks), lambda s: list_contains(s, x))) = count(*)) AS VARCHAR)
                 || coalesce(string_agg(DISTINCT flag, ',' ORDER BY flag), '') END AS meaning,
       'acc=' || repeat('(', count(*) - 1) || string_agg(CASE WHEN hop = 0 THEN 'acc + ' || CAST(length(tgt) AS VARCHAR)
            ELSE ') + ' || CAST(length(tgt) AS VARCHAR) END, '' ORDER BY hop) || '; last=k' AS xform_key
FROM gx_hops GROUP BY model_id, path_key""")
cte("gx_p1", ["d_pair", "gx_sem"], "SELECT d.pair_id, s.* FROM d_pair d JOIN gx_sem s ON s.model_id = d.model1")
cte("gx_p2", ["d_pair", "gx_sem"], "SELECT d.pair_id, s.* FROM d_pair d JOIN gx_sem s ON s.model_id = d.model2")
cte("gx_match", ["gx_p1", "gx_p2"], """
SELECT a.pair_id, a.path_key, min(b.path_key) AS match_key
FROM gx_p1 a JOIN gx_p2 b ON b.pair_id = a.pair_id AND b.meaning = a.meaning AND b.xform_key = a.xform_key
GROUP BY a.pair_id, a.path_key""")


def _gx(spark, sf):
    return load_event_charts(spark, sf, dialects=True)


@query("path_match_dialects", compose("SELECT pair_id, path_key, match_key FROM gx_match", "gx_match"))
def q_path_match_dialects(spark, sf):
    c, idx = _gx(spark, sf)
    return ct.path_match(*ct.pair_paths(c.persist(), day_week_pairs(idx), expand=False))


@query("containment_dialects", compose("""
SELECT d.pair_id, CAST(count(a.path_key) AS BIGINT) AS paths1, CAST(count(m.match_key) AS BIGINT) AS matched,
       CAST(count(CASE WHEN m.match_key IS NULL AND a.meaning IS NULL THEN a.path_key END) AS BIGINT) AS unknown,
       count(a.path_key) = count(m.match_key) AS contained
FROM d_pair d LEFT JOIN gx_p1 a ON a.pair_id = d.pair_id
LEFT JOIN gx_match m ON m.pair_id = a.pair_id AND m.path_key = a.path_key GROUP BY d.pair_id""", "gx_p1", "gx_match"))
def q_containment_dialects(spark, sf):
    c, idx = _gx(spark, sf)
    return ct.containment(c.persist(), day_week_pairs(idx)).select("pair_id", "paths1", "matched", "unknown", "contained")


@query("overlapping_branches_dialects", compose("""
SELECT model_id, place, CASE WHEN overlap THEN 'overlap' ELSE 'unknown' END AS verdict FROM (
  SELECT model_id, src AS place, bool_or(v = 7) AS unread,
         len(list_filter(range(-1, 102), lambda x: len(list_filter(list(ks), lambda s: list_contains(s, x))) >= 2)) > 0 AS overlap
  FROM gx_mean GROUP BY model_id, src HAVING count(*) >= 2) WHERE overlap OR unread""", "gx_mean"))
def q_overlapping_branches_dialects(spark, sf):
    return L.overlapping_branches(_gx(spark, sf)[0].persist()).select("model_id", "place", "verdict")
