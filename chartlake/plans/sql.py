"""Reference SQL (DuckDB dialect, ANSI where possible) for the derived tables, composed
into one ``WITH RECURSIVE`` query per check. Only the tables of the shared data set are
read; every fragment mirrors a Spark builder in ``chartlake.sources.derived`` or an
operator module.
"""

from __future__ import annotations

CTE: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTE[name] = (deps, body)


def compose(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTE[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return final
    parts = [f"{n} AS (\n{CTE[n][1]}\n)" for n in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final


# ---- D-CHART ----------------------------------------------------------------------
cte("ev", [], """
SELECT event_id, ts, user_id, event_type, value,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events""")
cte("evm", ["ev"], """
SELECT *, CAST(user_id AS VARCHAR) || '/' || period || '/' || strftime(period_start, '%Y-%m-%d') AS model_id
FROM (
  SELECT ev.*, 'day' AS period, date_trunc('day', ts) AS period_start FROM ev
  UNION ALL
  SELECT ev.*, 'week' AS period, date_trunc('week', ts) AS period_start FROM ev
)""")
cte("evs", ["evm"], """
SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY ts, event_id) AS seq,
       lead(event_type) OVER (PARTITION BY model_id ORDER BY ts, event_id) AS nxt
FROM evm""")
cte("ch_index", ["evs"], """
SELECT DISTINCT model_id, user_id, period, period_start FROM evs""")
cte("ch_meta", ["evs"], """
SELECT model_id, event_type AS initial_step FROM evs WHERE seq = 1""")
cte("ch_steps", ["evs"], """
SELECT model_id,
       row_number() OVER (PARTITION BY model_id ORDER BY min(seq)) - 1 AS ord,
       event_type AS name,
       'acc := acc + ' || CAST(length(event_type) AS VARCHAR) || '; last := k' AS function
FROM evs GROUP BY model_id, event_type""")
cte("ch_trans", ["evs"], """
SELECT model_id,
       row_number() OVER (PARTITION BY model_id ORDER BY min(seq)) - 1 AS t_idx,
       event_type AS src, nxt AS tgt,
       CASE WHEN k >= 50 THEN 'k >= 50' ELSE 'k < 50' END AS guard
FROM evs WHERE nxt IS NOT NULL
GROUP BY model_id, event_type, nxt, CASE WHEN k >= 50 THEN 'k >= 50' ELSE 'k < 50' END""")

# ---- graph --------------------------------------------------------------------------
cte("g_places", ["ch_steps"], "SELECT DISTINCT model_id, name AS place FROM ch_steps")
cte("g_edges", ["ch_trans", "g_places"], """
SELECT t.model_id, t.src, t.t_idx, t.tgt AS dst
FROM ch_trans t JOIN g_places p ON p.model_id = t.model_id AND p.place = t.src""")
cte("g_deg", ["g_places", "ch_trans"], """
SELECT p.model_id, p.place,
       CAST((SELECT count(DISTINCT t.t_idx) FROM ch_trans t WHERE t.model_id = p.model_id AND t.src = p.place) AS BIGINT) AS out_degree,
       CAST((SELECT count(DISTINCT t.t_idx) FROM ch_trans t WHERE t.model_id = p.model_id AND t.tgt = p.place) AS BIGINT) AS in_degree
FROM g_places p""")
cte("g_reach", ["g_edges"], """
SELECT model_id, src, dst FROM g_edges
UNION
SELECT r.model_id, r.src, e.dst FROM g_reach r JOIN g_edges e ON e.model_id = r.model_id AND e.src = r.dst""")
cte("g_cuts", ["ch_meta", "g_deg", "g_reach"], """
SELECT model_id, initial_step AS place FROM ch_meta WHERE coalesce(initial_step, '') <> ''
UNION SELECT model_id, place FROM g_deg WHERE out_degree > 1
UNION SELECT model_id, place FROM g_deg WHERE out_degree = 0
UNION SELECT model_id, src FROM g_reach WHERE src = dst""")
cte("g_walk", ["g_edges", "g_cuts"], """
SELECT e.model_id, e.src AS from_place, e.dst, [e.t_idx] AS transitions,
       EXISTS (SELECT 1 FROM g_cuts c WHERE c.model_id = e.model_id AND c.place = e.dst) AS dst_cut
FROM g_edges e JOIN g_cuts c0 ON c0.model_id = e.model_id AND c0.place = e.src
UNION ALL
SELECT w.model_id, w.from_place, e.dst, list_append(w.transitions, e.t_idx),
       EXISTS (SELECT 1 FROM g_cuts c WHERE c.model_id = e.model_id AND c.place = e.dst)
FROM g_walk w JOIN g_edges e ON e.model_id = w.model_id AND e.src = w.dst
WHERE NOT w.dst_cut""")
cte("g_paths", ["g_walk"], """
SELECT model_id, from_place, dst AS to_place, transitions,
       array_to_string(list_transform(transitions, lambda x: 't_' || CAST(x AS VARCHAR)), ',') || '>' || dst AS path_key
FROM g_walk WHERE dst_cut AND from_place <> dst""")
cte("g_paths_compat", ["g_walk"], """
SELECT model_id, from_place, dst AS to_place, transitions,
       array_to_string(list_transform(transitions, lambda x: 't_' || CAST(x AS VARCHAR)), ',') || '>' || dst AS path_key
FROM g_walk WHERE dst_cut AND from_place <> dst AND len(transitions) = 1""")

# ---- path semantics for D-CHART (guards are already canonical; every step adds to acc
# and copies k to last, so the transform text follows from the hop sequence) ----------
cte("g_hops", ["g_paths", "ch_trans"], """
SELECT p.model_id, p.path_key, h.hop, t.guard, t.tgt
FROM g_paths p,
     LATERAL (SELECT unnest(range(len(p.transitions))) AS hop) h
JOIN ch_trans t ON t.model_id = p.model_id AND t.t_idx = p.transitions[h.hop + 1]""")
cte("g_sem", ["g_hops", "g_paths"], """
SELECT p.model_id, p.path_key, p.from_place, p.to_place,
       (SELECT string_agg(DISTINCT h.guard, ' AND ' ORDER BY h.guard) FROM g_hops h
        WHERE h.model_id = p.model_id AND h.path_key = p.path_key) AS cond_key,
       'acc=' || repeat('(', len(p.transitions) - 1) ||
       (SELECT string_agg(CASE WHEN h.hop = 0 THEN 'acc + ' || CAST(length(h.tgt) AS VARCHAR)
                               ELSE ') + ' || CAST(length(h.tgt) AS VARCHAR) END, '' ORDER BY h.hop)
        FROM g_hops h WHERE h.model_id = p.model_id AND h.path_key = p.path_key) || '; last=k' AS xform_key
FROM g_paths p""")
cte("d_pair", ["ch_index"], """
SELECT d.model_id AS pair_id, d.model_id AS model1, w.model_id AS model2
FROM ch_index d JOIN ch_index w
  ON w.user_id = d.user_id AND w.period = 'week' AND d.period = 'day'
 AND CAST(w.period_start AS DATE) = CAST(date_trunc('week', d.period_start) AS DATE) - INTERVAL 7 DAY""")
cte("c_p1", ["d_pair", "g_sem"], """
SELECT d.pair_id, s.path_key, s.cond_key, s.xform_key FROM d_pair d JOIN g_sem s ON s.model_id = d.model1""")
cte("c_p2", ["d_pair", "g_sem"], """
SELECT d.pair_id, s.path_key, s.cond_key, s.xform_key FROM d_pair d JOIN g_sem s ON s.model_id = d.model2""")
cte("c_match", ["c_p1", "c_p2"], """
SELECT a.pair_id, a.path_key, min(b.path_key) AS match_key
FROM c_p1 a JOIN c_p2 b ON b.pair_id = a.pair_id AND b.cond_key = a.cond_key AND b.xform_key = a.xform_key
GROUP BY a.pair_id, a.path_key""")
cte("c_contain", ["d_pair", "c_p1", "c_match"], """
SELECT d.pair_id, d.model1, d.model2,
       CAST(count(a.path_key) AS BIGINT) AS paths1,
       CAST(count(m.match_key) AS BIGINT) AS matched,
       CAST(count(a.path_key) - count(m.match_key) AS BIGINT) AS unmatched,
       count(a.path_key) = count(m.match_key) AS contained,
       count(a.path_key) = 0 AS vacuous
FROM d_pair d LEFT JOIN c_p1 a ON a.pair_id = d.pair_id
LEFT JOIN c_match m ON m.pair_id = a.pair_id AND m.path_key = a.path_key
GROUP BY d.pair_id, d.model1, d.model2""")
