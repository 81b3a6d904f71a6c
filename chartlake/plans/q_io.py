"""Registered source / sink queries: charts are written as files into the shared I/O folder
and read back (chart text, two structured-text dialects, PLCopen XML, chart maps), plus
DOT lines, report rows, reports and outcome routing."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from chartlake.charts import nest
from chartlake.functions.text import html_escape
from chartlake.operators import containment as ct
from chartlake.plans import q_runs  # noqa: F401  (registers the artifact CTEs used below)
from chartlake.plans.registry import query
from chartlake.plans.sql import compose, cte
from chartlake.sinks import text as W
from chartlake.sinks.routing import outcome_routing
from chartlake.sources import text as S
from chartlake.sources.derived import artifacts, day_week_pairs, load_attempts, load_event_charts

# corpus of the round trips: the week charts (every event is in exactly one)
cte("wk_steps", ["ch_steps"], "SELECT * FROM ch_steps WHERE contains(model_id, '/week/')")
cte("wk_trans", ["ch_trans"], "SELECT * FROM ch_trans WHERE contains(model_id, '/week/')")
cte("wk_meta", ["ch_meta"], "SELECT * FROM ch_meta WHERE contains(model_id, '/week/')")
cte("wk_summary", ["wk_steps", "wk_trans", "wk_meta"], """
SELECT m.model_id, m.initial_step,
       CAST((SELECT count(*) FROM wk_steps s WHERE s.model_id = m.model_id) AS INTEGER) AS n_steps,
       CAST((SELECT count(*) FROM wk_trans t WHERE t.model_id = m.model_id) AS INTEGER) AS n_transitions,
       'k,acc,last' AS variables,
       (SELECT string_agg(s.name || '=' || s.function, '|' ORDER BY s.ord) FROM wk_steps s WHERE s.model_id = m.model_id) AS steps_text,
       (SELECT string_agg(s.name || '=Act_' || s.name, '|' ORDER BY s.ord) FROM wk_steps s WHERE s.model_id = m.model_id) AS actions_text,
       coalesce((SELECT string_agg(t.src || '>' || t.tgt || ':' || t.guard, '|' ORDER BY t.t_idx) FROM wk_trans t
                 WHERE t.model_id = m.model_id), '') AS trans_text
FROM wk_meta m""")
cte("wk_text", ["wk_steps", "wk_trans", "wk_meta"], """
SELECT m.model_id,
  'steps = [' || chr(10) ||
  (SELECT string_agg('    {"name": "' || s.name || '", "function": "' || s.function || '"},' || chr(10), '' ORDER BY s.ord)
   FROM wk_steps s WHERE s.model_id = m.model_id) || ']' || chr(10) || chr(10) || 'transitions = [' || chr(10) ||
  coalesce((SELECT string_agg('    {"src": "' || t.src || '", "tgt": "' || t.tgt || '", "guard": "' || t.guard || '"},' || chr(10), ''
            ORDER BY t.t_idx) FROM wk_trans t WHERE t.model_id = m.model_id), '') || ']' || chr(10) || chr(10) ||
  'variables = ["k", "acc", "last"]' || chr(10) || chr(10) || 'initial_step = "' || m.initial_step || '"' || chr(10) AS content
FROM wk_meta m""")

SUMMARY_SQL = "SELECT model_id, initial_step, n_steps, n_transitions, variables, {steps} AS steps_text, trans_text FROM wk_summary"


def _week_charts(spark, sf):
    c, _ = load_event_charts(spark, sf, periods=("week",))
    return nest(c)


def summary(parsed):
    """Comparable text summary of parsed charts."""
    return parsed.select(
        "model_id", "initial_step", F.size("steps").cast("int").alias("n_steps"),
        F.size("transitions").cast("int").alias("n_transitions"), F.array_join("variables", ",").alias("variables"),
        F.array_join(F.transform("steps", lambda s: F.concat(s["name"], F.lit("="), s["function"])), "|").alias("steps_text"),
        F.array_join(F.transform("transitions", lambda t: F.concat(
            F.array_join(t["src"], ","), F.lit(">"), F.array_join(t["tgt"], ","), F.lit(":"), t["guard"])), "|").alias("trans_text"))


def _read_back(spark, root):
    files = S.scan_text_corpus(spark, root)
    return files.select(S.model_from_path(F.col("path")).alias("model_id"), "ext", "content")


# W1 / S1 / S2 / S7 ---------------------------------------------------------------------
@query("write_chart_text", compose("SELECT model_id, content FROM wk_text", "wk_text"))
def q_write_chart_text(spark, sf):
    return W.render_chart_text(_week_charts(spark, sf))


def _chart_files(spark, sf):
    root = W.io_root(spark, "chart-text")
    W.write_per_model(W.render_chart_text(_week_charts(spark, sf)), root)
    return root


@query("scan_text_corpus", compose(
    "SELECT model_id, 'txt' AS ext, CAST(strlen(content) + 1 AS BIGINT) AS n_bytes FROM wk_text", "wk_text"))
def q_scan_text_corpus(spark, sf):
    r = _read_back(spark, _chart_files(spark, sf))
    return r.select("model_id", "ext", F.octet_length("content").cast("bigint").alias("n_bytes"))


@query("scan_chart_text", compose(SUMMARY_SQL.format(steps="steps_text"), "wk_summary"))
def q_scan_chart_text(spark, sf):
    feed = W.write_feed(W.render_chart_text(_week_charts(spark, sf)), W.io_root(spark, "chart-text"))
    return summary(S.split_parsed(S.parse_chart_text(S.read_feed(spark, feed)))[0])


# S2 with faults: every third user's charts in another layout, one user in seven with a broken list
_FAULT_SQL = "CAST(split_part(model_id, '/', 1) AS BIGINT)"


def _faulty_feed(spark, sf):
    docs = W.render_chart_text(_week_charts(spark, sf))
    user = F.substring_index("model_id", "/", 1).cast("bigint")
    other = F.regexp_replace(F.col("content"), r"\]\n\ntransitions = \[", "],\n  # next list\n  transitions2=[")
    broken = F.regexp_replace(F.col("content"), r'\{"name": "', '{"name: "')
    docs = docs.withColumn("content", F.when(user % 7 == 3, broken).when(user % 3 == 1, other).otherwise(F.col("content")))
    return S.read_feed(spark, W.write_feed(docs, W.io_root(spark, "chart-faults")))


@query("scan_chart_text_status", compose(f"""
SELECT model_id, CASE WHEN {_FAULT_SQL} % 7 = 3 THEN 'steps malformed' ELSE '' END AS issues,
       CASE WHEN {_FAULT_SQL} % 7 = 3 THEN NULL ELSE n_steps END AS n_steps, n_transitions, initial_step FROM wk_summary""", "wk_summary"))
def q_scan_chart_text_status(spark, sf):
    got = S.parse_chart_text(_faulty_feed(spark, sf))
    return got.select("model_id", F.array_join("issues", ",").alias("issues"),
                      F.when(F.col("steps").isNotNull(), F.size("steps")).cast("int").alias("n_steps"),
                      F.size("transitions").cast("int").alias("n_transitions"), "initial_step")


@query("type_check_faults", compose(f"""
SELECT model_id, {_FAULT_SQL} % 7 <> 3 AS steps_ok, true AS transitions_ok, {_FAULT_SQL} % 7 <> 3 AS ok FROM wk_summary""", "wk_summary"))
def q_type_check_faults(spark, sf):
    from chartlake.operators.typecheck import type_check
    return type_check(S.parse_chart_text(_faulty_feed(spark, sf))).select("model_id", "steps_ok", "transitions_ok", "ok")


@query("detect_dialect", compose("""
SELECT 'chart' AS dialect, count(*) AS n_files FROM wk_meta UNION ALL SELECT 'st', count(*) FROM wk_meta""", "wk_meta"))
def q_detect_dialect(spark, sf):
    charts = _week_charts(spark, sf)
    feed = W.write_feed(W.render_chart_text(charts).unionByName(W.render_st_a(charts)), W.io_root(spark, "mixed"))
    f = S.read_feed(spark, feed)
    return f.groupBy(S.detect_dialect(F.col("content")).alias("dialect")).agg(F.count(F.lit(1)).alias("n_files"))


# S4 / S5 / S6 --------------------------------------------------------------------------
@query("scan_st_dialect_a", compose(SUMMARY_SQL.format(steps="steps_text"), "wk_summary"))
def q_scan_st_dialect_a(spark, sf):
    feed = W.write_feed(W.render_st_a(_week_charts(spark, sf)), W.io_root(spark, "st-a"))
    return summary(S.parse_st_dialect_a(S.read_feed(spark, feed)))


@query("scan_st_dialect_b", compose(SUMMARY_SQL.format(steps="actions_text"), "wk_summary"))
def q_scan_st_dialect_b(spark, sf):
    feed = W.write_feed(W.render_st_b(_week_charts(spark, sf)), W.io_root(spark, "st-b"))
    return summary(S.parse_st_dialect_b(S.read_feed(spark, feed)))


@query("scan_plcopen_xml", compose(SUMMARY_SQL.format(steps="steps_text"), "wk_summary"))
def q_scan_plcopen_xml(spark, sf):
    feed = W.write_feed(W.wrap_plcopen(W.render_st_a(_week_charts(spark, sf))), W.io_root(spark, "plcopen"))
    return summary(S.parse_st_dialect_a(S.extract_plcopen_st(S.read_feed(spark, feed))))


@query("scan_plcopen_project", compose(SUMMARY_SQL.format(steps="steps_text"), "wk_summary"))
def q_scan_plcopen_project(spark, sf):
    """Projects of many program units (the week charts of 20 users), a file each, read one row a unit."""
    st = W.render_st_a(_week_charts(spark, sf))
    root = W.io_root(spark, "plcopen-projects")
    project = F.floor(F.substring_index("model_id", "/", 1).cast("bigint") / 20)
    W.wrap_plcopen_project(st, project).select("content").write.option("maxRecordsPerFile", 1).text(root)
    return summary(S.parse_st_dialect_a(S.read_plcopen_pous(spark, root).select("model_id", "content")))


# S3 ---------------------------------------------------------------------------------------
@query("scan_chart_json_map", compose(SUMMARY_SQL.format(steps="steps_text"), "wk_summary"))
def q_scan_chart_json_map(spark, sf):
    charts = _week_charts(spark, sf)
    user = F.substring_index("model_id", "/", 1)
    # one record per user: {chart name: chart} (a user's week charts, bounded by the calendar)
    rec = charts.groupBy(user.alias("user")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        "model_id", F.struct("steps", "transitions", "variables", "initial_step"))))).alias("value"))
    root = W.io_root(spark, "chart-map")
    rec.select("value").write.text(root)
    return summary(S.parse_chart_map(spark.read.text(root)))


# W4 --------------------------------------------------------------------------------------
cte("dot_lines", ["wk_steps", "wk_trans", "wk_meta"], """
SELECT model_id, 0 AS line_no, 'digraph SFC {' AS line FROM wk_meta
UNION ALL
SELECT s.model_id, s.ord + 1, '  "' || s.name || '" [shape=box' || CASE WHEN s.name = m.initial_step THEN ', style=filled' ELSE '' END || '];'
FROM wk_steps s JOIN wk_meta m USING (model_id)
UNION ALL
SELECT t.model_id, n.ns + 1 + t.t_idx, '  "t_' || CAST(t.t_idx AS VARCHAR) || '" [shape=bar, label="' || t.guard || '"];'
FROM wk_trans t JOIN (SELECT model_id, count(*) AS ns FROM wk_steps GROUP BY model_id) n USING (model_id)
UNION ALL
SELECT t.model_id, n.ns + coalesce(n2.nt, 0) + 1 + 2 * t.t_idx, '  "' || t.src || '" -> "t_' || CAST(t.t_idx AS VARCHAR) || '";'
FROM wk_trans t JOIN (SELECT model_id, count(*) AS ns FROM wk_steps GROUP BY model_id) n USING (model_id)
LEFT JOIN (SELECT model_id, count(*) AS nt FROM wk_trans GROUP BY model_id) n2 USING (model_id)
UNION ALL
SELECT t.model_id, n.ns + coalesce(n2.nt, 0) + 2 + 2 * t.t_idx, '  "t_' || CAST(t.t_idx AS VARCHAR) || '" -> "' || t.tgt || '";'
FROM wk_trans t JOIN (SELECT model_id, count(*) AS ns FROM wk_steps GROUP BY model_id) n USING (model_id)
LEFT JOIN (SELECT model_id, count(*) AS nt FROM wk_trans GROUP BY model_id) n2 USING (model_id)
UNION ALL
SELECT m.model_id, coalesce(n.ns, 0) + 2 * coalesce(n2.nt, 0) + coalesce(n2.nt, 0) + 1, '}'
FROM wk_meta m LEFT JOIN (SELECT model_id, count(*) AS ns FROM wk_steps GROUP BY model_id) n USING (model_id)
LEFT JOIN (SELECT model_id, count(*) AS nt FROM wk_trans GROUP BY model_id) n2 USING (model_id)""")


@query("graph_export_lines", compose("SELECT model_id, CAST(line_no AS INTEGER) AS line_no, line FROM dot_lines", "dot_lines"))
def q_graph_export_lines(spark, sf):
    g = W.graph_export_lines(_week_charts(spark, sf))
    return g.select("model_id", F.col("line_no").cast("int"), "line")


# W3 / W2 ---------------------------------------------------------------------------------
def _esc_sql(x):
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), "
            f"'''', '&#x27;')")


@query("containment_report_rows", compose(f"""
SELECT a.pair_id, a.path_key, CASE WHEN m.match_key IS NULL THEN 'unmatched' ELSE 'matched' END AS status,
       '<tr><td>' || {_esc_sql('a.path_key')} || '</td><td>' || {_esc_sql('a.cond_key')} || '</td><td>'
       || {_esc_sql('a.xform_key')} || '</td><td>' || coalesce({_esc_sql('m.match_key')}, '-') || '</td></tr>' AS row_html
FROM c_p1 a LEFT JOIN c_match m ON m.pair_id = a.pair_id AND m.path_key = a.path_key""", "c_p1", "c_match"))
def q_containment_report_rows(spark, sf):
    c, idx = load_event_charts(spark, sf)
    idx = idx.persist()
    p1, p2 = ct.pair_paths(c.persist(), day_week_pairs(idx), expand=False)
    j = p1.join(ct.path_match(p1, p2), ["pair_id", "path_key"], "left")
    td = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), td(html_escape(F.col("path_key"))), td(html_escape(F.col("cond_key"))),
                   td(html_escape(F.col("xform_key"))), td(F.coalesce(F.when(F.col("match_key").isNotNull(), html_escape(F.col("match_key"))), F.lit("-"))),
                   F.lit("</tr>"))
    return j.select("pair_id", "path_key", F.when(F.col("match_key").isNull(), "unmatched").otherwise("matched").alias("status"),
                    row.alias("row_html"))


@query("containment_report_json")
def q_containment_report_json(spark, sf):
    from chartlake.sinks.reports import containment_report
    c, idx = load_event_charts(spark, sf)
    idx = idx.persist()
    return containment_report(c.persist(), day_week_pairs(idx))


@query("containment_report_counts", compose("""
SELECT d.pair_id, d.model1, d.model2, CAST(count(a.path_key) AS BIGINT) AS paths1, CAST(count(m.match_key) AS BIGINT) AS matched,
       CAST(count(a.path_key) - count(m.match_key) AS BIGINT) AS unmatched, count(a.path_key) = count(m.match_key) AS contained,
       coalesce(string_agg(CASE WHEN m.match_key IS NOT NULL THEN a.path_key || ' = ' || m.match_key END, '|' ORDER BY a.path_key), '') AS matched_paths,
       coalesce(string_agg(CASE WHEN m.match_key IS NULL THEN a.path_key END, '|' ORDER BY a.path_key), '') AS unmatched_paths,
       (SELECT string_agg(g.place, ',' ORDER BY g.place) FROM g_cuts g WHERE g.model_id = d.model1) AS cutpoints1
FROM d_pair d LEFT JOIN c_p1 a ON a.pair_id = d.pair_id LEFT JOIN c_match m ON m.pair_id = a.pair_id AND m.path_key = a.path_key
GROUP BY d.pair_id, d.model1, d.model2""", "d_pair", "c_p1", "c_match", "g_cuts"))
def q_containment_report_counts(spark, sf):
    """W2 read back: counts and path lists out of each JSON document."""
    path = "struct<path_key:string,match_key:string>"
    doc = F.from_json("report", f"struct<model1:string,model2:string,cutpoints1:array<string>,matched_paths:array<{path}>,unmatched_paths:array<{path}>,"
                                "summary:struct<paths1:bigint,matched:bigint,unmatched:bigint,contained:boolean>>")
    d = q_containment_report_json(spark, sf).select("pair_id", doc.alias("d"))
    return d.select(
        "pair_id", "d.model1", "d.model2", "d.summary.paths1", "d.summary.matched", "d.summary.unmatched", "d.summary.contained",
        F.array_join(F.transform("d.matched_paths", lambda p: F.concat_ws(" = ", p["path_key"], p["match_key"])), "|").alias("matched_paths"),
        F.array_join(F.transform("d.unmatched_paths", lambda p: p["path_key"]), "|").alias("unmatched_paths"),
        F.array_join("d.cutpoints1", ",").alias("cutpoints1"))


# W6 --------------------------------------------------------------------------------------
@query("outcome_routing", compose("""
SELECT model, status, count(*) AS n_files FROM art GROUP BY model, status""", "art"))
def q_outcome_routing(spark, sf):
    art = artifacts(load_attempts(spark, sf))
    root = W.io_root(spark, "routing")
    return outcome_routing(art, root)


# S10 on real folders ----------------------------------------------------------------------
@query("list_output_files", compose("""
SELECT model, status, ext, count(*) AS n_entries FROM art WHERE status = 'success' GROUP BY model, status, ext""", "art"))
def q_list_output_files(spark, sf):
    """Artifact lists written as files below model and status folders; the success folders listed by time and name, and only the
    files of the listing read back."""
    root = W.io_root(spark, "outputs")
    begun = datetime.now(timezone.utc) - timedelta(seconds=5)
    artifacts(load_attempts(spark, sf)).select("path", "ext", "model", "status").hint("rebalance", "model", "status").write.partitionBy("model", "status").csv(root)
    listed = S.list_output_files(spark, root, since=begun, name="*.csv", status="success")
    lines = spark.read.schema("path string, ext string").option("recursiveFileLookup", "true").csv(root).select(
        F.col("_metadata.file_path").alias("from"), F.col("ext").alias("of"))
    return listed.join(lines, F.regexp_replace("path", "^file:/*", "/") == F.regexp_replace("from", "^file:/*", "/")).groupBy(
        "model", "status", F.col("of").alias("ext")).agg(F.count(F.lit(1)).alias("n_entries"))
