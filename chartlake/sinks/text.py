"""Chart renderers and file sinks (W1, W4, D-ST, PLCopen wrapping): chart rows to chart
text, structured text (two dialects), PLCopen XML and DOT lines, and a per-chart file
writer into the shared I/O folder."""

from __future__ import annotations

import itertools
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.session import ensure_checkpoint_dir, mounted

NL = "\n"


def json_str(c: Column) -> Column:
    """A JSON string literal (quotes and backslashes escaped)."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _ends(a: Column) -> Column:
    """A transition end: a plain string for one place, a JSON list for several."""
    return F.when(F.size(a) == 1, json_str(a[0])).otherwise(
        F.concat(F.lit("["), F.array_join(F.transform(a, json_str), ", "), F.lit("]")))


# W1 ------------------------------------------------------------------------------
def render_chart_text(charts: DataFrame) -> DataFrame:
    """``(model_id, content)`` in the chart-text layout: one JSON object per line in the
    ``steps`` and ``transitions`` lists, then ``variables`` and ``initial_step``."""
    steps = F.array_join(F.transform("steps", lambda s: F.concat(
        F.lit('    {"name": '), json_str(s["name"]), F.lit(', "function": '), json_str(s["function"]), F.lit("},\n"))), "")
    trans = F.array_join(F.transform("transitions", lambda t: F.concat(
        F.lit('    {"src": '), _ends(t["src"]), F.lit(', "tgt": '), _ends(t["tgt"]),
        F.lit(', "guard": '), json_str(F.coalesce(t["guard"], F.lit(""))), F.lit("},\n"))), "")
    vars_ = F.array_join(F.transform("variables", json_str), ", ")
    content = F.concat(
        F.lit("steps = [\n"), steps, F.lit("]\n\ntransitions = [\n"), trans, F.lit("]\n\nvariables = ["), vars_,
        F.lit("]\n\ninitial_step = "), json_str(F.coalesce("initial_step", F.lit(""))), F.lit("\n"))
    return charts.select("model_id", content.alias("content"))


# D-ST dialect a / b, PLCopen -----------------------------------------------------------
def render_st_a(charts: DataFrame) -> DataFrame:
    """``VAR .. END_VAR``, ``INITIAL_STEP / STEP n: body END_STEP``,
    ``TRANSITION t FROM a TO b := guard; END_TRANSITION`` inside ``PROGRAM .. END_PROGRAM``."""
    vars_ = F.array_join(F.transform("variables", lambda v: F.concat(F.lit("    "), v, F.lit(" : INT;\n"))), "")
    steps = F.array_join(F.transform("steps", lambda s: F.concat(
        F.when(s["name"] == F.col("initial_step"), F.lit("INITIAL_STEP ")).otherwise(F.lit("STEP ")), s["name"],
        F.lit(":\n    "), s["function"], F.lit(";\nEND_STEP\n"))), "")
    trans = F.array_join(F.transform("transitions", lambda t, i: F.concat(
        F.lit("TRANSITION t"), i.cast("string"), F.lit(" FROM "), t["src"][0], F.lit(" TO "), t["tgt"][0],
        F.lit(" := "), t["guard"], F.lit(";\nEND_TRANSITION\n"))), "")
    content = F.concat(F.lit("PROGRAM Chart\nVAR\n"), vars_, F.lit("END_VAR\n"), steps, trans, F.lit("END_PROGRAM\n"))
    return charts.select("model_id", content.alias("content"))


def render_st_b(charts: DataFrame) -> DataFrame:
    """``STEP n [INITIAL] ACTION Act_n;`` and ``TRANSITION FROM a TO b CONDITION g;``."""
    vars_ = F.array_join(F.transform("variables", lambda v: F.concat(F.lit("    "), v, F.lit(" : INT;\n"))), "")
    steps = F.array_join(F.transform("steps", lambda s: F.concat(
        F.lit("STEP "), s["name"], F.when(s["name"] == F.col("initial_step"), F.lit(" INITIAL")).otherwise(F.lit("")),
        F.lit(" ACTION Act_"), s["name"], F.lit(";\n"))), "")
    trans = F.array_join(F.transform("transitions", lambda t: F.concat(
        F.lit("TRANSITION FROM "), t["src"][0], F.lit(" TO "), t["tgt"][0], F.lit(" CONDITION "), t["guard"], F.lit(";\n"))), "")
    content = F.concat(F.lit("VAR\n"), vars_, F.lit("END_VAR\n"), steps, trans)
    return charts.select("model_id", content.alias("content"))


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def wrap_plcopen(st: DataFrame) -> DataFrame:
    """Structured text wrapped as the ``ST/xhtml`` body of a PLCopen program."""
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?><project xmlns="http://www.plcopen.org/xml/tc6_0201"><types><pous>'
              '<pou name="Chart" pouType="program"><body><ST><xhtml xmlns="http://www.w3.org/1999/xhtml">'),
        xml_escape(F.col("content")), F.lit("</xhtml></ST></body></pou></pous></types></project>"))
    return st.select("model_id", xml.alias("content"))


def wrap_plcopen_project(st: DataFrame, key) -> DataFrame:
    """One PLCopen project for each value of ``key``, with a program unit for each of its charts: ``(project, content)``."""
    unit = F.concat(F.lit('<pou name="'), xml_escape(F.col("model_id")), F.lit('" pouType="program"><body><ST><xhtml xmlns="http://www.w3.org/1999/xhtml">'),
                    xml_escape(F.col("content")), F.lit("</xhtml></ST></body></pou>"))
    units = st.select(key.alias("project"), unit.alias("unit")).groupBy("project").agg(F.array_join(F.sort_array(F.collect_list("unit")), "\n").alias("units"))
    return units.select("project", F.concat(F.lit('<project xmlns="http://www.plcopen.org/xml/tc6_0201"><types><pous>\n'), F.col("units"),
                                            F.lit("\n</pous></types></project>")).alias("content"))


# W4 ------------------------------------------------------------------------------
def graph_export_lines(charts: DataFrame) -> DataFrame:
    """DOT lines per chart ``(model_id, line_no, line)``: header, step nodes (initial filled),
    transition nodes, arcs, footer."""
    head = F.array(F.lit("digraph SFC {"))
    nodes = F.transform("steps", lambda s: F.concat(
        F.lit('  "'), s["name"], F.lit('" [shape=box'),
        F.when(s["name"] == F.col("initial_step"), F.lit(", style=filled")).otherwise(F.lit("")), F.lit("];")))
    tnodes = F.transform("transitions", lambda t, i: F.concat(
        F.lit('  "t_'), i.cast("string"), F.lit('" [shape=bar, label="'), F.replace(t["guard"], F.lit('"'), F.lit('\\"')), F.lit('"];')))
    arcs = F.flatten(F.transform("transitions", lambda t, i: F.concat(
        F.transform(t["src"], lambda s: F.concat(F.lit('  "'), s, F.lit('" -> "t_'), i.cast("string"), F.lit('";'))),
        F.transform(t["tgt"], lambda g: F.concat(F.lit('  "t_'), i.cast("string"), F.lit('" -> "'), g, F.lit('";'))))))
    lines = F.concat(head, nodes, tnodes, arcs, F.array(F.lit("}")))
    return charts.select("model_id", F.posexplode(lines).alias("line_no", "line"))


# file writer -----------------------------------------------------------------------
def io_root(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never overwritten, never read while written)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/chartlake-io/{name}-{uuid.uuid4().hex}"


def write_feed(docs: DataFrame, path: str) -> str:
    """Charts with their id in a column, many to a file; returns ``path``."""
    docs.select("model_id", "content").write.mode("errorifexists").json(path)
    return path


def safe_key(model_id: Column) -> Column:
    return F.regexp_replace(model_id, "/", "__")


def _folder_name(key: str | None) -> str:
    """The folder that a writer partitioned by ``model`` makes for a key."""
    if not key:
        return "model=__HIVE_DEFAULT_PARTITION__"
    return "model=" + "".join(f"%{ord(ch):02X}" if ch < " " or ch in "\x7f\"#%'*/:=?\\{[]^" else ch for ch in key)


def _write_files(rows, root: str, ext: str) -> None:
    """One file for each run of rows of one model; put in place whole, so that an attempt that runs again changes nothing."""
    for key, group in itertools.groupby(rows, key=lambda r: r["model"]):
        folder = os.path.join(root, _folder_name(key))
        os.makedirs(folder, exist_ok=True)
        part = os.path.join(folder, f".{uuid.uuid4().hex}")
        with open(part, "w", encoding="utf-8", newline="") as f:
            f.writelines((r["content"] or "") + NL for r in group)
        os.replace(part, os.path.join(folder, f"part-0.{ext}"))


def write_per_model(docs: DataFrame, path: str, ext: str = "txt") -> str:
    """One file per chart under ``path/model=<key>/``; returns ``path``.

    On a folder that all machines mount, tasks write their files themselves: Spark's writer goes through temporary
    folders and a commit for every file, which takes longer than the files by far."""
    out = docs.select(safe_key(F.col("model_id")).alias("model"), "content").repartition("model")
    root = mounted(docs.sparkSession, path)
    if root is None:
        out.write.mode("errorifexists").partitionBy("model").text(path)
        return path
    os.makedirs(root)
    out.sortWithinPartitions("model").foreachPartition(lambda rows: _write_files(rows, root, ext))
    return path
