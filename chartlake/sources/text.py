"""Text sources (S1-S7): file listings and chart parsers for chart text, two structured-
text dialects, PLCopen XML and chart maps. Parsing is regex extraction + ``from_json`` /
``xpath_string`` on whole-file rows; Python only lists and opens the files of a mounted folder."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from unicodedata import category
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.functions.text import strip_ws
from chartlake.session import mounted

# Extensions treated as text (extensionless files are kept too).
TEXT_EXTENSIONS = ["txt", "md", "rst", "log", "csv", "tsv", "json", "xml", "yaml", "yml", "ini", "cfg", "conf"]

STEPS_T = "array<struct<name:string,function:string>>"
TRANS_RAW_T = "array<struct<src:string,tgt:string,guard:string>>"


# S1 ------------------------------------------------------------------------------
def _shown(name: bytes, folder: bool) -> bool:
    """Whether Spark's file sources read a folder or file of this name."""
    if (name.startswith(b"_") and b"=" not in name) or name.startswith(b"."):
        return folder and name.startswith((b"_metadata", b"_common_metadata"))
    return not name.endswith(b"._COPYING_")


def _entries(folder: bytes) -> Iterator[tuple[bytes, bool]]:
    """(path, whether it is a folder) of what is in a folder, as it is listed."""
    with os.scandir(folder) as found:
        for e in found:
            is_folder = e.is_dir()
            if (is_folder or e.is_file()) and _shown(e.name, is_folder):
                yield e.path, is_folder


def _files(path: bytes, is_folder: bool) -> Iterator[bytes]:
    if not is_folder:
        yield path
        return
    for entry in _entries(path):
        yield from _files(*entry)


def _uri(path: bytes) -> str:
    """A path as ``_metadata.file_path`` spells it: letters beyond ASCII stay, what an URI cannot hold is escaped."""
    text = path.decode("utf-8", "replace")
    return "file:" + "".join(c if c > "\xa0" and category(c)[0] != "Z" else quote(c, safe="/;:@&=+$,-_.!~*'()") for c in text)


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], rows_most: int = 1000, bytes_most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size; the last value of a row is what may be large."""
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    for r in rows:
        held.append(r)
        size += len(r[-1]) if isinstance(r[-1], bytes) else 0
        if len(held) >= rows_most or size >= bytes_most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))


def _mounted_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, file)`` of all files below a folder that all machines mount. One task lists the folder itself and others
    what is in it, as streams: no process holds the listing, however many files there are."""
    top, tasks = os.fsencode(folder.rstrip("/") or "/"), _tasks(spark)

    def listed(_):
        return _batches(_entries(top), ["entry", "folder"], [pa.binary(), pa.bool_()], 10_000)

    def walked(batches):
        return _batches(((_uri(f), f) for e in _rows(batches) for f in _files(*e)), ["path", "file"], [pa.string(), pa.binary()], 10_000)

    return (spark.range(0, 1, 1, 1).mapInArrow(listed, "entry binary, folder boolean").repartition(tasks, "entry")
            .mapInArrow(walked, "path string, file binary"))


def _tasks(spark: SparkSession) -> int:
    """Tasks that files are dealt to: sizes of paths say nothing about the work, so partitions are not left to AQE."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path, extension and bytes of each file; empty files are left out, as by Spark's file sources."""

    def read():
        for path, file, ext in _rows(batches):
            with open(file, "rb") as f:
                data = f.read()
            if data:
                yield path, ext, data

    return _batches(read(), ["path", "ext", "content"], [pa.string(), pa.string(), pa.binary()])


def scan_text_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``(path, ext, content)`` for every text file below ``root`` (recursive), in no order. Each file is one row.

    Spark's file sources hold the status and the split of every file in the driver, some kilobytes a file. Below a folder
    that all machines mount, tasks therefore list and read the files; other roots (another scheme, a glob, one file) are read
    by Spark's source."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    is_text = F.col("ext").isin(TEXT_EXTENSIONS) | (F.col("ext") == "")
    folder = mounted(spark, root)
    if folder is not None and os.path.isdir(folder) and not re.search(r"[*?\[\]{}\\]", folder):
        files = _mounted_files(spark, folder).withColumn("ext", ext).filter(is_text).repartition(_tasks(spark), "path")
        read = files.mapInArrow(_contents, "path string, ext string, content binary")
        return read.select("path", "ext", F.col("content").cast("string").alias("content"))
    df = (spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
          .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
    return df.select("path", ext.alias("ext"), "content").filter(is_text)


# S10 -----------------------------------------------------------------------------
def list_output_files(spark: SparkSession, root: str, since: datetime | None = None, name: str = "*", model: str = "*",
                      status: str = "*") -> DataFrame:
    """``(path, file, ext, model, status, mtime, length)`` of the files in the folders ``model=<m>/status=<s>`` below ``root`` that were
    changed at or after ``since``.

    Model, status and file name are globs; folders that do not match are not listed, and time and name are tested while
    folders are listed (in parallel, where there are many). No file is opened. No matching folder gives no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    if since is not None:  # the listing compares whole seconds; the filter below is exact
        files = files.option("modifiedAfter", (since - timedelta(seconds=1)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", "UTC")
    schema = "path string, file string, ext string, model string, status string, mtime timestamp, length bigint"
    try:
        found = files.load(f"{root.rstrip('/')}/model={model}/status={status}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    part = lambda key: F.url_decode(F.regexp_replace(F.regexp_extract("path", rf"/{key}=([^/]+)/", 1), r"\+", "%2B"))
    got = found.select("path", F.col("modificationTime").alias("mtime"), "length")
    if since is not None:
        got = got.filter(F.col("mtime") >= F.lit(since))
    file = F.regexp_extract("path", r"([^/]*)$", 1)
    return got.select("path", file.alias("file"), F.lower(F.regexp_extract(file, r"\.([^./]+)$", 1)).alias("ext"), part("model").alias("model"),
                      part("status").alias("status"), "mtime", "length")


def model_from_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"model=([^/]+)", 1), "__", "/")


# S2 ------------------------------------------------------------------------------
def _strip_comments(block: Column) -> Column:
    b = F.regexp_replace(block, r"(?m)^\s*#[^\n]*$", "")
    b = F.regexp_replace(b, r"(?m)#[^\"'\n]*$", "")
    return F.regexp_replace(b, r",(\s*[\]}])", "$1")


def _section(content: Column, name: str) -> Column:
    """The list assigned to ``name`` (``name1``, ``name2`` … too), ending at the ``]`` that is followed by the next
    assignment, a closing bracket or the end of the text; a comma and comment lines may stand between."""
    pat = rf"(?s)\b{name}\d*\s*=\s*(\[.*?\])\s*,?\s*(?:#[^\n]*\s*)*(?=[A-Za-z_]+\d*\s*=(?!=)|\)|\z)"
    return F.regexp_extract(content, pat, 1)


def _opened(content: Column, name: str) -> Column:
    return content.rlike(rf"\b{name}\d*\s*=\s*\[")


def _ends(c: Column) -> Column:
    return F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))


def parse_chart_text(docs: DataFrame, content: str = "content") -> DataFrame:
    """Chart text to the chart layout plus ``issues``.

    A missing section gives an empty list / NULL as before. A section that is there but cannot be read gives NULL and
    an issue (``steps malformed``, …): such a chart failed, and must not be taken for an empty one (``split_parsed``)."""
    t = F.col(content)
    single = {"allowSingleQuotes": "true"}

    def read(name: str, kind: str) -> Column:
        block = _section(t, name)
        return F.when(block != "", F.from_json(_strip_comments(block), kind, single)).when(
            ~_opened(t, name), F.expr(f"cast(array() as {kind})"))

    st, tr, va = read("steps", STEPS_T), read("transitions", TRANS_RAW_T), read("variables", "array<string>")
    init = F.regexp_extract(t, r"initial_step\s*=\s*[\"']([^\"']+)[\"']", 1)
    cols = [c for c in docs.columns if c != content]
    got = docs.select(*cols, st.alias("steps"), tr.alias("_tr"), va.alias("variables"), F.when(init != "", init).alias("initial_step"))
    bad = lambda c, name: F.when(c.isNull() | F.exists(c, lambda x: x.isNull()), F.lit(f"{name} malformed"))
    trans = F.transform("_tr", lambda x: F.struct(_ends(x["src"]).alias("src"), _ends(x["tgt"]).alias("tgt"), x["guard"].alias("guard")))
    issues = F.array_compact(F.array(bad(F.col("steps"), "steps"), bad(F.col("_tr"), "transitions"), bad(F.col("variables"), "variables")))
    return got.select(*cols, "steps", trans.alias("transitions"), "variables", "initial_step", issues.alias("issues"))


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(charts that were read, rows for the quarantine table) of ``parse_chart_text``'s output."""
    return parsed.filter(F.size("issues") == 0).drop("issues"), parsed.filter(F.size("issues") > 0)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """``(model_id, content)`` of a feed with many charts a file (``sinks.text.write_feed``)."""
    return spark.read.schema("model_id string, content string").json(path)


# S4 ------------------------------------------------------------------------------
# The step and transition patterns below are the grammar of the two dialects.
def parse_st_dialect_a(docs: DataFrame, content: str = "content") -> DataFrame:
    t = F.col(content)
    var_block = F.regexp_extract(t, r"(?is)VAR(.*?)END_VAR", 1)
    variables = F.transform(F.filter(F.transform(F.split(var_block, ";"), strip_ws), lambda x: x.contains(":")),
                            lambda x: strip_ws(F.substring_index(x, ":", 1)))
    step_re = r"(?is)(?:INITIAL_STEP|STEP)\s+(\w+)\s*:\s*(.*?)\s*END_STEP"
    names = F.regexp_extract_all(t, F.lit(step_re), 1)
    bodies = F.regexp_extract_all(t, F.lit(step_re), 2)
    return _st_result(docs, content, variables, names, bodies, t)


def _rstrip_semi(c: Column) -> Column:
    return F.regexp_replace(strip_ws(c), r";+$", "")


def _st_result(docs, content, variables, names, bodies, t):
    steps = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.struct(
        F.element_at(names, i).alias("name"), _rstrip_semi(F.element_at(bodies, i)).alias("function")))
    steps = F.when(F.size(names) > 0, steps).otherwise(F.expr(f"cast(array() as {STEPS_T})"))
    tre = r"(?is)TRANSITION\s+\w+\s+FROM\s+(\w+)\s+TO\s+(\w+)\s*:=\s*(.*?)\s*END_TRANSITION"
    srcs, tgts, gs = (F.regexp_extract_all(t, F.lit(tre), i) for i in (1, 2, 3))
    trans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(srcs), F.lit(1))), lambda i: F.struct(
        F.array(F.element_at(srcs, i)).alias("src"), F.array(F.element_at(tgts, i)).alias("tgt"),
        _rstrip_semi(F.element_at(gs, i)).alias("guard")))
    trans = F.when(F.size(srcs) > 0, trans).otherwise(F.expr("cast(array() as array<struct<src:array<string>,tgt:array<string>,guard:string>>)"))
    init = F.regexp_extract(t, r"(?i)INITIAL_STEP\s+(\w+)\s*:", 1)
    cols = [c for c in docs.columns if c != content]
    return docs.select(*cols, steps.alias("steps"), trans.alias("transitions"), variables.alias("variables"),
                       F.when(init != "", init).alias("initial_step"))


# S5 ------------------------------------------------------------------------------
def parse_st_dialect_b(docs: DataFrame, content: str = "content") -> DataFrame:
    """``STEP n [INITIAL] ACTION f;`` / ``TRANSITION FROM a TO b CONDITION g;``. Guards are
    kept as written; ``normalize_guard`` gives the comparable form."""
    t = F.col(content)
    var_block = F.regexp_extract(t, r"(?s)VAR(.*?)END_VAR", 1)
    variables = F.transform(F.filter(F.transform(F.split(var_block, "\n"), strip_ws), lambda x: x.contains(":")),
                            lambda x: strip_ws(F.substring_index(x, ":", 1)))
    sre = r"(?s)STEP\s+(\w+)(\s+INITIAL)?\s+ACTION\s+([\w()]+);"
    names = F.regexp_extract_all(t, F.lit(sre), 1)
    inits = F.regexp_extract_all(t, F.lit(sre), 2)
    acts = F.regexp_extract_all(t, F.lit(sre), 3)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(names), F.lit(1))), lambda i: F.struct(
        F.element_at(names, i).alias("name"), F.element_at(acts, i).alias("function")))
    steps = F.when(F.size(names) > 0, steps).otherwise(F.expr(f"cast(array() as {STEPS_T})"))
    init_pos = F.array_position(F.transform(inits, lambda x: x != ""), True)
    init = F.when(init_pos > 0, F.element_at(names, init_pos.cast("int")))
    tre = r"(?s)TRANSITION\s+FROM\s+(\w+)\s+TO\s+(\w+)\s+CONDITION\s+(.*?);"
    srcs, tgts, gs = (F.regexp_extract_all(t, F.lit(tre), i) for i in (1, 2, 3))
    trans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(srcs), F.lit(1))), lambda i: F.struct(
        F.array(F.element_at(srcs, i)).alias("src"), F.array(F.element_at(tgts, i)).alias("tgt"),
        strip_ws(F.element_at(gs, i)).alias("guard")))
    trans = F.when(F.size(srcs) > 0, trans).otherwise(F.expr("cast(array() as array<struct<src:array<string>,tgt:array<string>,guard:string>>)"))
    cols = [c for c in docs.columns if c != content]
    return docs.select(*cols, steps.alias("steps"), trans.alias("transitions"), variables.alias("variables"),
                       init.alias("initial_step"))


# S6 ------------------------------------------------------------------------------
ST_XPATH = "//*[local-name()='ST']/*[local-name()='xhtml']"


def extract_plcopen_st(docs: DataFrame, content: str = "content") -> DataFrame:
    """Structured text of a PLCopen XML document (the ``ST/xhtml`` element's text)."""
    cols = [c for c in docs.columns if c != content]
    return docs.select(*cols, F.expr(f"xpath_string({content}, \"{ST_XPATH}\")").alias(content))


def read_plcopen_pous(spark: SparkSession, path: str) -> DataFrame:
    """``(model_id, pou_type, content)``: one row for each program unit (``pou`` with an ``ST/xhtml`` body) of the PLCopen projects
    below ``path``. Files are read as a stream of ``pou`` elements, so a project of many units is never one string."""
    unit = "_name string, _pouType string, body struct<ST:struct<xhtml:struct<_VALUE:string>>>"
    got = spark.read.format("xml").option("rowTag", "pou").option("ignoreSurroundingSpaces", "false").schema(unit).load(path)
    return got.select(F.col("_name").alias("model_id"), F.col("_pouType").alias("pou_type"), F.col("body.ST.xhtml._VALUE").alias("content")).filter("content is not null")


# S7 ------------------------------------------------------------------------------
def detect_dialect(content: Column) -> Column:
    return F.when(content.contains("PROGRAM") & content.contains("END_PROGRAM"), "st").otherwise("chart")


# S3 ------------------------------------------------------------------------------
MAP_T = ("map<string,struct<steps:array<struct<name:string,function:string>>,"
         "transitions:array<struct<src:array<string>,tgt:array<string>,guard:string>>,"
         "variables:array<string>,initial_step:string>>")


def parse_chart_map(docs: DataFrame, content: str = "value") -> DataFrame:
    """JSON records mapping chart names to chart objects -> one row per chart."""
    m = F.from_json(F.col(content), MAP_T)
    return docs.select(F.explode(m).alias("model_id", "c")).select(
        "model_id", "c.steps", "c.transitions", "c.variables", "c.initial_step")
