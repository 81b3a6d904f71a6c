"""Model configuration and results-sheet sources (S8, S9) and model selection."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults of the optional configuration keys, and the names ``all`` expands to.
CONFIG_DEFAULTS = {"max_tokens": 1000, "max_retries": 3, "temperature": 0.0, "top_p": 1.0, "top_k": 0, "n": 1, "stop": None}
ALL_MODELS = ["gpt4o", "gemini", "llama", "claude", "perplexity"]
CONFIG_SCHEMA = ("entry_id bigint, llm_name string, model_name string, api_key string, max_tokens int, max_retries int, "
                 "temperature double, top_p double, top_k int, n int, stop string")


def read_model_config(spark: SparkSession, path: str) -> DataFrame:
    """JSON records, as one array (in any layout) or one a line; entries missing ``llm_name``,
    ``model_name`` or ``api_key`` are dropped, optional keys get their defaults."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.trim("value").startswith("[")
    one = F.regexp_extract_all("value", F.lit(r"(?m)^\s*(\{.*\})\s*,?\s*$"), 1)
    entry = f"struct<{', '.join(c.strip().replace(' ', ':') for c in CONFIG_SCHEMA.split(','))}>"
    entries = F.when(listed, F.from_json("value", f"array<{entry}>")).otherwise(F.transform(one, lambda x: F.from_json(x, entry)))
    raw = whole.select(F.explode(entries).alias("e")).select("e.*")
    ok = raw.filter(F.col("llm_name").isNotNull() & F.col("model_name").isNotNull() & F.col("api_key").isNotNull())
    cols = [F.coalesce(F.col(k), F.lit(v).cast(raw.schema[k].dataType)).alias(k) for k, v in CONFIG_DEFAULTS.items()]
    return ok.select("entry_id", "llm_name", "model_name", "api_key", *cols)


def select_models(config: DataFrame, requested: list[str]) -> DataFrame:
    """Requested names (``all`` = the five) matched case-insensitively; for a name given
    several times in the config the last entry wins; entries with a blank key are skipped."""
    names = ALL_MODELS if "all" in [r.lower() for r in requested] else [r.lower() for r in requested]
    last = config.groupBy(F.lower("llm_name").alias("name")).agg(
        F.max_by(F.struct(*config.columns), F.col("entry_id")).alias("c"))
    req = config.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "req_ord int, name string")
    return F.broadcast(req).join(last, "name").filter(F.trim(F.col("c.api_key")) != "").select("req_ord", "name", "c.*")


#: One cell of a line: quoted (a quote inside is doubled or has a backslash), or up to the next comma.
_CELL = r'(?:^|,)("(?:[^"\\]|\\.|"")*"|[^,]*)'


def _cells(line):
    """Cells of a line of comma-separated values; an empty cell without quotes is null."""
    plain = F.regexp_extract_all(line, F.lit(_CELL), 1)
    inside = lambda c: F.regexp_replace(F.regexp_replace(F.substring(c, 2, F.length(c) - 2), '""', '"'), r"\\(.)", "$1")
    return F.transform(plain, lambda c: F.when(c.startswith('"'), inside(c)).when(c != "", c))


def read_sheet_lines(spark: SparkSession, root: str, default: str | None = None) -> DataFrame | None:
    """``(source, line, names, cells)``: each line of every ``batch_report_*.csv`` under ``root`` (else of the default sheet, else
    None) with the header names of its own file and its cells.

    Lines are read in splits; a file's header is the first line of its first split, and reaches the other lines by a
    join on the file, so no file is read whole and no list of files is collected. A cell may not hold a line break."""
    for path in [root.rstrip("/") + "/batch_report_*.csv", *([default] if default else [])]:
        try:
            text = spark.read.text(path)
            break
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    else:
        return None
    lines = text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line")).filter("line <> ''")
    heads = lines.filter("at = 0").groupBy("path").agg(F.min(F.struct("id", "line")).alias("h")).select(
        "path", F.col("h.id").alias("first"), F.transform(_cells(F.col("h.line")), lambda c: F.trim(F.coalesce(c, F.lit("")))).alias("names"))
    source = F.regexp_extract("path", r"(batch_report_[^/]*\.csv|[^/]+\.csv)", 1)
    return lines.join(heads, "path").filter("at > 0 or id > first").select(source.alias("source"), "line", "names", _cells(F.col("line")).alias("cells"))


def read_result_sheets(spark: SparkSession, root: str, default: str | None = None, faults: bool = False) -> DataFrame:
    """Every ``batch_report_*.csv`` under ``root`` (else the default sheet, else nothing), tagged with its file
    name as ``source``. Each line is read by its own file's header; columns are all names that occur in some header (only
    these reach the driver). Lines with more or fewer cells than their header are left out, and with ``faults`` given
    instead as (source, line, first cell)."""
    lines = read_sheet_lines(spark, root, default)
    if lines is None:
        return spark.createDataFrame([], "source string, line string, first string" if faults else "source string")
    whole = F.size("cells") == F.size("names")
    if faults:
        return lines.filter(~whole).select("source", "line", F.get("cells", F.lit(0)).alias("first"))
    names = sorted(r.name for r in lines.select(F.explode("names").alias("name")).distinct().collect())
    at = lambda n: F.get("cells", F.array_position("names", n).cast("int") - 1).alias(n)  # noqa: E731  (null where the file lacks it)
    return lines.filter(whole).select(*[at(n) for n in names], "source")
