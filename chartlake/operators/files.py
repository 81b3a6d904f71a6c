"""File-list operators (J1, J2, P3, R4): positional pairing of two sorted listings,
the unpaired report and the test type taken from a path segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.operators.ranking import positions


def ranked(files: DataFrame, side: str) -> DataFrame:
    """Position of each path in its folder's sorted listing."""
    return positions(files.filter(F.col("side") == side).select("folder", "path"), ["folder"], ["path"])


def pair_by_position(files: DataFrame) -> DataFrame:
    """Zip the sorted ``src`` and ``mod`` listings of each folder (shorter list wins)."""
    s = ranked(files, "src").withColumnRenamed("path", "src_path")
    m = ranked(files, "mod").withColumnRenamed("path", "mod_path")
    return s.join(m, ["folder", "rank"])


def unpaired(files: DataFrame) -> DataFrame:
    """Listing entries without a partner at the same position."""
    s = ranked(files, "src").withColumnRenamed("path", "src_path")
    m = ranked(files, "mod").withColumnRenamed("path", "mod_path")
    j = s.join(m, ["folder", "rank"], "full")
    return j.filter(F.col("src_path").isNull() | F.col("mod_path").isNull()).select(
        "folder", "rank", F.when(F.col("src_path").isNull(), "mod").otherwise("src").alias("side"),
        F.coalesce("src_path", "mod_path").alias("path"))


def test_type_from_path(path: Column, marker: str = "new_benchmarks") -> Column:
    """The path segment after ``marker``, else ``unknown``."""
    parts = F.split(path, "/")
    pos = F.array_position(parts, marker)
    return F.coalesce(F.when(pos > 0, F.try_element_at(parts, (pos + 1).cast("int"))), F.lit("unknown"))
