"""Outcome routing (W6): artifacts written under ``model=<m>/status=<s>/`` so a reader prunes
to one model's successes or failures by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcome_routing(art: DataFrame, root: str) -> DataFrame:
    """Write the artifact index partitioned by (model, status), a large partition by several tasks, and return the per-partition
    file-entry counts read back from the written table."""
    art.select("path", "file", "ext", "mtime", "model", "status").hint("rebalance", "model", "status").write.mode(
        "errorifexists").partitionBy("model", "status").parquet(root)
    back = art.sparkSession.read.parquet(root)
    return back.groupBy("model", "status").agg(F.count(F.lit(1)).alias("n_files"))
