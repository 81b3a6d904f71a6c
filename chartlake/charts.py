"""The chart data model.

A chart corpus is held as three keyed DataFrames (never one Python object per chart):

* ``steps(model_id, ord, name, function)``
* ``transitions(model_id, t_idx, src ARRAY<STRING>, tgt ARRAY<STRING>, guard)``
* ``meta(model_id, variables ARRAY<STRING>, initial_step)``

``nest`` / ``unnest`` convert to and from the one-row-per-chart layout
``charts(model_id, steps ARRAY<STRUCT<name,function>>, transitions ARRAY<STRUCT<src,tgt,guard>>,
variables, initial_step)`` used by the text sources and sinks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP_T = "struct<name:string,function:string>"
TRANS_T = "struct<src:array<string>,tgt:array<string>,guard:string>"
CHART_SCHEMA = (
    "model_id string, steps array<struct<name:string,function:string>>, "
    "transitions array<struct<src:array<string>,tgt:array<string>,guard:string>>, "
    "variables array<string>, initial_step string"
)


@dataclass
class Charts:
    steps: DataFrame
    transitions: DataFrame
    meta: DataFrame

    def persist(self) -> "Charts":
        return Charts(self.steps.persist(), self.transitions.persist(), self.meta.persist())


def nest(c: Charts) -> DataFrame:
    """One row per chart; lists are ordered by position. Lists are bounded by the
    chart's own size (distinct steps / transitions), not by the event volume."""
    st = c.steps.groupBy("model_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", F.struct("name", "function").alias("s")))).alias("_s")
    ).select("model_id", F.transform("_s", lambda x: x["s"]).alias("steps"))
    tr = c.transitions.groupBy("model_id").agg(
        F.sort_array(F.collect_list(F.struct("t_idx", F.struct("src", "tgt", "guard").alias("t")))).alias("_t")
    ).select("model_id", F.transform("_t", lambda x: x["t"]).alias("transitions"))
    return (
        c.meta.join(st, "model_id", "left")
        .join(tr, "model_id", "left")
        .select(
            "model_id",
            F.coalesce("steps", F.expr(f"cast(array() as array<{STEP_T}>)")).alias("steps"),
            F.coalesce("transitions", F.expr(f"cast(array() as array<{TRANS_T}>)")).alias("transitions"),
            "variables",
            "initial_step",
        )
    )


def unnest(charts: DataFrame) -> Charts:
    """Inverse of ``nest``; ``ord`` / ``t_idx`` are 0-based list positions."""
    steps = charts.select("model_id", F.posexplode("steps").alias("ord", "s")).select(
        "model_id", "ord", F.col("s.name").alias("name"), F.col("s.function").alias("function")
    )
    trans = charts.select("model_id", F.posexplode("transitions").alias("t_idx", "t")).select(
        "model_id", "t_idx", F.col("t.src").alias("src"), F.col("t.tgt").alias("tgt"),
        F.coalesce(F.col("t.guard"), F.lit("")).alias("guard"),
    )
    meta = charts.select("model_id", "variables", "initial_step")
    return Charts(steps, trans, meta)
