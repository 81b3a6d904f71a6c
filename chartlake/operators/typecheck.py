"""Type check of parsed charts (P2): every list present and every entry made of strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def type_check(charts: DataFrame) -> DataFrame:
    """``(model_id, steps_ok, transitions_ok, variables_ok, initial_ok, ok)``; rows that fail
    are what a caller routes to a quarantine table."""
    steps_ok = F.col("steps").isNotNull() & F.forall("steps", lambda s: s["name"].isNotNull() & s["function"].isNotNull())
    trans_ok = F.col("transitions").isNotNull() & F.forall("transitions", lambda t: (
        (F.size(t["src"]) > 0) & (F.size(t["tgt"]) > 0) & t["guard"].isNotNull()
        & F.forall(t["src"], lambda x: x.isNotNull()) & F.forall(t["tgt"], lambda x: x.isNotNull())))
    vars_ok = F.col("variables").isNotNull() & F.forall("variables", lambda v: v.isNotNull())
    init_ok = F.col("initial_step").isNotNull()
    return charts.select("model_id", steps_ok.alias("steps_ok"), trans_ok.alias("transitions_ok"),
                         vars_ok.alias("variables_ok"), init_ok.alias("initial_ok"),
                         (steps_ok & trans_ok & vars_ok & init_ok).alias("ok"))
