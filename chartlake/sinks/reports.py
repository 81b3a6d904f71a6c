"""Containment report documents (W2): one nested JSON document per pair with cut points,
paths, matched / unmatched lists and counts. Lists are per pair, bounded by the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.charts import Charts
from chartlake.operators import containment as ct
from chartlake.operators import graph
from chartlake.session import stored


def containment_report(c: Charts, pairs: DataFrame) -> DataFrame:
    c = ct.paired_charts(c, pairs)
    points = stored(graph.cut_points(c))
    cuts = stored(graph.cut_point_lists(points))  # read for both sides
    p1, p2 = ct.pair_paths(c, pairs, cuts=points, expand=False)
    m = ct.path_match(p1, p2)
    rows = p1.join(m, ["pair_id", "path_key"], "left")
    per = rows.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.struct("path_key", "from_place", "to_place", "cond_key", "xform_key", "match_key"))).alias("paths1"),
        F.count("match_key").alias("matched"), F.count(F.lit(1)).alias("n_paths1"))
    doc = (pairs.join(per, "pair_id", "left")
           .join(cuts.withColumnRenamed("model_id", "model1").withColumnRenamed("cut_points", "cutpoints1"), "model1", "left")
           .join(cuts.withColumnRenamed("model_id", "model2").withColumnRenamed("cut_points", "cutpoints2"), "model2", "left"))
    n = F.coalesce("n_paths1", F.lit(0))
    k = F.coalesce("matched", F.lit(0))
    contained = n == k
    desc = F.when(contained, F.lit("Model 1 is contained in Model 2")).otherwise(
        F.concat(F.lit("Model 1 is NOT contained in Model 2 ("), (n - k).cast("string"), F.lit(" unmatched paths)")))
    report = F.to_json(F.struct(
        "model1", "model2", "cutpoints1", "cutpoints2",
        F.filter(F.coalesce("paths1", F.array()), lambda p: p["match_key"].isNotNull()).alias("matched_paths"),
        F.filter(F.coalesce("paths1", F.array()), lambda p: p["match_key"].isNull()).alias("unmatched_paths"),
        F.struct(n.alias("paths1"), k.alias("matched"), (n - k).alias("unmatched"), contained.alias("contained")).alias("summary"),
        desc.alias("description")))
    return doc.select("pair_id", report.alias("report"))
