"""Positions in ordered groups without one task a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlake.session import cut_lineage, stored


def positions(df: DataFrame, keys: list[str], order: list[Column | str], out: str = "rank") -> DataFrame:
    """1-based position of each row in its ``keys`` group by ``order``.

    Rows are dealt by range of (keys, order), so a group with most of the rows is spread over many tasks, and sorted and
    numbered there; the row counts of the group's earlier ranges are added. The rows are written first, as dealing by range
    reads them twice."""
    spark, df = df.sparkSession, stored(df)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ids follow each other within a range
    dealt = cut_lineage(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumns(
        {"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    counts = dealt.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys],
                         (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_off"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return dealt.join(offs, same).withColumn(out, (F.col("_id") + F.col("_off")).cast("int")).drop(
        "_part", "_id", "_p", "_off", *[f"_k_{k}" for k in keys])
