"""Registered file-list queries over D-FILES."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartlake.operators import files as FL
from chartlake.plans.registry import query
from chartlake.plans.sql import compose, cte
from chartlake.session import table
from chartlake.sources.derived import file_lists

cte("dfiles", [], """
SELECT p_brand AS folder, 'src' AS side,
       '/data/new_benchmarks/' || lower(split_part(p_type, ' ', 1)) || '/orig/' || replace(p_name, ' ', '_') || '.txt' AS path
FROM part
UNION ALL
SELECT p_brand, 'mod', '/data/new_benchmarks/' || lower(split_part(p_type, ' ', 1)) || '/mod/' || replace(p_name, ' ', '_') || '_SFC2.txt'
FROM part WHERE p_size > 5""")
cte("franked", ["dfiles"], """
SELECT folder, side, path, row_number() OVER (PARTITION BY folder, side ORDER BY path) AS rank FROM dfiles""")


def _files(spark, sf):
    return file_lists(table(spark, sf, "part"))


@query("pair_by_position", compose("""
SELECT s.folder, CAST(s.rank AS INTEGER) AS rank, s.path AS src_path, m.path AS mod_path
FROM franked s JOIN franked m ON m.folder = s.folder AND m.rank = s.rank AND s.side = 'src' AND m.side = 'mod'""", "franked"))
def q_pair_by_position(spark, sf):
    return FL.pair_by_position(_files(spark, sf)).select("folder", F.col("rank").cast("int"), "src_path", "mod_path")


@query("unpaired", compose("""
SELECT coalesce(s.folder, m.folder) AS folder, CAST(coalesce(s.rank, m.rank) AS INTEGER) AS rank,
       CASE WHEN s.path IS NULL THEN 'mod' ELSE 'src' END AS side, coalesce(s.path, m.path) AS path
FROM (SELECT * FROM franked WHERE side = 'src') s FULL OUTER JOIN (SELECT * FROM franked WHERE side = 'mod') m
  ON m.folder = s.folder AND m.rank = s.rank
WHERE s.path IS NULL OR m.path IS NULL""", "franked"))
def q_unpaired(spark, sf):
    return FL.unpaired(_files(spark, sf)).select("folder", F.col("rank").cast("int"), "side", "path")


@query("test_type_from_path", compose("""
SELECT path, coalesce(CASE WHEN list_position(string_split(path, '/'), 'new_benchmarks') > 0
  THEN string_split(path, '/')[list_position(string_split(path, '/'), 'new_benchmarks') + 1] END, 'unknown') AS test_type
FROM dfiles""", "dfiles"))
def q_test_type_from_path(spark, sf):
    f = _files(spark, sf)
    return f.select("path", FL.test_type_from_path(F.col("path")).alias("test_type"))


@query("sorted_listing", compose("SELECT folder, side, path, CAST(rank AS INTEGER) AS rank FROM franked", "franked"))
def q_sorted_listing(spark, sf):
    f = _files(spark, sf)
    return FL.ranked(f, "src").withColumn("side", F.lit("src")).unionByName(
        FL.ranked(f, "mod").withColumn("side", F.lit("mod"))).select("folder", "side", "path", F.col("rank").cast("int"))
