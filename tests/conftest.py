import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from chartlake.charts import Charts, unnest  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("chartlake-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "6g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="chartlake-test-ckpt-"))
    yield s


@pytest.fixture(autouse=True)
def _clear_cache(spark):
    yield
    spark.catalog.clearCache()


def chart_df(spark, charts: dict) -> Charts:
    """Literal charts ``{model_id: dict(steps=[(name, fn)], transitions=[(src, tgt, guard)], variables, initial)}``."""
    rows = []
    for mid, c in charts.items():
        rows.append((
            mid,
            [{"name": n, "function": f} for n, f in c["steps"]],
            [{"src": s if isinstance(s, list) else [s], "tgt": t if isinstance(t, list) else [t], "guard": g}
             for s, t, g in c["transitions"]],
            c["variables"], c["initial"],
        ))
    from chartlake.charts import CHART_SCHEMA
    return unnest(spark.createDataFrame(rows, CHART_SCHEMA))


# Literal charts written anew after the shapes of the reference's sample files.
SIMPLE = dict(
    steps=[("Start", "counter := 0"), ("Process", "counter := counter + 1"), ("End", "done := True")],
    transitions=[("Start", "Process", "init"), ("Process", "End", "counter >= 3")],
    variables=["counter", "done", "init"], initial="Start",
)
MODIFIED = dict(
    steps=[("Start", "counter := 0"), ("Process", "counter := counter + 1"), ("Check", ""), ("End", "done := True")],
    transitions=[("Start", "Process", "init"), ("Process", "Check", "true"), ("Check", "End", "counter >= 3")],
    variables=["counter", "done", "init", "flag"], initial="Start",
)
FACTORIAL = dict(
    steps=[("Start", "n := 5; fact := 1; i := 1"), ("Check", ""), ("Multiply", "fact := fact * i"),
           ("Increment", "i := i + 1"), ("End", "")],
    transitions=[("Start", "Check", "true"), ("Check", "Multiply", "i <= n"), ("Multiply", "Increment", "true"),
                 ("Increment", "Check", "true"), ("Check", "End", "i > n")],
    variables=["n", "fact", "i", "done"], initial="Start",
)
INVALID = dict(
    steps=[("Start", "x := 1"), ("Stop", "")],
    transitions=[("Start", "Stop", "x > 0"), ("Stop", "NonExistentStep", "x == 0")],
    variables=["x", "y"], initial="Start",
)
TRAFFIC = dict(
    steps=[("Red", "t := 0"), ("Green", "t := 0"), ("Yellow", "t := 0"), ("Cleanup", "t := 0")],
    transitions=[("Red", "Green", "t >= 30"), ("Green", "Yellow", "t >= 25"), ("Yellow", "Red", "t >= 5"),
                 ("Cleanup", "Red", "true")],
    variables=["t"], initial="Red",
)
