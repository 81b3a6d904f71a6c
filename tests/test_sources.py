from pyspark.sql import functions as F

from chartlake.charts import CHART_SCHEMA, nest
from chartlake.sinks import text as W
from chartlake.sources import text as S
from conftest import FACTORIAL, SIMPLE, chart_df


def _norm(df):
    return sorted((r["model_id"], [tuple(s) for s in r["steps"]], [(tuple(t["src"]), tuple(t["tgt"]), t["guard"]) for t in r["transitions"]],
                   list(r["variables"]), r["initial_step"]) for r in df.collect())


def test_chart_text_round_trip(spark):
    charts = nest(chart_df(spark, {"simple": SIMPLE, "fact/1": FACTORIAL}))
    root = W.io_root(spark, "test-chart-text")
    W.write_per_model(W.render_chart_text(charts), root)
    files = S.scan_text_corpus(spark, root)
    back = S.parse_chart_text(files.select(S.model_from_path(F.col("path")).alias("model_id"), "content"))
    assert _norm(back) == _norm(charts)


def test_chart_text_with_comments_and_numbered_lists(spark):
    text = ("steps1 = [\n  {'name': 'A', 'function': 'x := 1'},  # first\n  # a comment line\n  {'name': 'B', 'function': ''},\n]\n"
            "transitions1 = [\n  {'src': 'A', 'tgt': ['B', 'A'], 'guard': 'x > 0'},\n]\nvariables = ['x']\ninitial_step = 'A'\n")
    df = spark.createDataFrame([("m", text)], "model_id string, content string")
    r = S.parse_chart_text(df).collect()[0]
    assert [s["name"] for s in r["steps"]] == ["A", "B"]
    assert r["transitions"][0]["tgt"] == ["B", "A"] and r["initial_step"] == "A" and r["variables"] == ["x"]


def test_missing_sections(spark):
    df = spark.createDataFrame([("m", "steps = [{'name': 'A', 'function': ''}]\n"), ("e", "")], "model_id string, content string")
    r = {x["model_id"]: x for x in S.parse_chart_text(df).collect()}
    assert len(r["m"]["steps"]) == 1 and r["m"]["transitions"] == [] and r["m"]["initial_step"] is None
    assert r["e"]["steps"] == [] and r["e"]["variables"] == []


def test_structured_text_dialects(spark):
    charts = nest(chart_df(spark, {"fact": FACTORIAL}))
    a = S.parse_st_dialect_a(W.render_st_a(charts)).collect()[0]
    assert [s["name"] for s in a["steps"]] == ["Start", "Check", "Multiply", "Increment", "End"]
    assert a["initial_step"] == "Start" and a["variables"] == ["n", "fact", "i", "done"]
    assert [t["guard"] for t in a["transitions"]][1] == "i <= n"
    b = S.parse_st_dialect_b(W.render_st_b(charts)).collect()[0]
    assert b["initial_step"] == "Start" and b["steps"][2]["function"] == "Act_Multiply"
    x = S.parse_st_dialect_a(S.extract_plcopen_st(W.wrap_plcopen(W.render_st_a(charts)))).collect()[0]
    assert [t["guard"] for t in x["transitions"]] == [t["guard"] for t in a["transitions"]]
    assert S.parse_st_dialect_a(W.render_st_a(charts)).select(S.detect_dialect(F.lit("PROGRAM x END_PROGRAM"))).first()[0] == "st"


def test_chart_text_layouts_and_faults(spark):
    from chartlake.sources.text import parse_chart_text, split_parsed
    lists = '[\n {"name": "A", "function": "x := 1"},\n {"name": "B", "function": ""}\n]', '[{"src": "A", "tgt": ["B", "C"], "guard": "x[1] == 2"}]'
    docs = spark.createDataFrame([
        ("comma", f" steps={lists[0]},\n # c\n transitions={lists[1]},\n variables=['x', 'y'],\n initial_step='A'\n"),
        ("call", f"steps1 = {lists[0]}\n transitions1 = {lists[1]}\n sfc1 = SFC(\n steps=steps1,\n variables=[\"x\"],\n transitions=transitions1,\n initial_step=\"A\"\n)\n"),
        ("broken", f"steps = [{{'name: 'A'}}]\ntransitions = {lists[1]}\nvariables = ['x']\n"),
        ("open", f"steps = {lists[0]}\ntransitions = [ {{'src'\n"), ("none", "nothing here"),
    ], "model_id string, content string")
    parsed = parse_chart_text(docs)
    good, bad = split_parsed(parsed)
    got = {r["model_id"]: (len(r["steps"]), len(r["transitions"]), r["variables"], r["initial_step"]) for r in good.collect()}
    assert got == {"comma": (2, 1, ["x", "y"], "A"), "call": (2, 1, ["x"], "A"), "none": (0, 0, [], None)}
    assert {r["model_id"]: r["issues"] for r in bad.collect()} == {"broken": ["steps malformed"], "open": ["transitions malformed"]}


def test_config_array_sheets_and_upsert_columns(spark, tmp_path):
    from chartlake.operators.runs import sheet_upsert
    from chartlake.sources.config import read_model_config, read_result_sheets
    (tmp_path / "c.json").write_text('[\n  {"llm_name": "GPT4o", "model_name": "m",\n   "api_key": "k", "n": 2},\n  {"llm_name": "x"}\n]\n')
    (tmp_path / "l.json").write_text('{"llm_name": "GPT4o", "model_name": "m", "api_key": "k"}\n{"llm_name": "B", "model_name": "m", "api_key": "k"}\n')
    assert [(r["llm_name"], r["n"]) for r in read_model_config(spark, str(tmp_path / "c.json")).collect()] == [("GPT4o", 2)]
    assert read_model_config(spark, str(tmp_path / "l.json")).count() == 2
    (tmp_path / "batch_report_1.csv").write_text("Benchmark Name,Type,GPT4o_iter\na,t,2\nb,t,3,9\n")
    (tmp_path / "batch_report_2.csv").write_text("Benchmark Name,Claude_iter,Type\nc,5,t\n")
    rows = {r["Benchmark Name"]: (r["GPT4o_iter"], r["Claude_iter"], r["source"]) for r in read_result_sheets(spark, str(tmp_path)).collect()}
    assert rows == {"a": ("2", None, "batch_report_1.csv"), "c": (None, "5", "batch_report_2.csv")}
    assert [(r["source"], r["line"]) for r in read_result_sheets(spark, str(tmp_path), faults=True).collect()] == [("batch_report_1.csv", "b,t,3,9")]
    old = spark.createDataFrame([("a", "t", 1, 5)], "`Benchmark Name` string, Type string, x int, y int")
    new = spark.createDataFrame([("a", "t", 2, 7)], "`Benchmark Name` string, Type string, x int, z int")
    r = sheet_upsert(old, new).collect()[0]
    assert (r["x"], r["y"], r["z"]) == (2, 5, 7)


def test_sheets_of_several_layouts_with_quotes(spark, tmp_path):
    from chartlake.sources.config import read_result_sheets
    (tmp_path / "batch_report_1.csv").write_text('name,note\r\na,"x, ""y"" z"\r\n\r\nb,\r\n"c","q\\"r"\r\n')
    (tmp_path / "batch_report_2.csv").write_text("note,name,more\nn,d,1\nshort,e\n")
    (tmp_path / "batch_report_3.csv").write_text("only\n")
    got = sorted((r["name"], r["note"], r["more"], r["source"]) for r in read_result_sheets(spark, str(tmp_path)).collect())
    assert got == [("a", 'x, "y" z', None, "batch_report_1.csv"), ("b", None, None, "batch_report_1.csv"), ("c", 'q"r', None, "batch_report_1.csv"),
                   ("d", "n", "1", "batch_report_2.csv")]
    assert [tuple(r) for r in read_result_sheets(spark, str(tmp_path), faults=True).collect()] == [("batch_report_2.csv", "short,e", "short")]
    assert read_result_sheets(spark, str(tmp_path / "none")).collect() == []


def test_listing_by_time_name_and_folder(spark, tmp_path):
    import os
    from datetime import datetime, timezone

    from chartlake.sources.text import list_output_files
    for model, status, name, at in [("a/b", "success", "x_1.txt", 1000), ("a/b", "failed", "x_2.TXT", 2000), ("c+d e", "success", "y_1.html", 3000),
                                    ("c+d e", "success", "y_2.txt", 4000)]:
        from urllib.parse import quote
        folder = tmp_path / f"model={quote(model, safe='+ ')}" / f"status={status}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("text")
        os.utime(folder / name, (at, at))
    names = lambda **k: sorted((r.model, r.status, r.file, r.ext, r.length) for r in list_output_files(spark, str(tmp_path), **k).collect())
    assert len(names()) == 4 and names()[0] == ("a/b", "failed", "x_2.TXT", "txt", 4)
    assert [x[2] for x in names(since=datetime.fromtimestamp(2000, timezone.utc))] == ["x_2.TXT", "y_1.html", "y_2.txt"]
    assert [x[2] for x in names(since=datetime.fromtimestamp(2001, timezone.utc), name="*.txt")] == ["y_2.txt"]
    assert [x[2] for x in names(status="success", model="c*")] == ["y_1.html", "y_2.txt"]
    assert names(status="nothing") == [] and list_output_files(spark, str(tmp_path / "none")).collect() == []


def test_events_are_linked_once_for_all_periods(spark):
    from chartlake.sources.derived import event_charts
    # Sunday, Monday of the next week, Tuesday; a user and a time that are not known
    rows = [(1, "2024-01-07 23:00:00", 5, "a"), (2, "2024-01-08 00:30:00", 5, "b"), (3, "2024-01-08 00:30:00", 5, "c"), (4, "2024-01-09 09:00:00", 5, "d"),
            (5, "2024-01-08 01:00:00", None, "e"), (6, "2024-01-08 02:00:00", None, "f"), (7, None, 5, "g"), (8, None, 5, "h")]
    ev = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string").selectExpr(
        "event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "1.0D value", "'{\"k\": 60}' props")
    tr = event_charts(ev)[0].transitions
    plan = tr._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("lead(")  # events are linked before they are dealt to day and week charts
    assert {(r["model_id"], r["src"][0], r["tgt"][0]) for r in tr.collect()} == {
        ("5/week/2024-01-08", "b", "c"), ("5/week/2024-01-08", "c", "d"), ("5/day/2024-01-08", "b", "c"),
        ("day/2024-01-08", "e", "f"), ("week/2024-01-08", "e", "f"), ("5/day", "g", "h"), ("5/week", "g", "h")}


def test_one_file_a_chart_in_the_folders_of_a_partitioned_writer(spark, tmp_path):
    import os
    rows = [("1/week/a", "x\ny"), ("2:b=%", "z"), ("tw__o", "p"), ("tw__o", "q"), (None, "n"), ("empty", None)]
    docs = spark.createDataFrame(rows, "model_id string, content string")
    ours, theirs = str(tmp_path / "ours"), str(tmp_path / "theirs")
    W.write_per_model(docs, ours)
    docs.select(W.safe_key(F.col("model_id")).alias("model"), "content").repartition("model").write.partitionBy("model").text(theirs)
    folders = lambda root: sorted(n for n in os.listdir(root) if not n.startswith(("_", ".")))
    assert folders(ours) == folders(theirs) and len(folders(ours)) == 5
    assert all(os.listdir(f"{ours}/{d}") == ["part-0.txt"] for d in folders(ours))  # nothing of the writer's commit is left
    read = lambda root: sorted((r["model_id"], tuple(sorted(r["content"].split("\n")))) for r in S.scan_text_corpus(spark, root).select(
        S.model_from_path(F.col("path")).alias("model_id"), "content").collect())
    assert read(ours) == read(theirs)
    W.write_per_model(docs.limit(0), str(tmp_path / "none"))
    assert S.scan_text_corpus(spark, str(tmp_path / "none")).count() == 0


def test_scan_of_a_mounted_folder_lists_in_tasks(spark, tmp_path):
    import os
    root = str(tmp_path / "tree x%é")
    for name, data in {"a b/x.TXT": b"\xef\xbb\xbfhi\r\n", "a b/c#d/y ü.md": b"\xff\x00x", "noext": b"e", "pic.png": b"p", "empty.txt": b"", "_hidden.txt": b"h",
                       "_k=1/z.txt": b"k", "_k=2.txt": b"k", "_temporary/z.txt": b"t", "_metadata": b"m", "_metadata.d/q.txt": b"m", ".h/z.txt": b"h", "t.txt._COPYING_": b"c",
                       "50%25[1]{2}^'~.txt": b"4", "sep\u2028\u00a0.txt": b"u"}.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    os.symlink(f"{root}/a b", f"{root}/link")
    os.symlink(f"{root}/nothing", f"{root}/broken.txt")
    got = S.scan_text_corpus(spark, root)
    assert got.inputFiles() == []  # the driver holds no file of the listing
    theirs = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).selectExpr("_metadata.file_path as path", "value as content")
    rows = lambda df: sorted((r[0], r[1]) for r in df.select("path", F.hex("content")).collect())
    assert rows(got) == rows(theirs.filter("path not like '%.png'")) and got.count() == 10
    assert rows(S.scan_text_corpus(spark, f"file://{root}")) == rows(got)
    assert {r["ext"] for r in got.collect()} == {"txt", "md", ""}
