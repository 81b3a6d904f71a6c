"""The pipeline against its stages, and each stage's decisions against the operators."""

import os
import shutil
import tempfile

import corpus_pipeline
from llm_cases import DOCS, documents, words

import __spark_entry__ as entry
from chartlake.llm.pii import BASE, find_pii
from chartlake.llm.quality import score_quality

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["quality", "near_dedup", "pii", "mixing", "bpe"]
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        at[name] = docs = corpus_pipeline.stored(docs)
        assert name == "bpe" or docs.columns == columns
    good = {r.doc_id for r in score_quality(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect() if r.predicted}
    assert {r.doc_id for r in at["quality"].collect()} == good
    seen = [tuple(words(r.text)) for r in at["near_dedup"].collect()]
    assert len(seen) == len(set(seen)) and at["pii"].count() == len(seen)
    assert all(s.kind not in BASE for r in find_pii(at["pii"]).collect() for s in r.spans)
    copies = {}
    for r in at["mixing"].collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in at["pii"].collect()}
    assert at["bpe"].count() == sum(copies.values())
    whole = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert whole == sorted((r.doc_id, r.ids_sha256) for r in at["bpe"].collect())


def _folder(spark, docs):
    folder = tempfile.mkdtemp(prefix="pipeline-")
    docs.write.parquet(f"{folder}/documents.parquet")
    shutil.copy(f"{SF}/labels.parquet", f"{folder}/labels.parquet")
    return folder


def test_odd_rows_and_clashing_names(spark):
    # nulls in every column, empty, white space, very long, repeated rows, names that stages use inside
    rows = documents(spark, 80)
    fold = spark.createDataFrame([(*r, "a", "b", True, 1) for r in rows + rows[-6:]], DOCS + ", _node string, _id string, _first boolean, _copy int").repartition(3)
    folder = _folder(spark, fold)
    docs, counts = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.stored(stage(spark, docs, folder))
        counts[name] = (before, docs.count())
        assert docs.columns == fold.columns, name
    assert counts["quality"][1] > 0 and counts["pii"][0] == counts["pii"][1] and counts["near_dedup"][1] < counts["near_dedup"][0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(last) == counts["mixing"][1]
    assert all(r.n_tokens > 0 or r.ids_sha256 == r.decoded_sha256 for r in last)


def test_empty_table(spark):
    folder = _folder(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0))
    assert os.path.isdir(f"{folder}/documents.parquet") and corpus_pipeline.run(spark, folder).collect() == []


def test_registered():
    q = entry.queries()
    assert "pipeline" in q and {n.split("_")[0] for n in q if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)}
