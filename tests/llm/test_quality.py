import zlib

import numpy as np
from llm_cases import DOCS, documents, frame
from pyspark.sql import functions as F

from chartlake.llm import quality as m

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = m.score_quality(docs, labels).join(labels, "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    out = [r for r in got if r.held_out]
    good, bad = [r.score for r in out if r.quality == 1], [r.score for r in out if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(m.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in m.score_quality(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in m.score_quality(docs.drop("lang", "source"), turned).collect()}


def test_compiled_rules_equal_the_rules():
    rng = np.random.RandomState(0)
    x = rng.rand(2000, len(m.FEATURES))
    y = ((x[:, 0] > 0.4) & (x[:, 3] <= 0.7)).astype(float)
    b, rules = m.fit_rules(x, y)
    z = b + sum(w * np.logical_and.reduce([(x[:, f] > cut) == side for f, side, cut in r]) for r, w in rules)
    assert (((1 / (1 + np.exp(-z))) >= 0.5) == y).mean() > 0.97 and len(rules) < 60


def test_awkward_rows_and_filter(spark):
    rows = documents(spark, 60)
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2 if i < 55 else None) for i in range(60)] + [(None, 1), (3, 1)], "doc_id long, quality int")
    got = m.score_quality(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = m.keep_good(df, labels)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted == 1)
    none = spark.createDataFrame([], DOCS)
    assert m.score_quality(none, labels).collect() == []
    alike = m.score_quality(df, labels.filter("false")).select("score").distinct().collect()
    assert [r.score for r in alike] == [0.5]
    assert {round(r.score, 9) for r in m.score_quality(df, labels.filter("quality = 1")).collect()} == {0.999}
