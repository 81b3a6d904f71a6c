import numpy as np
import pytest
from pyspark.sql import functions as F

from chartlake.llm.multi_index_hashing import SubstringTables, nearest
from chartlake.llm.voronoi_knn import exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score double, cell int, v string"
def QUERY():
    return F.col("vec_id") % 20 == 0



def _rows(spark, n=400):
    got = [(r.vec_id, [float(x) for x in r.embedding]) for r in
           spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").limit(n).collect()]
    hot = got[3][1]
    got += [(10_000 + i, hot) for i in range(150)]  # one vector many times
    odd = [(20_000, None), (20_020, [None] + hot[1:]), (20_040, [float("nan")] + hot[1:]), (20_060, [float("inf")] + hot[1:]),
           (None, hot), (20_080, hot[:10]), (20_081, [3 * x for x in hot]), (20_100, []), (20_120, [0.0] * 64), (20_120, [0.0] * 64)]
    return got, [(i, v, 1, 2.0, 3, "x") for i, v in got + odd]


def _clean(rows, zero):
    out = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = np.zeros(64)
        x[:len(v)] = np.array(v, np.float32).astype(float)
        if zero or x.any():
            out[i] = x
    ids = np.array(sorted(out))
    return ids, np.stack([out[i] for i in ids])


def _by_query(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def test_exact_top_k_equals_brute_force(spark):
    _, rows = _rows(spark)
    got = _by_query(exact_top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), QUERY()))
    ids, x = _clean(rows, zero=True)
    x = np.floor(64 * x).astype(int)
    asked = [i for i in ids if i % 20 == 0]
    assert set(got) == set(asked)
    for k, i in enumerate(ids):
        if i % 20 == 0:
            s = x @ x[k]
            order = [j for j in np.lexsort((ids, -s)) if j != k][:20]
            assert got[i] == [(r + 1, ids[j], s[j]) for r, j in enumerate(order)]


def test_nearest_has_recall_and_exact_scores(spark):
    real, rows = _rows(spark)
    got = _by_query(nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), QUERY()))
    ids, x = _clean(rows, zero=False)
    hit = total = 0
    assert set(got) == {i for i in ids if i % 20 == 0}
    for k, i in enumerate(ids):
        if i % 20 == 0:
            s = x @ x[k]
            order = [j for j in np.lexsort((ids, -s)) if j != k][:20]
            found = got[i]
            assert [r for r, _, _ in found] == list(range(1, 21))
            assert [(-sc, v) for _, v, sc in found] == sorted((-sc, v) for _, v, sc in found)
            for _, v, sc in found:
                assert sc == pytest.approx(s[np.searchsorted(ids, v)], abs=1e-12) and v != i
            # a copy of equal nearness is as good
            hit += sum(sc >= s[order[-1]] - 1e-12 for _, _, sc in found)
            total += 20
    assert hit / total >= 0.9


def test_substring_tables_meet_every_code_within_the_radius():
    rng = np.random.RandomState(0)
    codes = rng.randint(0, 256, (500, 32)).astype(np.uint8)
    codes[:40] = codes[0] ^ np.packbits(rng.rand(40, 256) < 0.05, axis=1)
    t = SubstringTables(codes)
    apart = np.bitwise_count(codes ^ codes[0]).sum(1)
    for radius in (0, 5, 31, 32, 40, 63, 64, 110, 128, 200, 255, 256):
        assert list(t.within(codes[0], radius)) == list(np.flatnonzero(apart <= radius))


@pytest.mark.parametrize("operator", [exact_top_k, nearest])
def test_few_and_no_rows(spark, operator):
    none = spark.createDataFrame([], SCHEMA)
    assert operator(none, QUERY()).collect() == []
    few = spark.createDataFrame([(20, [1.0, 0.0], 1, 1.0, 1, ""), (1, [1.0, 1.0], 1, 1.0, 1, ""), (2, [1.0, 1.0], 1, 1.0, 1, "")], SCHEMA)
    assert [(r["rank"], r.vec_id) for r in operator(few, QUERY()).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    one = spark.createDataFrame([(20, [1.0, 0.0], 1, 1.0, 1, "")], SCHEMA)
    assert operator(one, QUERY()).collect() == []


def test_products_beyond_a_long_are_refused(spark):
    big = spark.createDataFrame([(20, [1e15], 1, 1.0, 1, "")], SCHEMA)
    with pytest.raises(ValueError):
        exact_top_k(big, QUERY())
