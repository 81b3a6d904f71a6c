"""Sharding against a brute-force search over the same order of groups."""

import tempfile
import zlib
from collections import defaultdict

import pytest
from llm_cases import documents, frame
from pyspark.sql import functions as F

from chartlake.llm.sharding import KEY_BITS, assign_shards, write_shards


def _sharded(spark, rows, shards, bits, step=5):
    got = assign_shards(frame(spark, rows), shards, block_bits=bits, step_bits=step, keep=("text",)).collect()
    assert len(got) == len(rows)
    return got


def _brute(sizes, k):
    """Least capacity for contiguous shards of the ordered sizes."""
    lo, hi = max(max(sizes), -(-sum(sizes) // k)), sum(sizes)
    while lo < hi:
        mid, shards, load = (lo + hi) // 2, 1, 0
        for s in sizes:
            if load + s > mid:
                shards, load = shards + 1, 0
            load += s
        lo, hi = (lo, mid) if shards <= k else (mid + 1, hi)
    return lo


def _check(spark, rows, shards, bits, step=5):
    got = _sharded(spark, rows, shards, bits, step)
    by_text, per, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for r in got:
        raw = (r.kept.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by_text[raw].add(r.shard)
        per[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values()) and set(per) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the same order of groups, searched whole
    keys = {r.text: r.o for r in frame(spark, rows).select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn(
        "o", F.shiftrightunsigned(F.xxhash64("text"), 64 - KEY_BITS)).collect()}
    size = defaultdict(int)
    for r in got:
        size[keys[r.kept.text or ""]] += r.size
    total, k, rest = sum(size.values()), shards, sum(size.values())
    for o, s in sorted(size.items(), key=lambda x: (-x[1], x[0])):
        if k > 1 and s * (1 << bits) >= total and s * k >= rest:
            rest, k = rest - s, k - 1
            del size[o]
        else:
            break
    order = sorted(size, key=lambda o: (o >> (KEY_BITS - bits), size[o] * (1 << bits) >= total, o))
    if order:
        assert max(s for i, s in per.items() if i >= shards - k) == _brute([size[o] for o in order], k)
    return per


@pytest.mark.parametrize("shards,bits,step", [(16, 12, 5), (4, 2, 1), (3, 1, 2), (1, 12, 5), (100, 12, 5)])
def test_least_capacity(spark, shards, bits, step):
    _check(spark, documents(spark), shards, bits, step)


def test_hot_group_takes_one_shard_and_leaves_the_others_even(spark):
    rows = documents(spark, 200)
    hot = [(5000 + i, "the very same text over and over " * 30, "en", "s0", 1, 1, "n", "s", 1) for i in range(400)]
    per = _check(spark, rows + hot, 8, 12)
    others = sorted(per.values())[:-1]
    assert max(others) < 2 * min(others)


def test_equal_rows_empty_table_and_null_texts(spark):
    one = (7, "same", "en", "s", 4, 1, "n", "s", 1)
    assert {r.shard for r in _sharded(spark, [one] * 50, 16, 12)} == {0}
    assert assign_shards(frame(spark, [])).collect() == []
    got = _sharded(spark, [(None, None, None, None, None, None, None, None, None)] * 3 + [(1, "", "", "", 0, 0, "", "", 0)], 4, 12)
    assert {(r.size, r.text_crc32, r.shard) for r in got} == {(1, 0, 0)}
    with pytest.raises(ValueError):
        assign_shards(frame(spark, []), 0)


def test_shards_do_not_depend_on_partitions(spark):
    rows = documents(spark)
    a = sorted((str(r.doc_id), r.text_crc32, r.shard) for r in assign_shards(frame(spark, rows)).collect())
    b = sorted((str(r.doc_id), r.text_crc32, r.shard) for r in assign_shards(frame(spark, rows[::-1]).repartition(7)).collect())
    assert a == b


def test_written_shards_hold_all_rows(spark):
    rows = documents(spark)
    back = write_shards(frame(spark, rows), tempfile.mkdtemp() + "/shards", 4)
    assert back.count() == len(rows) and back.select("shard").distinct().count() == 4
    assert sorted(str(r.text) for r in back.collect()) == sorted(str(r[1]) for r in rows)
