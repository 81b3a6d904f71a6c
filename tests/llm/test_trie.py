"""The conversation trie against a dictionary of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from chartlake.llm import queries
from chartlake.llm.conversation_trie import DoubleArray, conversation_trie, dense_ids, prefix_trie, turn_lists, with_shared_heads

SCHEMA = "conv_id long, turn int, role string, text string, p long, cut int, t string, depth long"
SF = "/root/testdata/sf0.001"


def _rows(spark):
    got = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    same = [(0, "user", "hello"), (1, "assistant", "hi"), (2, "user", None), (3, None, "x"), (4, "user", "")]
    got += [(1000 + i, *s) for i in range(120) for s in same]  # one conversation many times
    got += [(2000 + i, *s) for i in range(60) for s in [*same[:2 + i % 3], (9, "user", f"end {i % 7}")]]
    got += [(3000, None, "user", "before all"), (3000, 0, "user", "then"), (3001, 5, "user", "only own turn"), (3007, 0, "a", "b"), (3011, 1, "user", "y" * 9000)]
    got += [(3020, k, "user", f"turn {k}") for k in range(40)] + [(3021, k, "user", "again") for k in range(300)]
    got += [(None, 0, "user", "no id"), (3030, 0, None, None), (3031, 0, "", ""), (-7, 0, "user", "negative")]
    return [(*g, 1, 2, "t", 3) for g in got]


def _brute(rows, shared):
    own = defaultdict(list)
    for c, k, r, x, *_ in rows:
        if c is not None:
            own[c].append((k is not None, k or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if shared else 0
        paths[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + t[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
        ends[p].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def _got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("shard_turns", [200_000, 60, 1])
def test_trie_equals_brute_force(spark, shard_turns):
    rows = _rows(spark)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert _got(prefix_trie(with_shared_heads(turn_lists(df)), shard_turns)) == _brute(rows, True)
    if shard_turns == 60:
        assert _got(conversation_trie(df, shard_turns)) == _brute(rows, False)


def test_odd_tables(spark):
    df = spark.createDataFrame(_rows(spark), SCHEMA)
    assert conversation_trie(df.limit(0)).collect() == []
    assert conversation_trie(df.filter("conv_id is null")).collect() == []
    # a turnless conversation is a member of the root: 1008 has fewer own turns than it takes from its absent group head
    lone = spark.createDataFrame([(c, 0, "user", "x", 1, 2, "t", 3) for c in (1008, 1009)], SCHEMA)
    rows = [tuple(r) for r in lone.collect()]
    assert _got(prefix_trie(with_shared_heads(turn_lists(lone)))) == _brute(rows, True)
    # ties of a turn number: an order that does not depend on the order of rows
    tie = [(1, 0, "user", x, 1, 2, "t", 3) for x in "abc"]
    assert _got(conversation_trie(spark.createDataFrame(tie, SCHEMA))) == _got(conversation_trie(spark.createDataFrame(tie[::-1], SCHEMA)))


def test_double_array_knows_its_paths_and_no_others():
    rng = np.random.RandomState(3)
    paths = list({tuple(rng.randint(1, 6 if i % 2 else 400, rng.randint(0, 12))) for i in range(3000)})
    off = np.cumsum([0] + [len(p) for p in paths])
    codes = np.array([c for p in paths for c in p], np.int64)
    trie = DoubleArray(codes, off)
    at = trie.walk(codes, off)
    prefix = {}
    for i, p in enumerate(paths):
        for d in range(len(p)):
            assert prefix.setdefault(p[:d + 1], at[off[i] + d]) == at[off[i] + d] > 0
    assert len(set(prefix.values())) == len(prefix) == (trie.check >= 0).sum() - 1
    other = rng.randint(1, 400, (500, 6))
    seen = trie.walk(other.reshape(-1), np.arange(0, 3001, 6)).reshape(500, 6)
    for p, s in zip(other, seen):
        for d in range(6):
            assert (s[d] >= 0) == (tuple(p[:d + 1]) in prefix)


def test_dense_ids_follow_the_levels():
    a, b, depth = np.array([5, 7, 5, 9]), np.array([0, 0, 0, 1]), np.array([1, 2, 1, 1])
    assert dense_ids(a, b, depth).tolist() == [1, 3, 1, 2]


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = [tuple(-1 if x is None else x for x in r) for r in con.execute(queries.ORACLE["op13_conversation_trie"]).fetchall()]
    assert _got(queries.op13_conversation_trie(spark, SF)) == sorted(want)
