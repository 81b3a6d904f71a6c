from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from llm_cases import DOCS, documents, frame, words

from chartlake.llm.components import connected_components
from chartlake.llm.near_dedup import Idf, _enough, _Race, _similar, _tile_links, keep_one_of_each, near_duplicates


def _classes(rows):
    """Brute force: rows (by position) joined by equal words or plain Jaccard >= 0.8 of five-word runs."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                parent[find(a)] = find(b)
    out = defaultdict(set)
    for k in range(len(rows)):
        out[find(k)].add(k)
    return list(out.values())


def _edited(rows):
    """Near copies of long texts: chains of edits and a crowd around one text."""
    base = [r for r in rows if len(words(r[1])) > 120][:6]
    new, at = [], 5000
    for r in base:
        w = words(r[1])
        for k in range(4):
            x = list(w)
            x[7 + 11 * k] = f"edit{k}"
            new.append((at, " ".join(x), *r[2:]))
            at += 1
    w = words(base[0][1])
    for k in range(40):
        x = list(w)
        x[3 + k] = f"crowd{k}"
        new.append((at, " ".join(x), *base[0][2:]))
        at += 1
    return rows + new


def test_near_duplicates_equal_brute_force(spark):
    rows = _edited(documents(spark, 150))
    got = near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for c in _classes(rows):
        ids = [rows[k][0] for k in c]
        least = min((i for i in ids if i is not None), default=None)
        for k in c:
            want.setdefault(rows[k][0], set()).add((least, len(c)))
    for r in got:
        assert (r.class_id, r.class_size) in want[r.doc_id], r
    assert any(r.n_links > 0 for r in got)


def test_one_of_each_class_stays(spark):
    rows = _edited(documents(spark, 80))
    df = frame(spark, rows)
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    got = kept.collect()
    classes = _classes(rows)
    with_words = [c for c in classes if any(words(rows[k][1]) for k in c)]
    assert sum(bool(words(r.text)) for r in got) == len(with_words)
    assert sum(not words(r.text) for r in got) == sum(not words(r[1]) for r in rows)
    ids = {r.doc_id for r in got if words(r.text)}
    for c in with_words:
        assert min((rows[k][0] for k in c if rows[k][0] is not None), default=None) in ids


def _same_as_brute_force(spark, texts):
    rows = [(k, t, "en", "s0", len(t), 7, "n", "s", 1) for k, t in enumerate(texts)]
    want = {k: (min(c), len(c)) for c in _classes(rows) for k in c}
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_duplicates(frame(spark, rows)).collect()}
    assert [(k, want[k], got[k]) for k in want if got[k] != want[k]] == []


def test_pairs_in_buckets_of_several_hundred_classes(spark):
    # all texts share a passage (0.787), two and two a little more (0.832); they meet in crowded buckets
    passage = " ".join(f"p{k}" for k in range(100))
    _same_as_brute_force(spark, [" ".join([passage, *(f"own{k // 2}x{j}" for j in range(3)), *(f"own{k}y{j}" for j in range(10))]) for k in range(300)])


def test_links_by_any_node_of_a_class(spark):
    # chains of texts, each similar to the next only, and a branch that is similar to one text of its chain only
    texts = []
    for c in range(60):
        w = [f"c{c}w{k}" for k in range(120)]
        for step in range(7):
            for k in (step * 16 + 3, step * 16 + 10):
                w[k] = f"c{c}edit{k}"
            texts.append(" ".join(w))
            if step in (1, 2, 4):
                texts.append(" ".join(x if k not in (step * 16 + 22, step * 16 + 30) else f"c{c}branch{step}" for k, x in enumerate(w)))
    _same_as_brute_force(spark, texts)


def test_plain_pairs_are_candidates_whatever_their_weights():
    # pairs at a plain similarity of 0.8, the shared shingles of the least weight, the others of the highest
    rng, s, shared, own, n = np.random.RandomState(1), SimpleNamespace(), 96, 12, 2000
    sets = [rng.randint(0, 1 << 48, shared + 2 * own).astype(np.uint64) for _ in range(n)]
    s.shingle = np.concatenate([x for a in sets for x in (a[:shared + own], np.r_[a[:shared], a[shared + own:]])])
    s.first = np.arange(0, len(s.shingle) + 1, shared + own)
    keys, each = _Race().samples(s, np.tile(np.r_[np.ones(shared), np.full(own, 2.0)], 2 * n))
    lost = ~((keys[::2] == keys[1::2]).any(1) & _enough(each[::2], each[1::2]))
    assert lost.mean() < 0.002


def test_tile_of_many_candidates_equals_all_pairs(spark):
    # a crowd whose texts are 0.7 to 0.9 alike, with repeated words (term frequencies) and two sides
    rng = np.random.RandomState(5)
    base = [f"b{k}" for k in range(80)] + ["again and again and again and again"] * 4
    texts = []
    for k in range(90):
        w = list(base)
        for j in rng.choice(80, rng.randint(0, 5), replace=False):
            w[j] = f"e{k}x{j}"
        texts.append(" ".join(w))
    idf = Idf(1000, 5, np.zeros(0, np.uint64), np.zeros(0), np.zeros(1 << 20, bool))
    col, n = pa.array(texts), len(texts)
    root, side = np.arange(n) // 2, np.where(np.arange(n) < 40, 1, 2).astype(np.int32)
    for sides in (np.zeros(n, np.int32), side):
        want = [(i, j) for i in range(n) for j in range(i) if root[i] != root[j] and (sides[i] == 0 or sides[i] != sides[j])]
        i, j = np.array(want).T
        same = _similar(col.take(pa.array(i)), col.take(pa.array(j)), idf, 0.8)
        assert 0 < same.sum() < len(same)
        got = _tile_links(col, sides, root, idf, 0.8)
        linked = {frozenset(p) for p, s in zip(want, same) if s}
        assert {frozenset(p) for p in got} <= linked
        assert _groups(n, got) == _groups(n, [tuple(p) for p in linked]) and len(got) < n


def _groups(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return {frozenset(k for k in range(n) if find(k) == r) for r in {find(k) for k in range(n)}}


def test_column_names_that_clash_pass_through(spark):
    names = ["_id", "_first", "_node", "_words", "_again", "key", "root"]
    rows = [(k, "one and the same text of some words", *[f"{n}{k}" for n in names]) for k in (77, 88)] + [(None, None, *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = keep_one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2]], key=str)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7), (102, 101), (200, 200)], "a int, b int")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert near_duplicates(none).collect() == [] and keep_one_of_each(none).collect() == []
