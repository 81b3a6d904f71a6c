import hashlib
import math
import zlib
from collections import Counter

import pytest
from llm_cases import DOCS, documents, frame, words

from chartlake.llm.bpe import WordBpe, decode, default_path, encode
from chartlake.llm.class_lm import score_texts
from chartlake.llm.mixing import mix_sources
from chartlake.llm.substring_dedup import substring_dedup


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    rows = documents(spark)
    out = encode(frame(spark, rows), keep=("doc_id", "text"))
    for r in decode(out).collect():
        e = t.encode(r.text or "", add_special_tokens=False)
        assert r.ids == e.ids and r.n_tokens == len(e.ids) and r.ids_sha256 == _sha(" ".join(map(str, e.ids)))
        assert r.decoded == t.decode(e.ids, skip_special_tokens=False) and r.decoded_sha256 == _sha(r.decoded)
    assert out.count() == len(rows)


def test_bpe_merges_ties_and_long_words():
    from tokenizers import Tokenizer

    t, b = Tokenizer.from_file(default_path()), WordBpe(default_path())
    texts = ["a" * 999, "aaaa aaa aa a", "abcab" * 200, "''s''re", "ﬁ İ ²³Ⅷ", "　x\x85y\x1cz", "<|endoftext|><|endoftext|>a", "<|x|>", ""]
    for x, got in zip(texts, b.encode_texts(texts), strict=True):
        e = t.encode(x, add_special_tokens=False)
        assert got[1] == " ".join(map(str, e.ids)), x


def test_bpe_tables_stay_bounded(monkeypatch):
    import chartlake.llm.bpe as m

    monkeypatch.setattr(m, "KEEP", 5)
    b = WordBpe(default_path())
    texts = [f"w{i} common x{i}" for i in range(40)]
    once = [b.encode_texts([x])[0] for x in texts]
    assert once == WordBpe(default_path()).encode_texts(texts)
    assert len(b.known) < 30


def _mix_targets(sizes):
    total = {}
    for s, n in sizes:
        total[s] = total.get(s, 0) + n
    order = sorted((s for s in total if s is not None)) + [s for s in total if s is None]
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    goal, free = 1.5 * sum(total.values()), set(order)
    while True:
        level = (goal - sum(2 * total[s] for s in order if s not in free)) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * level > 2 * total[s]]
        if not over:
            return total, {s: weight[s] * level if s in free else 2.0 * total[s] for s in order}
        free -= set(over)


def test_mixing_reaches_targets(spark):
    rows = documents(spark, 200)
    df = frame(spark, rows)
    out = mix_sources(df)
    assert out.columns == [*df.columns, "_mix"]
    got = out.collect()
    assert len(got) == len(rows)
    total, target = _mix_targets([(r[3], len(words(r[1]))) for r in rows])
    taken = Counter()
    for r in got:
        assert r._mix["size"] == len(words(r.text)) and r._mix.source_size == total[r.source]
        assert r._mix.target == pytest.approx(target[r.source])
        assert r._mix.taken == r._mix.copies * r._mix["size"] and 0 <= r._mix.copies <= 2
        taken[r.source] += r._mix.taken
    for s in target:
        biggest = max(len(words(r[1])) for r in rows if r[3] == s)
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 0.5 * biggest if len([1 for r in rows if r[3] == s]) < 5 else 60)
    again = {(r.doc_id, r.text): r._mix.copies for r in mix_sources(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.text): r._mix.copies for r in got}


def test_mixing_over_many_slots(spark, monkeypatch):
    import chartlake.llm.mixing as m

    monkeypatch.setattr(m, "SLOT_DOCS", 7)
    monkeypatch.setattr(m, "BROADCAST_SOURCES", 0)
    rows = [(i, "w " * (1 + i % 13), "en", "hot" if i % 3 else f"s{i % 6}", 1, 1, "", "", 1) for i in range(900)]
    got = mix_sources(frame(spark, rows)).collect()
    _, target = _mix_targets([(r[3], len(words(r[1]))) for r in rows])
    taken = Counter()
    for r in got:
        taken[r.source] += r._mix.taken
    assert len(got) == 900 and all(abs(taken[s] - target[s]) <= 30 for s in target)


def test_class_lm_base_and_gain(spark):
    rows = [r for r in documents(spark, 200)]
    got = score_texts(frame(spark, rows)).collect()
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter()
    for r in rows:
        if not held(r[0]):
            count.update([*words(low(r[1])), None])
    n, v = sum(count.values()), len(count)
    want = {}
    for r in rows:
        w = [*words(low(r[1])), None]
        want.setdefault((r[0], len(w)), []).append(
            (held(r[0]), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)))
    for r in got:
        assert any(h == r.held_out and k == r.n_known and b == pytest.approx(r.base_score, rel=1e-9)
                   for h, k, b in want[(r.doc_id, r.n_tokens)])
        assert r.train_tokens == n and r.score < 0
    out = [r for r in got if r.held_out]
    assert len(got) == len(rows) and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_class_lm_probabilities_sum_to_one(spark):
    """Steps, units and words of the fitted model are each a distribution."""
    import numpy as np

    from chartlake.llm import class_lm as m

    src = frame(spark, documents(spark, 40)).selectExpr("text", "false as held")
    model, counts, _ = m.train(src)
    assert np.allclose((10**model.step).sum(1), 1)
    assert np.allclose(np.bincount(model.classes, 10**model.emit, m.CLASSES)[np.unique(model.classes)], 1)
    assert model.classes[0] == m.CLASSES - 1 and (model.classes == m.CLASSES - 1).sum() == 1
    assert counts.groupBy().sum("c").first()[0] > 0


def _removed(rows, n=13):
    first = {}
    for r in rows:
        i = float("inf") if r[0] is None else r[0]
        w = words(r[1])
        for k in range(len(w) - n + 1):
            key = tuple(w[k:k + n])
            first[key] = min(i, first.get(key, float("inf")))
    out = []
    for r in rows:
        i, w = float("inf") if r[0] is None else r[0], words(r[1])
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < i:
                gone[k:k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), _sha(kept), kept))
    return sorted(out, key=str)


def test_substring_dedup_equals_brute_force(spark, monkeypatch):
    import chartlake.llm.substring_dedup as m

    rows = documents(spark, 120)
    got = substring_dedup(frame(spark, rows), with_text=True).collect()
    assert sorted([tuple(r) for r in got], key=str) == _removed(rows)
    monkeypatch.setattr(m, "GROUP_BYTES", 4000)
    monkeypatch.setattr(m, "RANGE_BYTES", 1000)
    got = substring_dedup(frame(spark, rows), with_text=True).collect()
    assert sorted([tuple(r) for r in got], key=str) == _removed(rows)


def test_substring_dedup_other_window(spark):
    rows = documents(spark, 60)
    got = substring_dedup(frame(spark, rows), window=6, with_text=True).collect()
    assert sorted([tuple(r) for r in got], key=str) == _removed(rows, 6)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert encode(none).collect() == [] and mix_sources(none).collect() == []
    assert score_texts(none).collect() == [] and substring_dedup(none).collect() == []


def test_unit_bigrams_count_every_token(spark):
    import numpy as np
    from chartlake.llm import class_lm
    texts = [" ".join(f"w{i}x{j}" for j in range(500)) for i in range(8)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = class_lm.unit_bigrams(docs, class_lm.Units(np.zeros(0, np.uint64)))  # no word is frequent: all share units by ending
    assert got.sum() == 8 * 501 + 2 and got[0].sum() == 10


def test_class_lm_gives_every_training_word_a_class_by_its_contexts(spark):
    """Words beyond the units, all of one ending, part by what stands beside them."""
    import numpy as np
    import pyarrow as pa

    from chartlake.llm import class_lm as m

    filler = [" ".join(f"f{i}x{i % 7}" for i in range(k, k + 100)) for k in range(0, m._WORDS + 300, 100) for _ in range(5)]
    one, two = [f"p{i}zz" for i in range(150)], [f"q{i}zz" for i in range(150)]
    texts = filler + [f"red {a} blue" for a in one] * 2 + [f"green {b} white" for b in two] * 2
    model, words, total = m.train(spark.createDataFrame([(t, False) for t in texts], "text string, held boolean"))
    class_of = {r.h: (r.c, r.k) for r in words.collect()}
    assert len(class_of) == len({w for t in texts for w in t.split()}) + 1 and total == sum(len(t.split()) + 1 for t in texts)
    got = lambda ws: [class_of[int(h)] for h in m._Tokens(pa.array([" ".join(ws)])).h[:-1].view(np.int64)]
    assert {c for c, _ in got(one + two)} == {2}
    (a, na), (b, nb) = (Counter(k for _, k in got(ws)).most_common(1)[0] for ws in (one, two))
    assert a != b and na >= 135 and nb >= 135  # before: all had the class of their ending


def test_class_lm_does_not_depend_on_the_words_that_tasks_hold(spark, monkeypatch):
    """Rare words get counts and classes by a join; they score as if every task held them."""
    from chartlake.llm import class_lm as m

    rows = documents(spark, 120)
    want = sorted(map(tuple, score_texts(frame(spark, rows)).collect()), key=str)
    monkeypatch.setattr(m, "TABLE", m._WORDS + 10)
    got = sorted(map(tuple, score_texts(frame(spark, rows)).collect()), key=str)
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-9)


def test_best_classes_equal_brute_force():
    import numpy as np

    from chartlake.llm import class_lm as m

    rng, n, v = np.random.RandomState(3), 5, 40
    seq = np.r_[0, (rng.zipf(1.4, 800) - 1) % (v - 1) + 1, 5, 5, 0]  # word 0 is the end, with the last class for itself
    pairs = np.zeros((v, v))
    np.add.at(pairs, (seq[:-1], seq[1:]), 1)
    classes = np.r_[n - 1, rng.randint(0, n - 1, v - 1)]
    s = m._class_bigrams(pairs, classes, n)
    near = lambda d, w: np.bincount(classes, np.where(np.arange(v) == w, 0, d), n).astype(np.int64)
    ws = np.arange(1, v)
    got = m.best_classes(np.array([near(pairs[w], w) for w in ws]), np.array([near(pairs[:, w], w) for w in ws]), pairs[ws, ws].astype(np.int64), classes[ws], s)
    for w, k in zip(ws, got, strict=True):
        value = [m.likelihood(pairs, np.where(np.arange(v) == w, b, classes), n) for b in range(n - 1)]
        assert value[k] == pytest.approx(max(value), abs=1e-6)
    assert (got != classes[ws]).any() and pairs[5, 5] > 0
