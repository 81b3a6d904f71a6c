"""Quality classifier: a sparse ensemble of rules, compiled into Spark column expressions.

Boosted shallow trees over text statistics propose rules (the conjunctions along their paths); a lasso logistic
fit keeps few of them with weights; the fitted rules become one column expression, so scoring is a projection.
Statistics are computed by Spark for every whole text; the fit runs on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.llm.common import stored, text_or_empty

#: Labelled rows that the fit uses at most: those with the least hash of the id.
SAMPLE = 20_000
TREES, DEPTH, CUTS, RATE = 24, 3, 24, 0.4
LASSO = 0.002
THRESHOLD = 0.3


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text is divisible by 5. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def statistics(text: str = "text") -> dict[str, Column]:
    """Statistics of a text; null and empty texts have zeros."""
    t = text_or_empty(text)
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    words = F.filter(F.split(F.lower(t), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\\n"), lambda x: x != "")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    return {
        "chars": F.log(n),
        "upper": count("\\p{Lu}") / n,
        "digits": count("[0-9]") / n,
        "marks": count("[!?]") / n,
        "symbols": count("[#$%&*+=@^~<>\\\\/]") / n,
        "bars": count("\\|") / n,
        "stops": count("[.,;:]") / n,
        "lines": count("\\n") / n,
        "word_length": F.when(F.length(t) > 0, n / n_words).otherwise(0.0),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
    }


FEATURES = ("chars", "upper", "digits", "marks", "symbols", "bars", "stops", "lines", "word_length", "distinct_words", "distinct_lines")
#: A rule: conditions (feature, is_above, cut); above means greater than the cut.
Rule = tuple[tuple[int, bool, float], ...]


def _tree(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> list[tuple[Rule, np.ndarray, float]]:
    """Paths to all nodes of a boosted tree: (rule, rows in it, value; nan for inner nodes)."""
    out = []

    def grow(rows: np.ndarray, path: Rule, depth: int) -> None:
        best = (1e-3, -1, -1)
        if depth < DEPTH:
            gs, hs = g[rows].sum(), h[rows].sum()
            for f in range(bins.shape[1]):
                if not len(cuts[f]):
                    continue
                gl = np.cumsum(np.bincount(bins[rows, f], g[rows], len(cuts[f]) + 1))[:-1]
                hl = np.cumsum(np.bincount(bins[rows, f], h[rows], len(cuts[f]) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl)**2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < 1) | (hs - hl < 1)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        _, f, k = best
        if f < 0:
            out.append((path, rows, -g[rows].sum() / (h[rows].sum() + 1)))
            return
        if path:
            out.append((path, rows, math.nan))
        above = bins[rows, f] > k
        for side in (False, True):
            grow(rows[above == side], (*path, (f, side, float(cuts[f][k]))), depth + 1)

    grow(np.arange(len(bins)), (), 0)
    return out


def _simplify(path: Rule) -> Rule:
    """Keep the tightest condition for each feature and side."""
    kept: dict[tuple[int, bool], float] = {}
    for f, side, cut in path:
        old = kept.get((f, side), cut)
        kept[(f, side)] = max(old, cut) if side else min(old, cut)
    return tuple((f, side, cut) for (f, side), cut in sorted(kept.items()))


def fit_rules(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules. Without both labels the intercept is all there is."""
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    prior = math.log(mean / (1 - mean))
    if not len(y) or y.min() == y.max():
        return prior, []
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1]))
        cuts.append(v[v < x[:, f].max()])
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    rules: dict[Rule, None] = {}
    z = np.full(len(y), prior)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        for path, rows, value in _tree(bins, cuts, p - y, p * (1 - p)):
            if not math.isnan(value):
                z[rows] += RATE * value
            if path:
                rules[_simplify(path)] = None
    if not rules:  # too few rows for any tree to split
        return prior, []
    a = np.stack([np.logical_and.reduce([(x[:, f] > cut) == side for f, side, cut in r]) for r in rules], axis=1).astype(float)
    keep = (a.mean(0) > 0.002) & (a.mean(0) < 0.998)
    if not keep.any():
        return prior, []
    a, names = a[:, keep], [r for r, k in zip(rules, keep, strict=True) if k]
    # lasso logistic regression by accelerated proximal gradient steps
    n = len(y)
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 4.0 * n / (float(np.linalg.norm(a @ v) ** 2) + n)
    w, b = np.zeros(a.shape[1]), prior
    wy, by, t = w, b, 1.0
    for _ in range(400):
        e = 1 / (1 + np.exp(-(a @ wy + by))) - y
        w1 = wy - rate * (a.T @ e) / n
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - rate * LASSO, 0)
        b1 = by - rate * e.mean()
        t1 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        wy, by = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return float(b), [(r, float(k)) for r, k in zip(names, w, strict=True) if abs(k) > 1e-6]


def compile_rules(intercept: float, rules: list[tuple[Rule, float]], value) -> Column:
    """The score as a column; ``value(name)`` gives the column of a statistic."""
    z = F.lit(intercept)
    for rule, weight in rules:
        test = None
        for f, side, cut in rule:
            one = value(FEATURES[f]) > cut if side else value(FEATURES[f]) <= cut
            test = one if test is None else test & one
        z = z + F.when(test, weight).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple:
    """(docs' id and statistics as a stored table, intercept, rules). Rows without a label teach nothing."""
    feats = stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"),
                               *[c.cast("double").alias(k) for k, c in statistics(text).items()]))
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("_y")).filter(
        F.col("_y").isin(0.0, 1.0))
    got = feats.filter("not held_out").join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "_y", *FEATURES).limit(SAMPLE).select(
        "_y", *FEATURES).toArrow()
    x = np.stack([got.column(k).to_numpy() for k in FEATURES], axis=1) if got.num_rows else np.zeros((0, len(FEATURES)))
    intercept, rules = fit_rules(x, got.column("_y").to_numpy())
    return feats, intercept, rules


def score_quality(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    The score comes from the text alone, null and empty texts included; repeated rows score alike; without labels,
    or with one label only, all have the same score; an empty table gives an empty result.
    """
    feats, intercept, rules = learn(docs, labels, **names)
    score = compile_rules(intercept, rules, F.col)
    return feats.select("doc_id", "held_out", score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", **names) -> DataFrame:
    """The documents whose score reaches the threshold, with the columns as they are."""
    _, intercept, rules = learn(docs, labels, text=text, **names)
    # one struct of statistics, bound once, so that no rule computes a statistic again
    stats = F.array(F.struct(*[c.cast("double").alias(k) for k, c in statistics(text).items()]))
    score = F.transform(stats, lambda s: compile_rules(intercept, rules, lambda k: s[k]))[0]
    return docs.filter(score >= THRESHOLD)
