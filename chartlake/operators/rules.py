"""Rules that a user brings as a table (F1): terms and phrases with a category and a weight, matched against texts in one pass.

Texts are cut into words once; every run of as many words as some term has is looked up by an equi-join on the term, so
the time does not grow with the number of rules (a scan per term would), and a table of rules of any size works: Spark
broadcasts it where its measured size allows and shuffles both sides otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def _words(text: Column, fold: bool) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(F.lower(t) if fold else t, F.lit(WORD), 0)


def normal_terms(rules: DataFrame, fold: bool = False) -> DataFrame:
    """``(term, n_words, category, weight)``: terms with single spaces between words; terms without words and repeated (term, category)
    pairs go (the greatest weight stays); a null weight is 1."""
    w = _words(F.col("term"), fold)
    return rules.select(F.array_join(w, " ").alias("term"), F.size(w).alias("n_words"), "category", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight")).filter(
        "n_words > 0").groupBy("term", "n_words", "category").agg(F.max("weight").alias("weight"))


def rule_hits(docs: DataFrame, rules: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: bool = False) -> DataFrame:
    """``(doc_id, category, term, n, weight)``: how often each term of ``rules(term, category, weight)`` occurs in each text, as whole
    words; occurrences may overlap. ``fold`` compares in lower case. Only the distinct lengths of terms reach the driver."""
    terms = normal_terms(rules, fold)
    lengths = sorted(r.n_words for r in terms.select("n_words").distinct().collect())
    run = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(
        F.expr("cast(array() as array<string>)"))
    runs = F.concat(*[run(n) for n in lengths]) if lengths else F.expr("cast(array() as array<string>)")
    seen = docs.select(F.col(doc_id).alias("doc_id"), _words(F.col(text), fold).alias("w")).select("doc_id", F.explode(runs).alias("term"))
    return seen.join(terms.select("term", "category", "weight"), "term").groupBy("doc_id", "category", "term").agg(
        F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))


def rule_scores(docs: DataFrame, rules: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: bool = False) -> DataFrame:
    """``(doc_id, category, n_terms, n_hits, score)`` of each document and category with a hit; ``score`` adds up weight times count."""
    return rule_hits(docs, rules, doc_id, text, fold).groupBy("doc_id", "category").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("n_hits"), F.sum(F.col("weight") * F.col("n")).alias("score"))
