"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every source has a target number of words; ``target / size`` copies of each of its documents would
reach it. The whole part of that ratio is allocated to every document for certain. The fraction is
drawn by Pareto order sampling: a document's rank is the odds of a reproducible uniform number
divided by the odds of its inclusion probability, and the documents of least rank are taken until
the words that are missing are filled. The size of the sample is fixed in words, not in documents.

A hot source never meets in one task: documents are summed by (source, slot of the rank), the
running sum goes over the slots, and only the few slots at the border (about ``3 * SLOT_DOCS``
documents a source) are filled one document at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlake.llm.common import checkpoint

#: Documents expected in one slot of the rank order.
SLOT_DOCS = 1000
#: Slots from the border on that are filled document by document.
BORDER_SLOTS = 3
#: Up to so many sources the table of plans is broadcast (one short row each); beyond, it is joined.
BROADCAST_SOURCES = 5000


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def uniform(*cols: Column, seed: int) -> Column:
    """Reproducible number in (0, 1) from the values of a row."""
    h = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11).cast("double")
    return (h + 0.5) / F.lit(float(2**53))


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source (``source, source_size, n_docs, target``) from ``source, size`` rows.

    Sources in code point order, null last, take the weights in turn. They divide ``share`` of all words
    by weight; no target goes beyond ``most`` times its source's size, and the excess goes to the others by
    weight. The level ``target / weight`` of the sources that stay below follows from running sums over the
    sources ordered by ``most * size / weight``.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                            ((F.row_number().over(order) - 1) % n + 1).cast("int")))
    per = per.withColumn("_cap", F.lit(most) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    per = (
        per.withColumn("_all", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_full", F.col("_ratio") <= (F.col("_all") - F.col("_before")) / F.col("_rest"))
        .withColumn("_level", (F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything))
                    / F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(everything))
    )
    return per.select("source", "source_size", "n_docs",
                      F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.col("_level")).alias("target"))


def _plans(rows: DataFrame, targets: DataFrame, small) -> DataFrame:
    """Per source: whole copies of each document, slots, the border slot and the ranks taken at the border."""
    t = (
        targets.withColumn("_copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.floor(F.col("_copies") + 1e-12))
        .withColumn("_miss", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
        .withColumn("pi", F.col("_miss") / F.greatest(F.col("source_size"), F.lit(1)))
        .withColumn("slots", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / SLOT_DOCS)))
        .select("source", "source_size", "target", "whole", "_miss", "pi", "slots")
    )
    slots = t.select(F.col("source").alias("_s"), "slots")
    placed = rows.join(small(slots), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_slot", _slot())
    sums = placed.groupBy("source", "_slot").agg(F.sum("size").alias("_words"))
    run = Window.partitionBy("source").orderBy("_slot")
    sums = sums.withColumn("_upto", F.sum("_words").over(run))
    hit = (
        sums.join(small(t.select(F.col("source").alias("_s"), "_miss")), F.col("source").eqNullSafe(F.col("_s")))
        .filter("_upto > _miss").groupBy("source")
        .agg(F.min(F.struct("_slot", (F.col("_miss") - (F.col("_upto") - F.col("_words"))).alias("left"))).alias("h"))
        .select(F.col("source").alias("_b"), F.col("h._slot").alias("border"), F.col("h.left").alias("left"))
    )
    near = (
        placed.join(small(hit), F.col("source").eqNullSafe(F.col("_b")))
        .filter((F.col("_slot") >= F.col("border")) & (F.col("_slot") < F.col("border") + BORDER_SLOTS) & (F.col("size") > 0))
        .groupBy("source", "left").agg(F.sort_array(F.collect_list(F.struct("u", "size"))).alias("_docs"))
    )
    take = F.aggregate(
        "_docs",
        F.struct(F.col("left").alias("left"), F.expr("cast(array() as array<double>)").alias("u")),
        lambda acc, x: F.when(
            x["size"] <= acc["left"],
            F.struct((acc["left"] - x["size"]).alias("left"), F.concat(acc["u"], F.array(x["u"])).alias("u")),
        ).otherwise(acc),
        lambda acc: acc["u"],
    )
    near = near.select(F.col("source").alias("_n"), take.alias("fill"))
    return (
        t.join(hit, F.col("source").eqNullSafe(F.col("_b")), "left")
        .join(near, F.col("source").eqNullSafe(F.col("_n")), "left")
        .select(F.col("source").alias("_s"), "source_size", "target", "whole", "slots", "border", "fill", "pi")
    )


def _slot() -> Column:
    return F.floor(F.col("u") * F.col("slots"))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 41,
                doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The input's columns with ``_mix`` = struct(size, source_size, target, copies, taken, pareto).

    ``copies`` is 0, 1 or more (at most ``most``, rounded up only where the fraction draws the document);
    ``taken = copies * size``. Reruns give the same mix, as the uniform numbers are hashes of id and text.

    Null ids and texts are values like others (a null text has size 0); a null source is one source, the
    last; rows alike in id and text are drawn together; an empty table gives an empty result; only the
    three named columns are read, and all others pass through.
    """
    rows = checkpoint(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                                  uniform(F.col(doc_id), F.col(text), seed=seed).alias("u")))
    targets = checkpoint(source_targets(rows, weights, share, most))
    small = F.broadcast if targets.count() <= BROADCAST_SOURCES else (lambda d: d)
    plans = checkpoint(_plans(rows, targets, small))
    u, size = uniform(F.col(doc_id), F.col(text), seed=seed), word_count(F.col(text))
    cols = docs.columns
    out = docs.withColumn("_mix_row", F.struct(u.alias("u"), size.alias("size"))).join(
        small(plans.withColumnsRenamed({c: f"_mix_{c}" for c in plans.columns})),
        F.col(source).eqNullSafe(F.col("_mix__s")))
    slot = F.floor(F.col("_mix_row.u") * F.col("_mix_slots"))
    extra = F.when(slot < F.coalesce(F.col("_mix_border"), F.col("_mix_slots")), 1).when(
        F.array_contains(F.col("_mix_fill"), F.col("_mix_row.u")) & (F.col("_mix_row.size") > 0), 1).otherwise(0)
    extra = F.when(F.col("_mix_pi") > 0, extra).otherwise(0)
    copies = (F.col("_mix_whole") + extra).cast("long")
    odds = lambda p: p / (F.lit(1.0) - p)
    return out.select(*[F.col(f"`{c}`") for c in cols], F.struct(
        F.col("_mix_row.size").alias("size"), F.col("_mix_source_size").cast("long").alias("source_size"),
        F.col("_mix_target").alias("target"), copies.alias("copies"),
        (copies * F.col("_mix_row.size")).cast("long").alias("taken"),
        F.when((F.col("_mix_pi") > 0) & (F.col("_mix_pi") < 1), odds(F.col("_mix_row.u")) / odds(F.col("_mix_pi"))).alias("pareto"),
    ).alias("_mix"))
