"""Behaviour containment between chart pairs.

For every pair (model1, model2): each cut-point path of model 1 must have a path in model 2
with an equivalent condition and the same data transform on the common variables. Conditions are turned
into keys that are equal for equivalent conditions (``functions.equivalence``), so the match is an equi-join on
(pair, condition key, transform key) — no nested loop, no solver, no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.charts import Charts
from chartlake.functions.equivalence import condition_keys
from chartlake.functions.guards import canonical_guards, fold_functions, transform_key
from chartlake.operators import graph
from chartlake.session import stored


def path_semantics(c: Charts, paths: DataFrame) -> DataFrame:
    """Per path: ``cond_key`` (E9: sorted distinct canonical non-true guards joined by
    ``' AND '``, ``'true'`` if none, NULL if a guard is unparsable) and ``xform`` (E8: final
    ``MAP<var, expr>`` after folding the target steps' assignments in hop order).

    Canonical guards are computed once per distinct guard text and the fold once per distinct sequence of step functions;
    both are joined back. Guard and step functions are put together once a transition, so that a path of one hop, as most
    are, is a lookup; the hops of longer paths are gathered."""
    given = c.transitions.withColumn("guard", F.coalesce("guard", F.lit("")))  # no guard: always true
    gcan = canonical_guards(given)
    tr = given.select("model_id", "t_idx", "guard", "tgt").join(gcan, "guard").drop("guard")
    # duplicate step names: the last definition wins
    fn = c.steps.groupBy("model_id", "name").agg(F.coalesce(F.max_by("function", "ord"), F.lit("")).alias("f"))
    one = tr.filter(F.size("tgt") == 1).select("model_id", "t_idx", "cg", F.col("tgt")[0].alias("name")).join(fn, ["model_id", "name"], "left").select(
        "model_id", "t_idx", "cg", F.filter(F.array("f"), lambda f: f.isNotNull()).alias("fs"))
    several = tr.filter(~(F.coalesce(F.size("tgt"), F.lit(0)) == 1)).select("model_id", "t_idx", "cg", F.posexplode_outer("tgt").alias("tpos", "name")).join(
        fn, ["model_id", "name"], "left").groupBy("model_id", "t_idx", "cg").agg(
        F.array_sort(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("tpos", "f")))).alias("_s")).select(
        "model_id", "t_idx", "cg", F.transform("_s", lambda x: x["f"]).alias("fs"))
    each = stored(one.unionByName(several))
    short = paths.filter(F.size("transitions") == 1).withColumn("t_idx", F.col("transitions")[0]).join(each, ["model_id", "t_idx"], "left").select(
        *paths.columns, F.col("cg").alias("cond_key"), F.col("fs").alias("fun_seq"))
    hops = paths.filter(F.size("transitions") != 1).select("model_id", "path_key", F.posexplode("transitions").alias("hop", "t_idx"))
    gathered = hops.join(each, ["model_id", "t_idx"]).groupBy("model_id", "path_key").agg(
        F.array_sort(F.collect_set(F.when(F.col("cg") != "true", F.col("cg")))).alias("_g"),
        F.max(F.col("cg").isNull().cast("int")).alias("_bad"),
        F.array_sort(F.collect_list(F.struct("hop", "fs"))).alias("_s"),
    ).select(
        "model_id", "path_key",
        F.when(F.col("_bad") == 1, F.lit(None).cast("string"))
        .when(F.size("_g") == 0, F.lit("true"))
        .otherwise(F.array_join("_g", " AND ")).alias("cond_key"),
        F.flatten(F.transform("_s", lambda x: x["fs"])).alias("fun_seq"),
    )
    long = paths.filter(F.size("transitions") != 1).join(gathered, ["model_id", "path_key"], "left").select(*paths.columns, "cond_key", "fun_seq")
    per = stored(short.unionByName(long))
    folds = per.select("fun_seq").distinct().select("fun_seq", fold_functions(F.col("fun_seq")).alias("xform"))
    return per.join(folds, "fun_seq", "left").drop("fun_seq").withColumn("xform", F.coalesce("xform", F.create_map().cast("map<string,string>")))


# J3 ------------------------------------------------------------------------------
def common_variables(c: Charts, pairs: DataFrame) -> DataFrame:
    m = c.meta.select("model_id", "variables")
    return (
        pairs.join(m.withColumnRenamed("model_id", "model1").withColumnRenamed("variables", "v1"), "model1")
        .join(m.withColumnRenamed("model_id", "model2").withColumnRenamed("variables", "v2"), "model2")
        .select("pair_id", "model1", "model2", F.array_sort(F.array_intersect("v1", "v2")).alias("common_vars"))
    )


def paired_charts(c: Charts, pairs: DataFrame) -> Charts:
    """The charts that occur in pairs, stored, as a dozen steps read them."""
    used = stored(pairs.select(F.explode(F.array("model1", "model2")).alias("model_id")).distinct())
    return Charts(*[stored(t.join(used, "model_id", "left_semi")) for t in (c.steps, c.transitions, c.meta)])


def model_paths(c: Charts, pairs: DataFrame, mode: str = "multi_hop", cuts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs with their ``common_vars``, and the semantic paths of each chart once for each list of common variables that
    it has in some pair, however many pairs that are: ``(model_id, common_vars, path_key, from_place, to_place, cond_key,
    cond_sem, cond_reason, xform_key)``.

    ``cuts``: the charts' cut-points, if at hand; ``c`` then are ``paired_charts``."""
    if cuts is None:
        c = paired_charts(c, pairs)
    sem = path_semantics(c, graph.cut_paths(c, cuts, mode=mode))
    sem = sem.join(condition_keys(sem), "cond_key", "left")
    cv = stored(common_variables(c, pairs).withColumn("common_vars", F.coalesce("common_vars", F.expr("cast(array() as array<string>)"))))
    uses = cv.select(F.explode(F.array("model1", "model2")).alias("model_id"), "common_vars").distinct()
    return cv, stored(sem.join(uses, "model_id").select(
        "model_id", "common_vars", "path_key", "from_place", "to_place", "cond_key", "cond_sem", "cond_reason",
        transform_key(F.col("xform"), F.col("common_vars")).alias("xform_key")))


def pair_paths(c: Charts, pairs: DataFrame, mode: str = "multi_hop", cuts: DataFrame | None = None,
               expand: bool = True) -> tuple[DataFrame, DataFrame]:
    """Semantic paths of both sides of each pair with the transform key restricted to the
    pair's common variables: ``(pair_id, path_key, from_place, to_place, cond_key, xform_key)`` (see ``model_paths``).

    ``expand=False``: the second side once for ``(model2, common_vars)``, which the first side then has too, not once for
    each pair of a model 2; ``path_match`` takes either."""
    cv, paths = model_paths(c, pairs, mode, cuts)
    side = lambda m: cv.join(paths.withColumnRenamed("model_id", m), [m, "common_vars"])
    if expand:
        return tuple(side(m).drop("model1", "model2", "common_vars") for m in ("model1", "model2"))
    second = paths.join(cv.select(F.col("model2").alias("model_id"), "common_vars").distinct(), ["model_id", "common_vars"], "left_semi")
    return side("model1").drop("model1"), second.withColumnRenamed("model_id", "model2")


# J4 / J5 / A5 --------------------------------------------------------------------
def path_match(p1: DataFrame, p2: DataFrame) -> DataFrame:
    """For each model-1 path the first (smallest ``path_key``) model-2 path with an equivalent condition and the same
    transform. Paths whose condition cannot be read (``cond_sem`` NULL) match nothing."""
    key = [*(["pair_id"] if "pair_id" in p2.columns else ["model2", "common_vars"]), "cond_sem", "xform_key"]
    k2 = p2.groupBy(*key).agg(F.min("path_key").alias("match_key"))
    return p1.join(k2, key).select("pair_id", "path_key", "match_key")


def path_unmatched(p1: DataFrame, matches: DataFrame) -> DataFrame:
    return p1.join(matches, ["pair_id", "path_key"], "left_anti")


def containment(c: Charts, pairs: DataFrame, mode: str = "multi_hop") -> DataFrame:
    """``(pair_id, model1, model2, paths1, matched, unmatched, unknown, contained, vacuous)``.

    ``unknown`` counts the unmatched paths whose condition could not be read or decided (``cond_reason``): for these,
    that no match was found does not mean that there is none."""
    p1, p2 = pair_paths(c, pairs, mode, expand=False)
    m = path_match(p1, p2)
    open_ = F.col("match_key").isNull() & (F.col("cond_sem").isNull() | F.col("cond_reason").isNotNull())
    per = p1.join(m, ["pair_id", "path_key"], "left").groupBy("pair_id").agg(
        F.count("*").alias("paths1"),
        F.count("match_key").alias("matched"),
        F.count(F.when(open_, 1)).alias("unknown"),
    )
    return pairs.join(per, "pair_id", "left").select(
        "pair_id", "model1", "model2",
        F.coalesce("paths1", F.lit(0)).cast("bigint").alias("paths1"),
        F.coalesce("matched", F.lit(0)).cast("bigint").alias("matched"),
        (F.coalesce("paths1", F.lit(0)) - F.coalesce("matched", F.lit(0))).cast("bigint").alias("unmatched"),
        F.coalesce("unknown", F.lit(0)).cast("bigint").alias("unknown"),
        (F.coalesce("paths1", F.lit(0)) == F.coalesce("matched", F.lit(0))).alias("contained"),
        (F.coalesce("paths1", F.lit(0)) == 0).alias("vacuous"),
    )
