"""Repair prompts and replies (X10, F2): per-pair prompts built from the unmatched-path
table, and a batch hook that maps prompts to replies through a user-supplied function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.charts import Charts
from chartlake.session import stored

DEFAULT_TEMPLATE = (
    "Chart 1:\n{sfc1_code}\n\nChart 2:\n{sfc2_code}\n\n"
    "Paths of chart 1 without an equivalent in chart 2:\n{non_equiv_paths_str}\n\n"
    "Return the corrected steps2 and transitions2 lists."
)
PATH_TABLE_HEADER = "From\tTo\tTransitions\tCondition\tData Transformation"
REPLY_SCHEMA = "pair_id string, reply string, tokens bigint"


def chart_lists(c: Charts) -> DataFrame:
    """``(model_id, s_txt, t_txt)``: the chart's steps and transitions as texts."""
    st = c.steps.groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct("ord", "name", "function"))).alias("s"))
    tr = c.transitions.groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct("t_idx", "src", "tgt", "guard"))).alias("t"))
    s_txt = F.array_join(F.transform("s", lambda x: F.concat(F.lit("{"), x["name"], F.lit(": "), x["function"], F.lit("}"))), ", ")
    t_txt = F.coalesce(F.array_join(F.transform("t", lambda x: F.concat(
        F.array_join(x["src"], ","), F.lit(" > "), F.array_join(x["tgt"], ","), F.lit(" ["), x["guard"], F.lit("]"))), ", "), F.lit(""))
    return st.join(tr, "model_id", "left").select("model_id", s_txt.alias("s_txt"), t_txt.alias("t_txt"))


def code_text(label: str) -> Column:
    return F.concat(F.lit(f"steps{label} = ["), "s_txt", F.lit(f"]\ntransitions{label} = ["), "t_txt", F.lit("]"))


def chart_code(c: Charts, label: str) -> DataFrame:
    """``(model_id, code)``: the chart's steps and transitions as one text block."""
    return chart_lists(c).select("model_id", code_text(label).alias("code"))


def render_prompt(template: Column | str, slots: dict[str, Column]) -> Column:
    """Fill ``{slot}`` placeholders (one ``replace`` per slot)."""
    out = F.lit(template) if isinstance(template, str) else template
    for k, v in slots.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def repair_prompts(c: Charts, pairs: DataFrame, unmatched: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """``(pair_id, prompt)`` for the pairs with unmatched paths; the path table lists them by
    path key (a per-pair list, bounded by the chart)."""
    rows = unmatched.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct(
        "path_key", "from_place", "to_place", "cond_key", "xform_key"))).alias("p"))
    table = F.concat(F.lit(PATH_TABLE_HEADER + "\n"), F.array_join(F.transform("p", lambda x: F.concat_ws(
        "\t", x["from_place"], x["to_place"], F.substring_index(x["path_key"], ">", 1), x["cond_key"], x["xform_key"])), "\n"))
    lists = stored(chart_lists(c))  # read for both sides
    code1 = lists.select(F.col("model_id").alias("model1"), code_text("1").alias("code1"))
    code2 = lists.select(F.col("model_id").alias("model2"), code_text("2").alias("code2"))
    j = rows.join(pairs, "pair_id").join(code1, "model1", "left").join(code2, "model2", "left")
    return j.select("pair_id", render_prompt(template, {
        "non_equiv_paths_str": table, "sfc1_code": F.coalesce("code1", F.lit("")), "sfc2_code": F.coalesce("code2", F.lit(""))
    }).alias("prompt"))


def repair_batch(prompts: DataFrame, improve: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``improve`` maps a pandas batch ``(pair_id, prompt)`` to ``(pair_id, reply, tokens)``;
    Spark streams the batches through it with Arrow (no network code is shipped here)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield improve(b)[["pair_id", "reply", "tokens"]]

    return prompts.select("pair_id", "prompt").mapInPandas(run, REPLY_SCHEMA)


def echo_improve(batch: pd.DataFrame) -> pd.DataFrame:
    """Reference ``improve`` for tests: replies with empty lists, tokens from the prompt words."""
    words = batch["prompt"].str.split().str.len().fillna(0)
    return pd.DataFrame({
        "pair_id": batch["pair_id"],
        "reply": "```python\nsteps2 = []\ntransitions2 = []\n```",
        "tokens": (words / 0.75).astype("int64"),
    })
