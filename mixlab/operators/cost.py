"""Usage and cost rollup.

The price list is a literal map (two entries) evaluated in codegen -- a
dimension this small needs no join; unknown models go to a rejects frame
instead of raising.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# USD per 1M tokens (prompt, completion).
PRICES = {"gpt-3.5-turbo-0125": (0.5, 1.5), "gpt-4-turbo": (10.0, 30.0)}
MILLION = 1_000_000


def _price():
    return F.create_map(*[x for m, (p, c) in PRICES.items()
                          for x in (F.lit(m), F.struct(F.lit(p).alias("p"), F.lit(c).alias("c")))])


def priced(usage: DataFrame, model: str = "model") -> tuple[DataFrame, DataFrame]:
    """(priced rows, rejects): per-request prompt/completion cost."""
    pr = F.try_element_at(_price(), F.col(model))
    d = usage.withColumn("_pr", pr)
    ok = d.filter(F.col("_pr").isNotNull()).withColumn(
        "prompt_cost", F.col("prompt_tokens") * (F.col("_pr.p") / MILLION)).withColumn(
        "completion_cost", F.col("completion_tokens") * (F.col("_pr.c") / MILLION)).drop("_pr")
    return ok, d.filter(F.col("_pr").isNull()).drop("_pr")


def cost_rollup(usage: DataFrame, model: str = "model") -> DataFrame:
    """Tokens and cost per model plus a grand-total row (model NULL)."""
    ok, _ = priced(usage, model)
    return ok.rollup(model).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("prompt_cost").alias("prompt_cost"),
        F.sum("completion_cost").alias("completion_cost"),
        (F.sum("prompt_cost") + F.sum("completion_cost")).alias("total_cost"))
