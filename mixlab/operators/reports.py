"""The reports' tables (X1-X3). An enriched table is first cut down to its features in long form (feature, cohort or
origin, value): texts go no further. Every table is one grouped job over those rows, for all features and cohorts together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlab.functions.selection import quantiles
from mixlab.functions.text import word_count
from mixlab.operators.stats import quartile_cohorts, top_ngrams

PAIRED = {"qa": ["question_length", "answer_length", "question_best_bleu_w_context", "answer_location_bleu", "answer_location_ratio"],
          "fv": ["claim_length", "claim_best_bleu_w_context", "claim_location_ratio"]}
PREDICTED = {"qa": ["question_length", "answer_length", "prediction_length", "answer_location_ratio", "pred_location_ratio",
                    "question_best_bleu_w_context", "answer_location_bleu", "pred_location_bleu"],
             "fv": ["claim_best_bleu_w_context", "claim_location_ratio", "claim_length"]}
NGRAM_COLUMNS = {"qa": ["question", "syn_question", "answer", "syn_answer", "prediction"], "fv": ["claim", "syn_claim"]}
#: Decimals of a value: engines differ behind them.
DIGITS = 6


def _feature(name: str, prefix: str = "") -> Column:
    """A feature's column; lengths are word counts of the text."""
    if name.endswith("_length"):
        return word_count(prefix + name.removesuffix("_length")).cast("double")
    return F.round(F.col(prefix + name).cast("double"), DIGITS)


def melt(df: DataFrame, keys: Sequence[str], label: str, values: Mapping[tuple[str, str] | str, Column]) -> DataFrame:
    """Long form: keys, feature, value and, for (feature, label) names, the column ``label``."""
    cells = []
    for name, v in values.items():
        feature, tag = name if isinstance(name, tuple) else (name, None)
        cells.append(F.struct(F.lit(feature).alias("feature"), *([F.lit(tag).alias(label)] if tag else []), v.alias("value")))
    return df.select(*keys, F.inline(F.array(*cells)))


def generated_values(enriched: DataFrame, task: str) -> DataFrame:
    """(feature, origin, value) of the human and the generated texts of enriched rows."""
    both = {(f, o): _feature(f, p) for f in PAIRED[task] for o, p in (("human", ""), ("generated", "syn_"))}
    return melt(enriched, [], "origin", both)


def prediction_features(enriched: DataFrame, task: str, id_col: str = "id") -> DataFrame:
    """The id, the score and the features of enriched rows; write them once, ranks and quantiles read them several times."""
    return enriched.select(id_col, "score", *[_feature(f).alias(f) for f in PREDICTED[task]])


def prediction_values(features: DataFrame, task: str, id_col: str = "id", frac: float = 0.25) -> DataFrame:
    """(cohort, feature, value) of the best and the worst predictions by score, the score itself among the features."""
    cohorts = quartile_cohorts(features, "score", id_col, frac).where("cohort IS NOT NULL")
    return melt(cohorts, ["cohort"], "", {"score": F.round("score", DIGITS), **{f: F.col(f) for f in PREDICTED[task]}})


def cohort_difference(values: DataFrame, a: str = "top", b: str = "bottom") -> DataFrame:
    """Difference of means and of medians of each feature between two cohorts."""
    q = quantiles(values, "value", [0.5], ["feature", "cohort"], [F.avg("v").alias("mean")])
    of = lambda cohort, v: F.max(F.when(F.col("cohort") == cohort, v))
    median = F.get("q", F.lit(0))
    return q.groupBy("feature").agg((of(a, F.col("mean")) - of(b, F.col("mean"))).alias("mean_difference"),
                                    (of(a, median) - of(b, median)).alias("median_difference"))


def score_splits(enriched: DataFrame, threshold: float = 0.5) -> DataFrame:
    """X3 (fv): (split, feature, value = score) by label and by hard prediction (prediction > threshold)."""
    hard = F.when(F.col("prediction") > threshold, F.lit(1)).otherwise(F.lit(0))  # no prediction counts as 0
    cells = F.array(F.struct(F.lit("label").alias("split"), F.col("label").cast("long").alias("of")),
                    F.struct(F.lit("pred").alias("split"), hard.cast("long").alias("of")))
    return enriched.select(F.round("score", DIGITS).alias("value"), F.inline(cells))


def ngram_report(df: DataFrame, columns: Sequence[str], n: int = 4, k: int = 10) -> DataFrame:
    """A6 of all text columns in the same passes: (column, ngram, n, pct)."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in columns]
    return top_ngrams(df.select(F.inline(F.array(*cells))), "text", n, k, ["column"])


def length_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("dataset_name",)) -> DataFrame:
    """(by, feature, value): word counts of the text columns."""
    return melt(df, list(by), "", {c: word_count(c).cast("double") for c in columns})


def corpus_totals(values: DataFrame, by: Sequence[str] = ("dataset_name",)) -> DataFrame:
    """Rows, mean and sum of every feature per group and over all (group ``all``), by grouping sets in one scan."""
    by = list(by)
    sets = values.groupingSets([[*by, "feature"], ["feature"]], *by, "feature")
    g = sets.agg(F.grouping(by[0]).alias("_all"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.sum("value").alias("sum"))
    for c in by:
        g = g.withColumn(c, F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(c)))
    return g.drop("_all")
