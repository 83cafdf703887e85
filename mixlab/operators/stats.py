"""Descriptive aggregates (A1-A6, A9, A15, A16). All are hash aggregates with
map-side partial combine; shares divide by a total computed on the already
aggregated (small) table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlab.functions.selection import attach, quantiles, same_group
from mixlab.session import cut_lineage


def value_share(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "share") -> DataFrame:
    """A1: value frequencies and their share within ``by``; NULL values are
    excluded from both the counts and the denominator (pandas value_counts)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    if by:
        total = F.sum("n").over(Window.partitionBy(*by))
    else:  # scalar subquery: no single-partition window even for many values
        total = counts.select(F.sum("n")).scalar()
    return counts.withColumn(name, F.col("n") / total)


def describe(df: DataFrame, value: str, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """A2 / A3: count, mean, sample std, min, 25/50/75 % (linear
    interpolation, as pandas), max, optionally per group. The exact quantiles are found by
    distributed selection (``functions/selection.py``): no buffer holds the values of a column.
    ``exact=False`` answers from a sketch in one pass."""
    aggs = [F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
            F.min("v").alias("min"), F.max("v").alias("max")]
    probs = [0.25, 0.5, 0.75]
    if exact:
        out = quantiles(df, value, probs, by, aggs)
    else:
        q = F.percentile_approx("v", probs, 10000).cast("array<double>")
        out = df.select(*by, F.col(value).cast("double").alias("v")).groupBy(*by).agg(*aggs, q.alias("q"))
    return out.select(*by, "count", "mean", "std", "min", F.get("q", F.lit(0)).alias("p25"),
                      F.get("q", F.lit(1)).alias("p50"), F.get("q", F.lit(2)).alias("p75"), "max")


def group_mean_sum(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """A4: mean and sum of numeric columns per group."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.sum(c).alias(f"{c}_sum")]
    return df.groupBy(*by).agg(*aggs)


def confusion_share(df: DataFrame, by: str, y_true: str, y_pred: str) -> DataFrame:
    """A5: confusion matrix normalised over all rows of each group; the grid
    is every pair of values seen in either column of the group (zero cells
    kept). The grid is built per group from its distinct values -- small."""
    counts = df.groupBy(by, y_true, y_pred).agg(F.count(F.lit(1)).alias("n"))
    vals = df.select(by, F.col(y_true).alias("v")).union(df.select(by, F.col(y_pred).alias("v"))).distinct()
    grid = vals.withColumnRenamed("v", y_true).join(vals.withColumnRenamed("v", y_pred), by)
    totals = df.groupBy(by).agg(F.count(F.lit(1)).alias("_total"))
    g = grid.join(counts, [by, y_true, y_pred], "left").join(totals, by)
    return g.select(by, y_true, y_pred, F.coalesce("n", F.lit(0)).alias("n"),
                    (F.coalesce("n", F.lit(0)) / F.col("_total")).alias("share"))


#: Hash buckets of the first pass of ``top_ngrams``, and those looked into first.
GRAM_BUCKETS = 1 << 18
FIRST_BUCKETS = 1 << 12


def top_ngrams(df: DataFrame, text: str, n: int = 4, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The k most frequent word n-grams (of each group) as a percent of all n-grams, ties by the gram. Exact, in three
    passes for all groups together: (1) occurrences per hash bucket, an upper bound for every
    gram of the bucket, written once; (2) exact counts of the grams of the largest buckets, whose k-th count is
    a lower bound of the true one; (3) exact counts of the grams of all buckets that reach it, of which the top k are taken."""
    from mixlab.functions.text import word_ngrams

    by = list(by)
    grams = df.select(*by, F.explode(word_ngrams(text, n)).alias("ngram"))
    grams = grams.withColumn("_b", F.pmod(F.xxhash64("ngram"), F.lit(GRAM_BUCKETS)).cast("int"))
    totals = cut_lineage(grams.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c")))  # GRAM_BUCKETS rows a group at most

    def leading(d: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
        if not by:
            return d.orderBy(*order).limit(most)
        return d.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= most).drop("_r")

    def counted(buckets: DataFrame) -> DataFrame:
        at = buckets.select(*[F.col(c).alias(f"_g_{c}") for c in [*by, "_b"]])
        inside = grams.join(F.broadcast(at), same_group(grams, at, [*by, "_b"]), "left_semi")
        return inside.groupBy(*by, "ngram").agg(F.count(F.lit(1)).alias("n"))

    order = [F.desc("n"), F.col("ngram")]
    first = leading(counted(leading(totals, [F.desc("_c"), F.col("_b")], max(FIRST_BUCKETS, k))), order, k)
    least = first.groupBy(*by).agg(F.when(F.count(F.lit(1)) == k, F.min("n")).otherwise(F.lit(0)).alias("least"))
    least = F.broadcast(cut_lineage(least))  # a row a group (groups are few); pass (3) would repeat pass (2) for each use
    found = counted(attach(totals, least, by, ["least"]).where(F.col("_c") >= F.col("least")))
    found = attach(found, least, by, ["least"]).where(F.col("n") >= F.col("least")).drop("least")
    all_of = totals.groupBy(*by).agg(F.sum("_c").alias("_all"))
    out = attach(leading(found, order, k), all_of, by, ["_all"])
    return out.select(*by, "ngram", "n", (F.col("n") * 100.0 / F.col("_all")).alias("pct")).orderBy(*by, *order)


def length_stats(df: DataFrame, length: str) -> DataFrame:
    """Count, min, max, mean, upper median t[n//2] and p95 t[int(.95n)]
    (index picks on the sorted lengths). Works on the histogram of distinct
    lengths (far fewer than rows): cumulative counts, then the first length
    whose cumulative count passes the wanted index."""
    hist = df.groupBy(length).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy(length).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("cum", F.sum("c").over(w))
    n = hist.select(F.sum("c")).scalar()
    i_med = F.floor(n / 2)
    i_95 = F.floor(n.cast("double") * 0.95)
    return cum.agg(
        F.sum("c").alias("count"), F.min(length).alias("min"), F.max(length).alias("max"),
        (F.sum(F.col(length) * F.col("c")) / F.sum("c")).alias("mean"),
        F.min(F.when(F.col("cum") > i_med, F.col(length))).alias("median"),
        F.min(F.when(F.col("cum") > i_95, F.col(length))).alias("p95"),
    )


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between min and max (max in the last bin);
    share of rows per bin, empty bins kept. Bounds are scalar subqueries,
    the counts one partial/final aggregate over at most ``bins`` keys."""
    v = F.col(value).cast("double")
    stats = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"))
    lo, hi, n = (stats.select(c).scalar() for c in ("lo", "hi", "n"))
    width = (hi - lo) / bins
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((v - lo) / width), F.lit(bins - 1))).cast("int")
    counts = df.filter(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    g = grid.join(F.broadcast(counts), "bin", "left")  # at most ``bins`` rows
    return g.select("bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / n).alias("share"))


def quartile_cohorts(df: DataFrame, score: str, id_col: str = "id", frac: float = 0.25) -> DataFrame:
    """Adds ``cohort``: ``top`` for the first int(frac n) rows by score (desc, NULL last, then id), ``bottom`` for
    those from int((1-frac) n) on, NULL between. One exact rank (bucketed by score range)."""
    from mixlab.functions.keys import numeric_rank

    n = df.select(F.count(F.lit(1))).scalar()
    r = numeric_rank(df, score, descending=True, tiebreak=[id_col], name="_r")
    cohort = (F.when(F.col("_r") <= F.floor(n.cast("double") * frac), F.lit("top"))
              .when(F.col("_r") > F.floor(n.cast("double") * (1.0 - frac)), F.lit("bottom")))
    return r.withColumn("cohort", cohort).drop("_r")


def quartile_contrast(df: DataFrame, score: str, id_col: str = "id", frac: float = 0.25) -> DataFrame:
    """The rows of both cohorts of ``quartile_cohorts``."""
    return quartile_cohorts(df, score, id_col, frac).filter(F.col("cohort").isNotNull())


def grouped_histogram(df: DataFrame, value: str, by: Sequence[str], bins: int = 10) -> DataFrame:
    """A15 per group: equal-width bins between the group's min and max (max in the last bin), share of
    the group's values per bin, empty bins kept; groups without values have none. One aggregate for the bounds, one for the counts."""
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    bounds = rows.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("all"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)))
    counts = attach(rows, bounds, by, ["lo", "hi"]).groupBy(*by, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    g = attach(grid, counts, [*by, "bin"], ["n"], "left")
    return g.select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("all")).alias("share"))


def cohort_shares(df: DataFrame, columns: Sequence[str], cohort: str = "cohort") -> DataFrame:
    """A1 at two grains in one scan: (column, cohort, value, n, share) for each cohort and for all rows (cohort
    ``all``, which rows without a cohort join too); NULL values count nowhere."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    long = df.select(F.col(cohort).alias("cohort"), F.inline(F.array(*pairs))).where("value IS NOT NULL")
    sets = long.groupingSets([["column", "cohort", "value"], ["column", "value"]], "column", "cohort", "value")
    counts = sets.agg(F.grouping("cohort").alias("_all"), F.count(F.lit(1)).alias("n")).where("_all = 1 OR cohort IS NOT NULL")
    named = counts.withColumn("cohort", F.when(F.col("_all") == 1, "all").otherwise(F.col("cohort"))).drop("_all")
    return named.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("column", "cohort")))
