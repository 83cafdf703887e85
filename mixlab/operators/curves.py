"""Result curves, baselines, log-linear fits and equivalences.

Run-result tables are small (one row per training run), but nothing here
assumes it: every step is a grouped aggregate or an equi join on the group
keys; fits are ``regr_slope`` / ``regr_intercept`` aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Baseline fractions in order of preference, trend grid shape.
BASELINE_FRACS = [0.0, 0.95]
GRID_POINTS = 100
GRID_PAD_LO = 200
GRID_PAD_HI = 1000


def curve(df: DataFrame, by: Sequence[str] = ("dataset_name", "frac"), metric: str = "metric") -> DataFrame:
    """A10: mean, sample std, count and a normal 95 % band (mean +- 1.96 se)."""
    g = df.na.drop().groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"),
                                      F.count(F.lit(1)).alias("n"))
    se = F.col("std") / F.sqrt(F.col("n"))
    return g.withColumn("ci_lo", F.col("mean") - 1.96 * se).withColumn("ci_hi", F.col("mean") + 1.96 * se)


def baseline(df: DataFrame, keys: Sequence[str], frac: str = "frac", metric: str = "metric") -> DataFrame:
    """Per key the metric at frac 0, else at 0.95 (first by preference)."""
    prio = F.array_position(F.array(*[F.lit(f) for f in BASELINE_FRACS]), F.col(frac))
    cand = df.na.drop().filter(prio > 0)
    return cand.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(frac).alias("base_frac"), F.col(metric).alias("base_metric")), prio).alias("b")
    ).select(*keys, "b.base_frac", "b.base_metric")


def pct_change(df: DataFrame, keys: Sequence[str], frac: str = "frac", metric: str = "metric") -> DataFrame:
    """(metric - baseline) / baseline; keys without a baseline -> NULL."""
    b = baseline(df, keys, frac, metric)
    j = df.na.drop().join(b, list(keys), "left")
    return j.withColumn("pct_change", F.try_divide(F.col(metric) - F.col("base_metric"), F.col("base_metric")))


def melt(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(metrics), "metric", "value")


def log_fit(df: DataFrame, by: Sequence[str] = ("dataset_name",), metrics: Sequence[str] = ("acc",),
            synthetic: str = "synthetic", real: str = "real") -> DataFrame:
    """y = a + b ln(n) per group x metric, separately for pure-generated
    points (real = 0, kind 'synthetic') and mixed points ('mixed')."""
    m = melt(df.na.drop(), [*by, synthetic, real], metrics)
    m = m.withColumn("kind", F.when(F.col(real) == 0, F.lit("synthetic")).otherwise(F.lit("mixed")))
    x = F.log(F.col(synthetic) + F.col(real))
    return m.groupBy(*by, "metric", "kind").agg(
        F.regr_slope(F.col("value"), x).alias("slope"), F.regr_intercept(F.col("value"), x).alias("intercept"),
        F.count(F.lit(1)).alias("n_points"))


def equivalence_points(df: DataFrame, by: Sequence[str] = ("dataset_name",), metrics: Sequence[str] = ("acc",),
                       synthetic: str = "synthetic", real: str = "real") -> DataFrame:
    """A13 per point: generated rows worth the added human rows,
    exp((y - a) / b) - n_synthetic, with (a, b) of the pure-generated fit; J5
    attaches the pure-generated value of the same size (the mean, if there are several)."""
    fits = log_fit(df, by, metrics, synthetic, real).filter(F.col("kind") == "synthetic").select(
        *by, "metric", "slope", "intercept")
    m = melt(df.na.drop(), [*by, synthetic, real], metrics)
    mixed = m.filter(F.col(real) != 0)
    pure = m.filter(F.col(real) == 0).groupBy(*by, "metric", synthetic).agg(
        F.avg("value").alias("base_value"))
    j = mixed.join(fits, [*by, "metric"]).join(pure, [*by, "metric", synthetic], "left")
    need = F.exp(F.try_divide(F.col("value") - F.col("intercept"), F.col("slope"))) - F.col(synthetic)
    return j.withColumn("n_needed", need)


def equivalence(df: DataFrame, by: Sequence[str] = ("dataset_name",), metrics: Sequence[str] = ("acc",),
                synthetic: str = "synthetic", real: str = "real") -> DataFrame:
    """A13 summary per group x metric: mean, median (interpolated), and the
    25 / 75 % points picked by index ``sorted[int(n * q)]`` as the reference does."""
    p = equivalence_points(df, by, metrics, synthetic, real)
    g = p.groupBy(*by, "metric").agg(F.sort_array(F.collect_list("n_needed")).alias("_v"),
                                     F.avg("n_needed").alias("mean"), F.median("n_needed").alias("median"),
                                     F.count(F.lit(1)).alias("n_points"))
    n = F.size("_v")
    return g.select(*by, "metric", "n_points", "mean", "median",
                    F.get("_v", F.floor(n * 0.25).cast("int")).alias("q25"),
                    F.get("_v", F.floor(n * 0.75).cast("int")).alias("q75"))


def trend_grid(df: DataFrame, by: Sequence[str] = ("dataset_name",), metrics: Sequence[str] = ("acc",),
               synthetic: str = "synthetic", real: str = "real") -> DataFrame:
    """100 evenly spaced x in [min(synthetic) - 200, max(synthetic) + 1000]
    evaluated on both fits; x <= 0 -> NULL."""
    fits = log_fit(df, by, metrics, synthetic, real)
    wide = fits.groupBy(*by, "metric").agg(
        *[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}_{k}")
          for k in ("synthetic", "mixed") for c in ("slope", "intercept")])
    rng = df.na.drop().groupBy(*by).agg((F.min(synthetic) - GRID_PAD_LO).alias("_lo"),
                                        (F.max(synthetic) + GRID_PAD_HI).alias("_hi"))
    g = wide.join(rng, list(by)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1))))
    step = (F.col("_hi") - F.col("_lo")).cast("double") / (GRID_POINTS - 1)
    x = F.when(F.col("i") == GRID_POINTS - 1, F.col("_hi").cast("double")).otherwise(F.col("_lo") + F.col("i") * step)
    lx = F.when(x > 0, F.log(x))
    return g.select(*by, "metric", "i", x.alias("x"),
                    (F.col("intercept_synthetic") + F.col("slope_synthetic") * lx).alias("y_synthetic"),
                    (F.col("intercept_mixed") + F.col("slope_mixed") * lx).alias("y_mixed"))
