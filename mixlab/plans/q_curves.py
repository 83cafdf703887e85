"""Registered run-result queries (A10-A14, J4, J5) and the cost rollup."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixlab.operators import cost as co
from mixlab.operators import curves as cv
from mixlab.plans.registry import register, rounded
from mixlab.sources import fixtures as fx
from mixlab.sources.tables import Tables

KEYS = ["dataset_name", "task", "run"]


@register("curve", sql="""
SELECT dataset_name, frac, round(avg(metric), 6) AS mean, round(stddev_samp(metric), 6) AS std, count(*) AS n,
       round(avg(metric) - 1.96 * stddev_samp(metric) / sqrt(count(*)), 6) AS ci_lo,
       round(avg(metric) + 1.96 * stddev_samp(metric) / sqrt(count(*)), 6) AS ci_hi
FROM fx_runs GROUP BY dataset_name, frac""", fx=["fx_runs"])
def q_curve(spark, sf):
    return rounded(cv.curve(fx.fx_runs(Tables(spark, sf))))


BASE_SQL = """SELECT dataset_name, task, run, arg_min(frac, prio) AS base_frac, arg_min(metric, prio) AS base_metric
FROM (SELECT *, CASE WHEN frac = 0.0 THEN 1 WHEN frac = 0.95 THEN 2 END AS prio FROM fx_runs) WHERE prio IS NOT NULL
GROUP BY dataset_name, task, run"""


@register("baseline_join", sql=f"""
SELECT dataset_name, task, run, base_frac, round(base_metric, 6) AS base_metric FROM ({BASE_SQL})""", fx=["fx_runs"])
def q_baseline_join(spark, sf):
    return rounded(cv.baseline(fx.fx_runs(Tables(spark, sf)), KEYS))


@register("pct_change", sql=f"""
SELECT r.dataset_name, r.task, r.run, r.frac, round(r.metric, 6) AS metric, b.base_frac,
       round(b.base_metric, 6) AS base_metric, round((r.metric - b.base_metric) / b.base_metric, 6) AS pct_change
FROM fx_runs r LEFT JOIN ({BASE_SQL}) b USING (dataset_name, task, run)""", fx=["fx_runs"])
def q_pct_change(spark, sf):
    return rounded(cv.pct_change(fx.fx_runs(Tables(spark, sf)), KEYS))


FIT_SQL = """SELECT dataset_name, 'acc' AS metric, CASE WHEN real = 0 THEN 'synthetic' ELSE 'mixed' END AS kind,
  regr_slope(acc, ln(synthetic + real)) AS slope, regr_intercept(acc, ln(synthetic + real)) AS intercept, count(*) AS n_points
FROM fx_equiv GROUP BY dataset_name, kind"""


@register("log_fit", sql=f"""
SELECT dataset_name, metric, kind, round(slope, 6) AS slope, round(intercept, 6) AS intercept, n_points FROM ({FIT_SQL})""",
          fx=["fx_equiv"])
def q_log_fit(spark, sf):
    return rounded(cv.log_fit(fx.fx_equiv(Tables(spark, sf))))


def _sci(c):
    return F.when(F.abs(c) < float("inf"), F.format_string("%.6e", c))


@register("equivalence", sql=f"""
WITH f AS (SELECT * FROM ({FIT_SQL}) WHERE kind = 'synthetic'),
p AS (SELECT e.dataset_name, exp((e.acc - f.intercept) / f.slope) - e.synthetic AS v
      FROM fx_equiv e JOIN f USING (dataset_name) WHERE e.real <> 0),
g AS (SELECT dataset_name, list_sort(list(v)) AS s, avg(v) AS mean, median(v) AS median, count(*) AS n_points FROM p GROUP BY dataset_name)
SELECT dataset_name, 'acc' AS metric, n_points,
  CASE WHEN isfinite(mean) THEN printf('%.6e', mean) END AS mean,
  CASE WHEN isfinite(median) THEN printf('%.6e', median) END AS median,
  CASE WHEN isfinite(s[CAST(floor(n_points * 0.25) AS BIGINT) + 1]) THEN printf('%.6e', s[CAST(floor(n_points * 0.25) AS BIGINT) + 1]) END AS q25,
  CASE WHEN isfinite(s[CAST(floor(n_points * 0.75) AS BIGINT) + 1]) THEN printf('%.6e', s[CAST(floor(n_points * 0.75) AS BIGINT) + 1]) END AS q75
FROM g""", fx=["fx_equiv"])
def q_equivalence(spark, sf):
    e = cv.equivalence(fx.fx_equiv(Tables(spark, sf)))
    return e.select("dataset_name", "metric", "n_points", *[_sci(F.col(c)).alias(c) for c in ("mean", "median", "q25", "q75")])


@register("base_value", sql="""
SELECT e.dataset_name, 'acc' AS metric, e.synthetic, e.real, round(e.acc, 6) AS value, round(p.acc, 6) AS base_value
FROM fx_equiv e LEFT JOIN fx_equiv p ON p.dataset_name = e.dataset_name AND p.synthetic = e.synthetic AND p.real = 0
WHERE e.real <> 0""", fx=["fx_equiv"])
def q_base_value(spark, sf):
    """Each mixed point beside the pure-generated point of its size."""
    points = cv.equivalence_points(fx.fx_equiv(Tables(spark, sf)))
    return rounded(points.select("dataset_name", "metric", "synthetic", "real", "value", "base_value"))


@register("trend_grid", sql=f"""
WITH f AS (SELECT dataset_name, max(CASE WHEN kind = 'synthetic' THEN slope END) AS bs, max(CASE WHEN kind = 'synthetic' THEN intercept END) AS a_s,
                  max(CASE WHEN kind = 'mixed' THEN slope END) AS bm, max(CASE WHEN kind = 'mixed' THEN intercept END) AS am
           FROM ({FIT_SQL}) GROUP BY dataset_name),
r AS (SELECT dataset_name, min(synthetic) - 200 AS lo, max(synthetic) + 1000 AS hi FROM fx_equiv GROUP BY dataset_name),
g AS (SELECT f.*, r.lo, r.hi, unnest(generate_series(0, 99)) AS i FROM f JOIN r USING (dataset_name)),
x AS (SELECT *, CASE WHEN i = 99 THEN CAST(hi AS DOUBLE) ELSE lo + i * (CAST(hi - lo AS DOUBLE) / 99) END AS x FROM g)
SELECT dataset_name, 'acc' AS metric, CAST(i AS INTEGER) AS i, round(x, 6) AS x,
       round(a_s + bs * CASE WHEN x > 0 THEN ln(x) END, 6) AS y_synthetic,
       round(am + bm * CASE WHEN x > 0 THEN ln(x) END, 6) AS y_mixed FROM x""", fx=["fx_equiv"])
def q_trend_grid(spark, sf):
    return rounded(cv.trend_grid(fx.fx_equiv(Tables(spark, sf))))


@register("cost_rollup", sql="""
WITH p AS (SELECT model, prompt_tokens, completion_tokens,
                  prompt_tokens * ((CASE model WHEN 'gpt-3.5-turbo-0125' THEN 0.5 WHEN 'gpt-4-turbo' THEN 10.0 END) / 1000000) AS prompt_cost,
                  completion_tokens * ((CASE model WHEN 'gpt-3.5-turbo-0125' THEN 1.5 WHEN 'gpt-4-turbo' THEN 30.0 END) / 1000000) AS completion_cost
           FROM fx_usage WHERE model IN ('gpt-3.5-turbo-0125', 'gpt-4-turbo'))
SELECT model, count(*) AS requests, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
       CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(prompt_cost), 9) AS prompt_cost,
       round(sum(completion_cost), 9) AS completion_cost, round(sum(prompt_cost) + sum(completion_cost), 9) AS total_cost
FROM p GROUP BY ROLLUP (model)""", fx=["fx_usage"])
def q_cost_rollup(spark, sf):
    return rounded(co.cost_rollup(fx.fx_usage(Tables(spark, sf))), 9)
