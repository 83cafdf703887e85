"""Registered mixture queries (M1-M5) and the flagship mixture share."""

from __future__ import annotations

from mixlab.operators import mixture as mx
from mixlab.operators.stats import value_share
from mixlab.plans.registry import register, rounded
from mixlab.sources import fixtures as fx
from mixlab.sources.tables import Tables

RANK = "row_number() OVER (PARTITION BY {p} ORDER BY md5(concat(CAST(id AS VARCHAR), '-', '42')), id)"


@register(
    "mixture_share",
    sql="""
WITH r AS (
  SELECT dataset_name, """ + RANK.format(p="dataset_name") + """ AS rk,
         count(*) OVER (PARTITION BY dataset_name) AS n
  FROM fx_fv),
m AS (SELECT dataset_name, rk <= floor(n * 0.95) AS synthetic FROM r)
SELECT dataset_name, synthetic, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY dataset_name), 6) AS share
FROM m GROUP BY dataset_name, synthetic
""",
    fx=["fx_fv"],
    headline=True,
)
def q_mixture_share(spark, sf):
    """Flagship: fx_fv -> exact 95 % mixture per dataset -> share of generated rows."""
    m = mx.mixture(fx.fx_fv(Tables(spark, sf)), "fv", 0.95)
    return rounded(value_share(m, "synthetic", by=["dataset_name"]))


@register(
    "mixture",
    sql="""
WITH r AS (
  SELECT *, """ + RANK.format(p="dataset_name") + """ AS rk,
         count(*) OVER (PARTITION BY dataset_name) AS n
  FROM fx_qa),
m AS (
  SELECT dataset_name, id, meta, rk <= floor(n * 0.5) AS synthetic,
         context || ' | ' || CASE WHEN rk <= floor(n * 0.5) THEN syn_question ELSE question END AS body,
         CASE WHEN rk <= floor(n * 0.5) THEN syn_answer ELSE answer END AS label
  FROM r)
SELECT dataset_name, id, body || ' ANSWER: ' || label || ' |' AS text, label, synthetic, meta,
       body || ' ANSWER: ' AS input
FROM m
""",
    fx=["fx_qa"],
)
def q_mixture(spark, sf):
    return mx.mixture(fx.fx_qa(Tables(spark, sf)), "qa", 0.5)


@register(
    "mixture_sweep",
    sql="""
WITH r AS (
  SELECT *, """ + RANK.format(p="dataset_name") + """ AS rk,
         count(*) OVER (PARTITION BY dataset_name) AS n
  FROM fx_fv),
f AS (SELECT unnest([0.0, 0.5, 0.95, 0.975, 1.0]::DOUBLE[]) AS frac)
SELECT dataset_name, frac, id,
       context || ' | ' || CASE WHEN rk <= floor(n * frac) THEN syn_claim ELSE claim END AS text,
       CASE WHEN rk <= floor(n * frac) THEN syn_label ELSE label END AS label,
       rk <= floor(n * frac) AS synthetic, meta
FROM r, f
""",
    fx=["fx_fv"],
)
def q_mixture_sweep(spark, sf):
    return mx.mixture_sweep(fx.fx_fv(Tables(spark, sf)), "fv")


@register("size_sweep", sql="""
WITH d AS (SELECT f.*, run FROM fx_fv f, (SELECT unnest([0, 1, 2]) AS run) r),
dr AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY md5(concat(CAST(id AS VARCHAR), '-', '42', '-', CAST(run AS VARCHAR))), id) AS dr FROM d),
s AS (SELECT dr.*, size FROM dr, (SELECT unnest([100, 200]) AS size) z WHERE dr <= size),
m AS (SELECT *, row_number() OVER (PARTITION BY run, size ORDER BY md5(concat(CAST(id AS VARCHAR), '-', '42', '-', CAST(run AS VARCHAR), '-', CAST(size AS VARCHAR))), id) AS r,
             count(*) OVER (PARTITION BY run, size) AS n FROM s),
f AS (SELECT m.*, frac FROM m, (SELECT unnest([0.0, 0.5, 0.95, 0.975, 1.0]::DOUBLE[]) AS frac) q),
o AS (SELECT size, run, frac, id, context || ' | ' || CASE WHEN r <= floor(n * frac) THEN syn_claim ELSE claim END AS text,
             CASE WHEN r <= floor(n * frac) THEN syn_label ELSE label END AS label, r <= floor(n * frac) AS synthetic FROM f)
SELECT *, false AS small FROM o UNION ALL SELECT *, true FROM o WHERE frac < 1 AND NOT synthetic""", fx=["fx_fv"])
def q_size_sweep(spark, sf):
    s = mx.size_sweep(fx.fx_fv(Tables(spark, sf)), "fv", sizes=[100, 200], runs=3, by=())
    return s.select("size", "run", "frac", "id", "text", "label", "synthetic", "small")


@register("replacement_value", sql="""
WITH r AS (SELECT id, row_number() OVER (ORDER BY md5(concat(CAST(id AS VARCHAR), '-', '42')), id) AS r FROM fx_fv),
b AS (SELECT unnest([300, 200, 100]) AS base),
base_rows AS (SELECT b.base, r.id FROM b JOIN r ON r.r <= b.base),
real_rows AS (SELECT base, id FROM (
  SELECT b.base, f.id, row_number() OVER (PARTITION BY b.base ORDER BY md5(concat(CAST(f.id AS VARCHAR), '-', '42', '-', 'real', '-', CAST(b.base AS VARCHAR))), f.id) AS q
  FROM b, fx_fv f) WHERE q <= 20),
adds AS (SELECT unnest([0, 1, 2, 3]) AS i), o AS (
SELECT base AS base_size, 'train' AS variant, id, true AS synthetic FROM base_rows
UNION ALL SELECT base, 'real_train', id, true FROM base_rows
UNION ALL SELECT base, 'real_train', id, false FROM real_rows
UNION ALL SELECT b.base, 'synth_' || CAST(a.i AS VARCHAR) || '_train', br.id, true FROM b, adds a JOIN base_rows br ON true WHERE br.base = b.base
UNION ALL SELECT b.base, 'synth_' || CAST(a.i AS VARCHAR) || '_train', r.id, true
  FROM b, adds a JOIN r ON true WHERE r.r > b.base AND r.r <= b.base + 20 * (a.i + 1))
SELECT o.*, f.context || ' | ' || CASE WHEN synthetic THEN f.syn_claim ELSE f.claim END AS text,
       CASE WHEN synthetic THEN f.syn_label ELSE f.label END AS label
FROM o JOIN fx_fv f USING (id)""", fx=["fx_fv"])
def q_replacement_value(spark, sf):
    m = mx.replacement_value(fx.fx_fv(Tables(spark, sf)), "fv", base_sizes=[300, 200, 100], real_add=20, by=())
    return m.select("base_size", "variant", "id", "text", "label", "synthetic")


@register("manifest", sql="""
WITH d AS (SELECT DISTINCT dataset_name FROM fx_fv),
g AS (SELECT dataset_name, size, frac, run FROM d, (SELECT unnest([1000, 3000, 5000]) AS size) s,
        (SELECT unnest([0.0, 0.5, 0.95, 0.975, 1.0]::DOUBLE[]) AS frac) f, (SELECT unnest([0, 1, 2]) AS run) r)
SELECT 'gpt-3.5-turbo' AS model, dataset_name, size, frac, run,
       coalesce(MAP {'factify': 800, 'wanli': 150, 'scifact': 512, 'fever': 100, 'ropes': 400, 'qaconv': 512, 'narrativeqa': 800, 'coqa': 512, 'fairytaleqa': 400}[dataset_name], 512) AS max_seq_len,
       'exp2/gpt-3.5-turbo/cot_False/' || dataset_name || '/size_' || CAST(size AS VARCHAR) || '/frac_' || CAST(frac AS VARCHAR) || '/run_' || CAST(run AS VARCHAR) AS path
FROM g""", fx=["fx_fv"])
def q_manifest(spark, sf):
    d = fx.fx_fv(Tables(spark, sf)).select("dataset_name").distinct()
    return mx.manifest(d)
