"""Registered sampling / splitting / id queries (W*, P8, P9, J6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixlab.functions.keys import dense_id
from mixlab.operators import sampling as sm
from mixlab.plans.registry import register
from mixlab.sources import fixtures as fx
from mixlab.sources.tables import Tables

MD5 = "md5(concat(CAST({id} AS VARCHAR), '-', '42'{salt}))"


def rk(part: str = "", id_col: str = "id", salt: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    s = "".join(f", '-', CAST({x} AS VARCHAR)" for x in salt.split(",") if x) if salt else ""
    return f"row_number() OVER ({p}ORDER BY {MD5.format(id=id_col, salt=s)}, {id_col})"


def cnt(part: str = "") -> str:
    return f"count(*) OVER (PARTITION BY {part})" if part else "count(*) OVER ()"


@register("sample_n", sql=f"""
SELECT doc_id, source FROM documents ORDER BY {MD5.format(id='doc_id', salt='')}, doc_id LIMIT 50""")
def q_sample_n(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "source")
    return sm.sample_n(d, 50, id_col="doc_id")


@register("sample_frac", sql=f"""
SELECT id, dataset_name FROM (SELECT id, dataset_name, {rk('dataset_name')} AS r, {cnt('dataset_name')} AS n FROM fx_fv)
WHERE r <= round_even(n * 0.3, 0)""", fx=["fx_fv"])
def q_sample_frac(spark, sf):
    f = fx.fx_fv(Tables(spark, sf)).select("id", "dataset_name")
    return sm.sample_frac(f, 0.3, by=["dataset_name"])


@register("shuffle_split", sql=f"""
SELECT id, dataset_name, CASE WHEN r <= floor(n * (1.0 - 0.2)) THEN 'train' ELSE 'valid' END AS split
FROM (SELECT id, dataset_name, {rk('dataset_name')} AS r, {cnt('dataset_name')} AS n FROM fx_fv)""", fx=["fx_fv"])
def q_shuffle_split(spark, sf):
    f = fx.fx_fv(Tables(spark, sf)).select("id", "dataset_name")
    return sm.shuffle_split(f, 0.2, by=["dataset_name"])


@register("sample_per_group", sql=f"""
SELECT doc_id, source, sample_rank FROM (SELECT doc_id, source, {rk('source', 'doc_id')} AS sample_rank FROM documents)
WHERE sample_rank <= 5""")
def q_sample_per_group(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "source")
    return sm.sample_per_group(d, "source", 5, id_col="doc_id")


@register("nested_samples", sql=f"""
SELECT id, size FROM (SELECT id, {rk()} AS r FROM fx_fv), (SELECT unnest([300, 200, 100]) AS size) s
WHERE r <= size""", fx=["fx_fv"])
def q_nested_samples(spark, sf):
    f = fx.fx_fv(Tables(spark, sf)).select("id")
    return sm.nested_samples(f, [300, 200, 100])


@register("complement_head", sql=f"""
SELECT id FROM (SELECT id, {rk()} AS r FROM fx_fv) WHERE r > 200 AND r <= 250""", fx=["fx_fv"])
def q_complement_head(spark, sf):
    f = fx.fx_fv(Tables(spark, sf)).select("id")
    return sm.complement_head(f, 200, 50)


@register("complement", sql=f"""
WITH s AS (SELECT id FROM (SELECT id, {rk('dataset_name')} AS r, {cnt('dataset_name')} AS n FROM fx_fv)
           WHERE r <= round_even(n * 0.3, 0))
SELECT id, dataset_name FROM fx_fv WHERE id NOT IN (SELECT id FROM s)""", fx=["fx_fv"])
def q_complement(spark, sf):
    f = fx.fx_fv(Tables(spark, sf)).select("id", "dataset_name")
    return sm.complement(f, sm.sample_frac(f, 0.3, by=["dataset_name"]))


@register("top_fraction", sql="""
WITH r AS (SELECT id, output, row_number() OVER (ORDER BY output DESC NULLS LAST, id) AS r, count(*) OVER () AS n FROM fx_scores)
SELECT 'top' AS part, id, output FROM r WHERE r <= floor(n * 0.1)
UNION ALL SELECT 'bottom', id, output FROM r WHERE r > floor(n * (1.0 - 0.1))""", fx=["fx_scores"])
def q_top_fraction(spark, sf):
    """The leading and the trailing tenth by score."""
    s = fx.fx_scores(Tables(spark, sf)).select("id", "output")
    top, bottom = sm.top_fraction(s, "output", 0.1), sm.top_fraction(s, "output", 0.1, top=False)
    cols = ["part", "id", "output"]
    return top.withColumn("part", F.lit("top")).select(*cols).unionByName(bottom.withColumn("part", F.lit("bottom")).select(*cols))


@register("repeat_draws", sql=f"""
WITH d AS (SELECT id, run, size FROM fx_fv, (SELECT unnest([0, 1, 2]) AS run) r, (SELECT unnest([100, 200]) AS size) s)
SELECT run, size, id FROM (SELECT run, size, id, {rk('run, size', salt='run,size')} AS r FROM d) WHERE r <= size""",
          fx=["fx_fv"])
def q_repeat_draws(spark, sf):
    f = fx.fx_fv(Tables(spark, sf)).select("id")
    return sm.repeat_draws(f, [100, 200], 3).select("run", "size", "id")


@register("cap_per_split", sql=f"""
WITH s AS (SELECT id, CASE WHEN r <= floor(n * (1.0 - 0.2)) THEN 'train' ELSE 'valid' END AS split
           FROM (SELECT id, {rk('dataset_name')} AS r, {cnt('dataset_name')} AS n FROM fx_fv))
SELECT id, split FROM (SELECT id, split, {rk('split')} AS r FROM s)
WHERE (split = 'train' AND r <= 100) OR (split = 'valid' AND r <= 20)""", fx=["fx_fv"])
def q_cap_per_split(spark, sf):
    f = fx.fx_fv(Tables(spark, sf)).select("id", "dataset_name")
    s = sm.shuffle_split(f, 0.2, by=["dataset_name"]).select("id", "split")
    return sm.cap_per_split(s, {"train": 100, "valid": 20})


@register("cap_with_input", sql=f"""
WITH q AS (SELECT id, dataset_name, nullif(syn_question, syn_answer) AS input FROM fx_qa),
s AS (SELECT id, input, CASE WHEN r <= floor(n * (1.0 - 0.2)) THEN 'train' ELSE 'valid' END AS split
      FROM (SELECT id, input, {rk('dataset_name')} AS r, {cnt('dataset_name')} AS n FROM q))
SELECT id, split FROM (SELECT id, split, {rk('split')} AS r FROM s WHERE input <> '')
WHERE (split = 'train' AND r <= 50) OR (split = 'valid' AND r <= 10)""", fx=["fx_qa"])
def q_cap_with_input(spark, sf):
    """Rows without an input text are skipped before the caps count."""
    q = fx.fx_qa(Tables(spark, sf)).select("id", "dataset_name", F.nullif("syn_question", "syn_answer").alias("input"))
    s = sm.shuffle_split(q, 0.2, by=["dataset_name"]).select("id", "split", "input")
    return sm.cap_per_split(s, {"train": 50, "valid": 10}, input_col="input").select("id", "split")


@register("slices", sql=f"""
WITH r AS (SELECT id, dataset_name, {rk('dataset_name')} AS r, floor({cnt('dataset_name')} * 0.2) AS per FROM fx_fv),
b AS (SELECT id, dataset_name, r, per,
             CAST(CASE WHEN per = 0 THEN 4 ELSE least(floor((r - 1) / per), 4) END AS INTEGER) AS batch FROM r)
SELECT id, dataset_name, batch, CAST(CAST(r - 1 - batch * per AS BIGINT) AS VARCHAR) AS custom_id FROM b""",
          fx=["fx_fv"])
def q_slices(spark, sf):
    f = fx.fx_fv(Tables(spark, sf)).select("id", "dataset_name")
    return sm.slices(f, by=["dataset_name"])


@register("dense_id", sql="""
SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS dense_id FROM documents""")
def q_dense_id(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id")
    return dense_id(d, ["doc_id"])


@register("first_seen_id", sql="""
WITH f AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text),
r AS (SELECT text, row_number() OVER (ORDER BY first, text) - 1 AS context_id FROM f)
SELECT d.doc_id, r.context_id FROM documents d JOIN r USING (text)""")
def q_first_seen_id(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "text")
    return sm.first_seen_id(d, "text", "doc_id").select("doc_id", "context_id")
