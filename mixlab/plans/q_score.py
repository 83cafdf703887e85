"""Registered scoring queries: BLEU pairs, ROUGE-1, best evidence sentence,
inclusion, exact match, FV score and the QA metric summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixlab.functions import text as tx
from mixlab.operators import score as sc
from mixlab.plans.registry import register, rounded
from mixlab.plans.sql_text import best_sentence_sql, bleu_pairs_sql, rouge_pairs_sql
from mixlab.sources import fixtures as fx
from mixlab.sources.tables import Tables

NORM_PAIRS_SQL = """SELECT id AS pair_id,
  regexp_replace(lower(answer), '^\\s+|\\s+$', '', 'g') AS ref,
  regexp_replace(lower(split_part(prediction, '|', 1)), '^\\s+|\\s+$', '', 'g') AS pred
  FROM fx_qa"""


def _norm_pairs(spark, sf):
    q = fx.fx_qa(Tables(spark, sf))
    return q.select(F.col("id").alias("pair_id"), tx.normalize("answer").alias("ref"),
                    tx.normalize_prediction("prediction").alias("pred"))


@register("bleu_pairs", sql="WITH " + bleu_pairs_sql(NORM_PAIRS_SQL) + "\nSELECT pair_id, round(bleu, 6) AS bleu FROM bleu_out",
          fx=["fx_qa"], headline=True)
def q_bleu_pairs(spark, sf):
    """E1 on (answer, prediction) of every QA record."""
    return rounded(sc.bleu_pairs(_norm_pairs(spark, sf)))


@register("rouge1", sql="WITH " + rouge_pairs_sql(NORM_PAIRS_SQL) + "\nSELECT pair_id, round(rouge1, 6) AS rouge1 FROM rouge_out",
          fx=["fx_qa"])
def q_rouge1(spark, sf):
    return rounded(sc.rouge1_pairs(_norm_pairs(spark, sf)))


BEST_SRC = """SELECT id, context AS ctx, 1 AS v, 'claim' AS variant, claim AS pred FROM fx_fv
  UNION ALL SELECT id, context, 2, 'syn_claim', syn_claim FROM fx_fv"""


@register("best_sentence",
          sql="WITH " + best_sentence_sql(BEST_SRC) + """
SELECT id, variant, location, round(location_ratio, 6) AS location_ratio, round(bleu, 6) AS bleu FROM best_out""",
          fx=["fx_fv"], headline=True)
def q_best_sentence(spark, sf):
    """E2 over whole documents: best dot piece for the claim and the generated claim."""
    f = fx.fx_fv(Tables(spark, sf))
    return rounded(sc.best_sentence(f, {"claim": "claim", "syn_claim": "syn_claim"}))


@register("vector_match_f1", sql="""
WITH t AS (SELECT pair_id, side, pos, vector FROM fx_token_vecs),
s AS (SELECT c.pair_id, c.pos AS cp, r.pos AS rp, list_cosine_similarity(c.vector, r.vector) AS sim
      FROM t c JOIN t r ON r.pair_id = c.pair_id AND c.side = 0 AND r.side <> 0),
p AS (SELECT pair_id, avg(m) AS precision FROM (SELECT pair_id, cp, max(sim) AS m FROM s GROUP BY pair_id, cp) GROUP BY pair_id),
r AS (SELECT pair_id, avg(m) AS recall FROM (SELECT pair_id, rp, max(sim) AS m FROM s GROUP BY pair_id, rp) GROUP BY pair_id)
SELECT pair_id, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1
FROM p JOIN r USING (pair_id)""", fx=["fx_token_vecs"])
def q_vector_match_f1(spark, sf):
    return rounded(sc.vector_match_f1(fx.fx_token_vecs(Tables(spark, sf))))
