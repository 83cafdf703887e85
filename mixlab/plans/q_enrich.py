"""Registered enrichment and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixlab.operators import enrich as en
from mixlab.operators.mixture import mixture
from mixlab.plans.oracle_fixtures import words_sql
from mixlab.plans.q_clean import _qw_sql
from mixlab.plans.registry import register, rounded
from mixlab.session import cut_lineage
from mixlab.plans.sql_text import best_sentence_sql, bleu_pairs_sql
from mixlab.sources import fixtures as fx
from mixlab.sources.tables import Tables

NORM = "regexp_replace(lower({x}), '^\\s+|\\s+$', '', 'g')"
PNORM = "regexp_replace(lower(split_part({x}, '|', 1)), '^\\s+|\\s+$', '', 'g')"


def n(x):
    return NORM.format(x=x)


FV_VARIANTS = ["claim", "syn_claim"]
FV_SRC = " UNION ALL ".join(
    f"SELECT id, {n('context')} AS ctx, {i} AS v, '{v}' AS variant, {n(v)} AS pred FROM fx_fv"
    for i, v in enumerate(FV_VARIANTS, 1))
FV_WIDE = ", ".join(
    f"max(CASE WHEN variant = '{v}' THEN {f} END) AS {v}{s}"
    for v in FV_VARIANTS for f, s in [("bleu", "_best_bleu_w_context"), ("location", "_location"),
                                      ("location_ratio", "_location_ratio")])
ENRICH_FV_CTE = best_sentence_sql(FV_SRC) + f""",
ew AS (SELECT id, {FV_WIDE} FROM best_out GROUP BY id),
efv AS (SELECT ew.*, 'fv' AS task, 1 - abs(f.label - s.output) AS score, f.claim, f.syn_claim
        FROM ew JOIN fx_fv f USING (id) JOIN fx_scores s USING (id))"""
FV_OUT = ["claim_best_bleu_w_context", "claim_location", "claim_location_ratio", "syn_claim_best_bleu_w_context",
          "syn_claim_location", "syn_claim_location_ratio"]


def _enrich_fv(spark, sf):
    t = Tables(spark, sf)
    d = fx.fx_fv(t).join(fx.fx_scores(t).select("id", F.col("output").alias("prediction")), "id")
    return en.enrich(d, "fv")


def _r(c):
    return f"round({c}, 6) AS {c}"


@register("enrich_fv", sql=f"""WITH {ENRICH_FV_CTE}
SELECT id, task, {", ".join(_r(c) if 'location' != c.split('_')[-1] else c for c in FV_OUT)}, round(score, 6) AS score FROM efv""",
          fx=["fx_fv", "fx_scores"])
def q_enrich_fv(spark, sf):
    return rounded(_enrich_fv(spark, sf).select("id", "task", *FV_OUT, "score"))


QA_VARIANTS = [("question", n("question")), ("syn_question", n("syn_question")), ("answer", n("answer")),
               ("syn_answer", n("syn_answer")), ("prediction", PNORM.format(x="prediction"))]
QA_SRC = " UNION ALL ".join(
    f"SELECT id, {n('context')} AS ctx, {i} AS v, '{v}' AS variant, {e} AS pred FROM fx_qa"
    for i, (v, e) in enumerate(QA_VARIANTS, 1))
QA_NAMES = {"question": ("question_best_bleu_w_context", None, None),
            "syn_question": ("syn_question_best_bleu_w_context", None, None),
            "answer": ("answer_location_bleu", "answer_location", "answer_location_ratio"),
            "syn_answer": ("syn_answer_location_bleu", "syn_answer_location", "syn_answer_location_ratio"),
            "prediction": ("pred_location_bleu", "pred_location", "pred_location_ratio")}
QA_WIDE = ", ".join(
    f"max(CASE WHEN variant = '{v}' THEN {f} END) AS {name}"
    for v, names in QA_NAMES.items() for f, name in zip(["bleu", "location", "location_ratio"], names) if name)
QA_PAIRS = f"SELECT id AS pair_id, {n('answer')} AS ref, {PNORM.format(x='prediction')} AS pred FROM fx_qa"
ENRICH_QA_CTE = best_sentence_sql(QA_SRC) + f""",
ew AS (SELECT id, {QA_WIDE} FROM best_out GROUP BY id),
{bleu_pairs_sql(QA_PAIRS)},
eqa AS (SELECT ew.*, 'qa' AS task, {_qw_sql(n('question'))} AS question_word, {_qw_sql(n('syn_question'))} AS syn_question_word,
               b.bleu AS score, q.question, q.answer, q.prediction
        FROM ew JOIN fx_qa q USING (id) JOIN bleu_out b ON b.pair_id = ew.id)"""
QA_OUT = [name for names in QA_NAMES.values() for name in names if name]


def _enrich_qa(spark, sf):
    return en.enrich(fx.fx_qa(Tables(spark, sf)), "qa")


@register("enrich_qa", sql=f"""WITH {ENRICH_QA_CTE}
SELECT id, task, {", ".join(c if c.endswith('location') else _r(c) for c in QA_OUT)}, question_word, syn_question_word,
       round(score, 6) AS score FROM eqa""", fx=["fx_qa"], headline=True)
def q_enrich_qa(spark, sf):
    return rounded(_enrich_qa(spark, sf).select("id", "task", *QA_OUT, "question_word", "syn_question_word", "score"))


def _predictions(df, task, predictions):
    """A prediction file as the model runner writes it: packed texts and a prediction, no separate columns."""
    packed = mixture(df.withColumn("dataset_name", F.lit("all")), task, 0.0).drop("dataset_name")
    return packed.join(predictions, "id").withColumn("task", F.lit(task))


PRED_QA_OUT = [c for c in QA_OUT if not c.startswith("syn_")]


@register("enrich_predfile_qa", sql=f"""WITH {ENRICH_QA_CTE}
SELECT id, task, {", ".join(c if c.endswith('location') else _r(c) for c in PRED_QA_OUT)}, question_word, round(score, 6) AS score FROM eqa""",
          fx=["fx_qa"])
def q_enrich_predfile_qa(spark, sf):
    """E3 from text, input, label and prediction alone."""
    qa = fx.fx_qa(Tables(spark, sf))
    out = en.enrich_predictions(_predictions(qa, "qa", qa.select("id", "prediction")))
    return rounded(out.select("id", "task", *PRED_QA_OUT, "question_word", "score"))


PRED_FV_OUT = [c for c in FV_OUT if not c.startswith("syn_")]


@register("enrich_predfile_fv", sql=f"""WITH {ENRICH_FV_CTE}
SELECT id, task, {", ".join(_r(c) if not c.endswith('_location') else c for c in PRED_FV_OUT)}, round(score, 6) AS score FROM efv""",
          fx=["fx_fv", "fx_scores"])
def q_enrich_predfile_fv(spark, sf):
    t = Tables(spark, sf)
    pred = fx.fx_scores(t).select("id", F.col("output").alias("prediction"))
    out = en.enrich_predictions(_predictions(fx.fx_fv(t), "fv", pred))
    return rounded(out.select("id", "task", *PRED_FV_OUT, "score"))


PROFILE_COLS = ["context_words", "claim_words", "syn_claim_words", "label", "syn_label"]


@register("corpus_profile", sql=f"""
WITH d AS (SELECT dataset_name, label, syn_label, {", ".join(f"CAST(coalesce(len({words_sql(c)}), 0) AS BIGINT) AS {c}_words" for c in ["context", "claim", "syn_claim"])} FROM fx_fv),
g AS (SELECT dataset_name, count(*) AS n, {", ".join(f"round(avg({c}), 6) AS {c}_mean, CAST(sum({c}) AS BIGINT) AS {c}_sum" for c in PROFILE_COLS)},
             round(avg(CAST(label = syn_label AS DOUBLE)), 6) AS label_agreement FROM d GROUP BY dataset_name)
SELECT *, round(n / (SELECT sum(n) FROM g), 6) AS share FROM g""", fx=["fx_fv"])
def q_corpus_profile(spark, sf):
    return rounded(en.corpus_profile(fx.fx_fv(Tables(spark, sf))))


def _describe_sql(v, src, by):
    return f"""SELECT {by}, count({v}) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std,
  round(min({v}), 6) AS min, round(quantile_cont({v}, 0.25), 6) AS p25, round(quantile_cont({v}, 0.5), 6) AS p50,
  round(quantile_cont({v}, 0.75), 6) AS p75, round(max({v}), 6) AS max FROM {src} GROUP BY {by}"""


GEN_FEATS = ["words", "best_bleu_w_context", "location_ratio"]


def _feat_sql(origin, prefix):
    exprs = {"words": f"CAST(coalesce(len({words_sql(n(prefix + 'claim'))}), 0) AS DOUBLE)",
             "best_bleu_w_context": f"CAST({prefix}claim_best_bleu_w_context AS DOUBLE)",
             "location_ratio": f"CAST({prefix}claim_location_ratio AS DOUBLE)"}
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, '{origin}' AS origin, {exprs[f]} AS value FROM efv" for f in GEN_FEATS)


@register("generated_report", sql=f"""WITH {ENRICH_FV_CTE},
long AS ({_feat_sql('human', '')} UNION ALL {_feat_sql('generated', 'syn_')})
{_describe_sql('value', 'long', 'feature, origin')}""", fx=["fx_fv", "fx_scores"])
def q_generated_report(spark, sf):
    # the enriched table feeds several reports: written once to the shared checkpoint folder
    return rounded(en.generated_report(cut_lineage(_enrich_fv(spark, sf)), "claim", GEN_FEATS))


PRED_FEATS = ["answer_location_ratio", "pred_location_ratio", "question_best_bleu_w_context",
              "answer_location_bleu", "pred_location_bleu"]


@register("prediction_report", sql=f"""WITH {ENRICH_QA_CTE},
r AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS r, count(*) OVER () AS n FROM eqa),
c AS (SELECT *, CASE WHEN r <= floor(n * 0.25) THEN 'top' WHEN r > floor(n * (1.0 - 0.25)) THEN 'bottom' END AS cohort FROM r),
long AS ({" UNION ALL ".join(f"SELECT cohort, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM c WHERE cohort IS NOT NULL" for f in PRED_FEATS)})
{_describe_sql('value', 'long', 'cohort, feature')}""", fx=["fx_qa"])
def q_prediction_report(spark, sf):
    # ranks need bounds and counts of the score: read them from a written copy, not by recomputing
    return rounded(en.prediction_report(cut_lineage(_enrich_qa(spark, sf)), PRED_FEATS))
