"""Registered report queries (X1-X3): every table of the reports on corpora, generated rows and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixlab.operators import enrich as en
from mixlab.operators import reports as rp
from mixlab.operators.stats import cohort_shares, describe, grouped_histogram, quartile_cohorts
from mixlab.plans.oracle_fixtures import words_sql
from mixlab.plans.q_enrich import ENRICH_FV_CTE, ENRICH_QA_CTE, PNORM, _describe_sql, n
from mixlab.plans.registry import register, rounded
from mixlab.session import cut_lineage
from mixlab.sources import fixtures as fx
from mixlab.sources.tables import Tables

CTE = {"qa": ENRICH_QA_CTE + ", rep AS (SELECT e.* EXCLUDE (question, answer, prediction), q.question, q.answer, q.prediction, q.syn_question, q.syn_answer FROM eqa e JOIN fx_qa q USING (id))",
       "fv": ENRICH_FV_CTE + ", rep AS (SELECT e.*, f.label, s.output AS prediction FROM efv e JOIN fx_fv f USING (id) JOIN fx_scores s USING (id))"}
VIEWS = {"qa": ["fx_qa"], "fv": ["fx_fv", "fx_scores"]}


def _value_sql(name, prefix=""):
    if name.endswith("_length"):
        text = prefix + name.removesuffix("_length")
        return f"CAST(coalesce(len({words_sql((PNORM.format(x=text)) if text == 'prediction' else n(text))}), 0) AS DOUBLE)"
    return f"round(CAST({prefix}{name} AS DOUBLE), {rp.DIGITS})"


def _paired_sql(task):
    return "long AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, '{o}' AS origin, {_value_sql(f, p)} AS value FROM rep"
        for f in rp.PAIRED[task] for o, p in (("human", ""), ("generated", "syn_"))) + ")"


COHORTS_SQL = """co AS (SELECT *, CASE WHEN r <= floor(n * 0.25) THEN 'top' WHEN r > floor(n * (1.0 - 0.25)) THEN 'bottom' END AS cohort
  FROM (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS r, count(*) OVER () AS n FROM rep))"""


def _predicted_sql(task):
    return COHORTS_SQL + ", long AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, cohort, {_value_sql(f)} AS value FROM co WHERE cohort IS NOT NULL" for f in ["score", *rp.PREDICTED[task]]) + ")"


def _histogram_sql(by, bins=10):
    last = bins - 1
    return f"""b AS (SELECT {by}, min(value) AS lo, max(value) AS hi, count(value) AS total FROM long GROUP BY {by} HAVING count(value) > 0),
c AS (SELECT {by}, CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / ((hi - lo) / {bins})), {last}) END AS bin, count(*) AS n
      FROM long JOIN b USING ({by}) WHERE value IS NOT NULL GROUP BY ALL),
g AS (SELECT b.*, unnest(generate_series(0, {last})) AS bin FROM b)
SELECT {by}, CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * ((hi - lo) / {bins}), 6) AS lo, round(lo + (g.bin + 1) * ((hi - lo) / {bins}), 6) AS hi,
       coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / total, 6) AS share
FROM g LEFT JOIN c USING ({by}, bin)"""


def _enriched(spark, sf, task):
    t = Tables(spark, sf)
    if task == "qa":
        return en.enrich(fx.fx_qa(t), "qa")
    return en.enrich(fx.fx_fv(t).join(fx.fx_scores(t).select("id", F.col("output").alias("prediction")), "id"), "fv")


def _generated(spark, sf, task):
    return cut_lineage(rp.generated_values(_enriched(spark, sf, task), task))  # features only; each table reads them twice or more


def _prediction_values(spark, sf, task):
    return rp.prediction_values(cut_lineage(rp.prediction_features(_enriched(spark, sf, task), task)), task)


@register("generated_report_qa", sql=f"WITH {CTE['qa']}, {_paired_sql('qa')} {_describe_sql('value', 'long', 'feature, origin')}", fx=VIEWS["qa"])
def q_generated_report_qa(spark, sf):
    return rounded(describe(_generated(spark, sf, "qa"), "value", ["feature", "origin"]))


@register("generated_histograms_qa", sql=f"WITH {CTE['qa']}, {_paired_sql('qa')}, {_histogram_sql('feature, origin')}", fx=VIEWS["qa"])
def q_generated_histograms_qa(spark, sf):
    return rounded(grouped_histogram(_generated(spark, sf, "qa"), "value", ["feature", "origin"]))


@register("generated_histograms_fv", sql=f"WITH {CTE['fv']}, {_paired_sql('fv')}, {_histogram_sql('feature, origin')}", fx=VIEWS["fv"])
def q_generated_histograms_fv(spark, sf):
    return rounded(grouped_histogram(_generated(spark, sf, "fv"), "value", ["feature", "origin"]))


@register("prediction_report_all_qa", sql=f"WITH {CTE['qa']}, {_predicted_sql('qa')} {_describe_sql('value', 'long', 'cohort, feature')}", fx=VIEWS["qa"])
def q_prediction_report_all_qa(spark, sf):
    return rounded(describe(_prediction_values(spark, sf, "qa"), "value", ["cohort", "feature"]))


@register("prediction_report_fv", sql=f"WITH {CTE['fv']}, {_predicted_sql('fv')} {_describe_sql('value', 'long', 'cohort, feature')}", fx=VIEWS["fv"])
def q_prediction_report_fv(spark, sf):
    return rounded(describe(_prediction_values(spark, sf, "fv"), "value", ["cohort", "feature"]))


@register("prediction_histograms_qa", sql=f"WITH {CTE['qa']}, {_predicted_sql('qa')}, {_histogram_sql('feature, cohort')}", fx=VIEWS["qa"])
def q_prediction_histograms_qa(spark, sf):
    return rounded(grouped_histogram(_prediction_values(spark, sf, "qa"), "value", ["feature", "cohort"]))


DIFFERENCE_SQL = """SELECT feature, round(avg(value) FILTER (WHERE cohort = 'top') - avg(value) FILTER (WHERE cohort = 'bottom'), 6) AS mean_difference,
  round(median(value) FILTER (WHERE cohort = 'top') - median(value) FILTER (WHERE cohort = 'bottom'), 6) AS median_difference FROM long GROUP BY feature"""


@register("cohort_difference_qa", sql=f"WITH {CTE['qa']}, {_predicted_sql('qa')} {DIFFERENCE_SQL}", fx=VIEWS["qa"])
def q_cohort_difference_qa(spark, sf):
    return rounded(rp.cohort_difference(_prediction_values(spark, sf, "qa")))


def _shares_sql(columns):
    cells = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", cohort, CAST({c} AS VARCHAR) AS value FROM co" for c in columns)
    return f"""{COHORTS_SQL}, cells AS ({cells}),
cn AS (SELECT "column", cohort, value, count(*) AS n FROM cells WHERE value IS NOT NULL AND cohort IS NOT NULL GROUP BY ALL
       UNION ALL SELECT "column", 'all', value, count(*) FROM cells WHERE value IS NOT NULL GROUP BY ALL)
SELECT "column", cohort, value, n, round(n / sum(n) OVER (PARTITION BY "column", cohort), 6) AS share FROM cn"""


@register("question_word_shares", sql=f"WITH {CTE['qa']}, {_shares_sql(['question_word', 'syn_question_word'])}", fx=VIEWS["qa"])
def q_question_word_shares(spark, sf):
    """Question words of human and generated questions, of all rows and of both score cohorts."""
    few = cut_lineage(_enriched(spark, sf, "qa").select("id", "score", "question_word", "syn_question_word"))
    return rounded(cohort_shares(quartile_cohorts(few, "score"), ["question_word", "syn_question_word"]))


@register("label_shares", sql=f"WITH {CTE['fv']}, {_shares_sql(['label'])}", fx=VIEWS["fv"])
def q_label_shares(spark, sf):
    """Base rate of the labels, of all rows and of both score cohorts."""
    few = cut_lineage(_enriched(spark, sf, "fv").select("id", "score", "label"))
    return rounded(cohort_shares(quartile_cohorts(few, "score"), ["label"]))


@register("score_splits", sql=f"""WITH {CTE['fv']}, long AS (
  SELECT 'label' AS split, CAST(label AS BIGINT) AS "of", round(score, {rp.DIGITS}) AS value FROM rep
  UNION ALL SELECT 'pred', CASE WHEN prediction > 0.5 THEN 1 ELSE 0 END, round(score, {rp.DIGITS}) FROM rep)
{_describe_sql('value', 'long', 'split, "of"')}""", fx=VIEWS["fv"])
def q_score_splits(spark, sf):
    """The score by label and by hard prediction."""
    return rounded(describe(cut_lineage(rp.score_splits(_enriched(spark, sf, "fv"))), "value", ["split", "of"]))


def _ngrams_sql(columns, src):
    cells = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {words_sql(c)} AS w FROM {src}" for c in columns)
    return f"""WITH cells AS ({cells}),
g AS (SELECT "column", unnest(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' '))) AS ngram FROM cells),
c AS (SELECT "column", ngram, count(*) AS n FROM g GROUP BY ALL)
SELECT "column", ngram, n, round(n * 100.0 / total, 6) AS pct FROM (
  SELECT *, sum(n) OVER (PARTITION BY "column") AS total, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, ngram) AS r FROM c) WHERE r <= 10"""


@register("ngram_report_qa", sql=_ngrams_sql(rp.NGRAM_COLUMNS["qa"], "fx_qa"), fx=["fx_qa"])
def q_ngram_report_qa(spark, sf):
    return rounded(rp.ngram_report(fx.fx_qa(Tables(spark, sf)), rp.NGRAM_COLUMNS["qa"]))


LENGTHS_QA = ["context", "question", "answer", "syn_question", "syn_answer"]
LENGTHS_SQL = "long AS (" + " UNION ALL ".join(
    f"SELECT dataset_name, '{c}' AS feature, CAST(coalesce(len({words_sql(c)}), 0) AS DOUBLE) AS value FROM fx_qa" for c in LENGTHS_QA) + ")"


@register("corpus_totals_qa", sql=f"""WITH {LENGTHS_SQL}
SELECT coalesce(dataset_name, 'all') AS dataset_name, feature, count(*) AS n, round(avg(value), 6) AS mean, sum(value) AS sum
FROM long GROUP BY GROUPING SETS ((dataset_name, feature), (feature))""", fx=["fx_qa"])
def q_corpus_totals_qa(spark, sf):
    """Lengths per dataset and over all."""
    return rounded(rp.corpus_totals(rp.length_values(fx.fx_qa(Tables(spark, sf)), LENGTHS_QA)))


@register("corpus_lengths_qa", sql=f"WITH {LENGTHS_SQL} {_describe_sql('value', 'long', 'dataset_name, feature')}", fx=["fx_qa"])
def q_corpus_lengths_qa(spark, sf):
    """Describe of the lengths of each dataset."""
    return rounded(describe(rp.length_values(fx.fx_qa(Tables(spark, sf)), LENGTHS_QA), "value", ["dataset_name", "feature"]))
