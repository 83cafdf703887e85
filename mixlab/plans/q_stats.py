"""Registered aggregate queries: descriptive stats and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixlab.functions import text as tx
from mixlab.functions.selection import quantiles
from mixlab.operators import cleaning as cl
from mixlab.operators import metrics as mt
from mixlab.operators import sampling as sm
from mixlab.operators import stats as st
from mixlab.plans.oracle_fixtures import words_sql
from mixlab.plans.q_clean import _qw_sql
from mixlab.plans.q_sampling import cnt, rk
from mixlab.plans.registry import register, rounded
from mixlab.plans.sql_text import bleu_pairs_sql, rouge_pairs_sql
from mixlab.sources import fixtures as fx
from mixlab.sources.tables import Tables

R = "round({x}, 6)"


def f1_sql(tp, fp, fn):
    p = f"(CASE WHEN {tp} + {fp} > 0 THEN CAST({tp} AS DOUBLE) / ({tp} + {fp}) ELSE 0.0 END)"
    r = f"(CASE WHEN {tp} + {fn} > 0 THEN CAST({tp} AS DOUBLE) / ({tp} + {fn}) ELSE 0.0 END)"
    return f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"


def _describe_sql(v, src, by=""):
    g = f"{by}, " if by else ""
    gb = f" GROUP BY {by}" if by else ""
    return f"""SELECT {g}count({v}) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std,
  round(min({v}), 6) AS min, round(quantile_cont({v}, 0.25), 6) AS p25, round(quantile_cont({v}, 0.5), 6) AS p50,
  round(quantile_cont({v}, 0.75), 6) AS p75, round(max({v}), 6) AS max FROM {src}{gb}"""


@register("describe", sql=_describe_sql("v", f"(SELECT CAST(len({words_sql('text')}) AS DOUBLE) AS v FROM documents)"))
def q_describe(spark, sf):
    d = Tables(spark, sf).documents.select(tx.word_count("text").alias("v"))
    return rounded(st.describe(d, "v"))


@register("describe_by_group", sql=_describe_sql("output", "fx_scores", "label"), fx=["fx_scores"])
def q_describe_by_group(spark, sf):
    return rounded(st.describe(fx.fx_scores(Tables(spark, sf)), "output", by=["label"]))


GMS = ["question_words", "answer_words", "context_words"]


@register("group_mean_sum", sql=f"""
SELECT dataset_name, {", ".join(f"round(avg({c}), 6) AS {c}_mean, CAST(sum({c}) AS BIGINT) AS {c}_sum" for c in GMS)}
FROM (SELECT dataset_name, {", ".join(f"CAST(coalesce(len({words_sql(c.replace('_words', ''))}), 0) AS BIGINT) AS {c}" for c in GMS)} FROM fx_qa)
GROUP BY dataset_name""", fx=["fx_qa"])
def q_group_mean_sum(spark, sf):
    q = fx.fx_qa(Tables(spark, sf))
    w = q.select("dataset_name", *[tx.word_count(c.replace("_words", "")).alias(c) for c in GMS])
    return rounded(st.group_mean_sum(w, ["dataset_name"], GMS))


@register("confusion_share", sql="""
WITH v AS (SELECT DISTINCT dataset_name, label AS v FROM fx_fv UNION SELECT DISTINCT dataset_name, syn_label FROM fx_fv),
g AS (SELECT a.dataset_name, a.v AS label, b.v AS syn_label FROM v a JOIN v b ON a.dataset_name = b.dataset_name),
c AS (SELECT dataset_name, label, syn_label, count(*) AS n FROM fx_fv GROUP BY ALL),
t AS (SELECT dataset_name, count(*) AS total FROM fx_fv GROUP BY ALL)
SELECT g.dataset_name, g.label, g.syn_label, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / t.total, 6) AS share
FROM g LEFT JOIN c USING (dataset_name, label, syn_label) JOIN t USING (dataset_name)""", fx=["fx_fv"])
def q_confusion_share(spark, sf):
    return rounded(st.confusion_share(fx.fx_fv(Tables(spark, sf)), "dataset_name", "label", "syn_label"))


@register("top_ngrams", sql=f"""
WITH w AS (SELECT {words_sql('claim')} AS w FROM fx_fv),
g AS (SELECT unnest(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' '))) AS ngram FROM w),
c AS (SELECT ngram, count(*) AS n FROM g GROUP BY ngram)
SELECT ngram, n, round(n * 100.0 / (SELECT sum(n) FROM c), 6) AS pct FROM c ORDER BY n DESC, ngram LIMIT 10""",
          fx=["fx_fv"])
def q_top_ngrams(spark, sf):
    return rounded(st.top_ngrams(fx.fx_fv(Tables(spark, sf)), "claim", 4, 10))


@register("length_stats", sql=f"""
WITH w AS (SELECT CAST(len({words_sql('text')}) AS BIGINT) AS l FROM documents),
s AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS i, count(*) OVER () AS n FROM w)
SELECT count(*) AS count, min(l) AS min, max(l) AS max, round(avg(l), 6) AS mean,
       max(CASE WHEN i = n // 2 THEN l END) AS median, max(CASE WHEN i = CAST(floor(n * 0.95) AS BIGINT) THEN l END) AS p95
FROM s""")
def q_length_stats(spark, sf):
    d = Tables(spark, sf).documents.select(tx.word_count("text").alias("l"))
    return rounded(st.length_stats(d, "l"))


@register("histogram", sql="""
WITH s AS (SELECT min(output) AS lo, max(output) AS hi, count(output) AS n FROM fx_scores),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((output - lo) / ((hi - lo) / 10)), 9) END AS INTEGER) AS bin
      FROM fx_scores, s WHERE output IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT g.bin, round(s.lo + g.bin * ((s.hi - s.lo) / 10), 6) AS lo, round(s.lo + (g.bin + 1) * ((s.hi - s.lo) / 10), 6) AS hi,
       coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / s.n, 6) AS share
FROM (SELECT CAST(unnest(generate_series(0, 9)) AS INTEGER) AS bin) g CROSS JOIN s LEFT JOIN c ON c.bin = g.bin""",
          fx=["fx_scores"])
def q_histogram(spark, sf):
    return rounded(st.histogram(fx.fx_scores(Tables(spark, sf)), "output", 10))


@register("quartile_contrast", sql="""
WITH r AS (SELECT id, output, row_number() OVER (ORDER BY output DESC NULLS LAST, id) AS r, count(*) OVER () AS n FROM fx_scores),
c AS (SELECT output, CASE WHEN r <= floor(n * 0.25) THEN 'top' WHEN r > floor(n * (1.0 - 0.25)) THEN 'bottom' END AS cohort FROM r)
SELECT cohort, count(*) AS n, round(avg(output), 6) AS mean, round(median(output), 6) AS median
FROM c WHERE cohort IS NOT NULL GROUP BY cohort""", fx=["fx_scores"])
def q_quartile_contrast(spark, sf):
    c = st.quartile_contrast(fx.fx_scores(Tables(spark, sf)), "output")
    q = quantiles(c, "output", [0.5], ["cohort"], [F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")])
    return rounded(q.select("cohort", "n", "mean", F.get("q", F.lit(0)).alias("median")))


@register("threshold_metrics", sql=f"""
WITH th AS (SELECT '0.5' AS threshold_name, CAST(0.5 AS DOUBLE) AS threshold
            UNION ALL SELECT 'mean', avg(output) FROM fx_scores UNION ALL SELECT 'median', median(output) FROM fx_scores),
c AS (SELECT threshold_name, threshold, count(*) AS n,
             count(*) FILTER (WHERE CAST(output > threshold AS INTEGER) = label) AS correct,
             count(*) FILTER (WHERE output > threshold AND label = 1) AS tp,
             count(*) FILTER (WHERE output > threshold AND label = 0) AS fp,
             count(*) FILTER (WHERE NOT output > threshold AND label = 0) AS tn,
             count(*) FILTER (WHERE NOT output > threshold AND label = 1) AS fn
      FROM fx_scores CROSS JOIN th GROUP BY threshold_name, threshold)
SELECT threshold_name, round(threshold, 6) AS threshold, round(correct / n, 6) AS accuracy,
       round(({f1_sql('tp', 'fp', 'fn')} + {f1_sql('tn', 'fn', 'fp')}) / 2, 6) AS macro_f1 FROM c""", fx=["fx_scores"])
def q_threshold_metrics(spark, sf):
    return rounded(mt.threshold_metrics(fx.fx_scores(Tables(spark, sf))))


QA_PAIRS = """SELECT id AS pair_id, regexp_replace(lower(answer), '^\\s+|\\s+$', '', 'g') AS ref,
  regexp_replace(lower(split_part(prediction, '|', 1)), '^\\s+|\\s+$', '', 'g') AS pred
  FROM fx_qa WHERE answer IS NOT NULL AND prediction IS NOT NULL"""


@register("qa_metrics", sql="WITH " + bleu_pairs_sql(QA_PAIRS) + ",\n" + rouge_pairs_sql(QA_PAIRS) + """
SELECT (SELECT count(*) FROM fx_qa) - count(*) AS dropped,
       round(avg(CAST(p.ref = p.pred AS DOUBLE)), 6) AS exact_match,
       round(avg(CAST(contains(p.pred, p.ref) AS DOUBLE)), 6) AS inclusion,
       round(avg(CAST(contains(p.ref, p.pred) AS DOUBLE)), 6) AS reverse_inclusion,
       round(avg(b.bleu), 6) AS bleu, round(avg(r.rouge1), 6) AS rouge1
FROM pairs p JOIN bleu_out b USING (pair_id) JOIN rouge_out r USING (pair_id)""", fx=["fx_qa"], headline=True)
def q_qa_metrics(spark, sf):
    return rounded(mt.qa_metrics(fx.fx_qa(Tables(spark, sf))))


@register("clf_metrics", sql=f"""
WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE CAST(output > 0.5 AS INTEGER) = label) AS correct,
                  count(*) FILTER (WHERE output > 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE output > 0.5 AND label = 0) AS fp,
                  count(*) FILTER (WHERE NOT output > 0.5 AND label = 1) AS fn, avg(pow(output - label, 2)) AS mse FROM fx_scores),
m AS (SELECT CAST(correct AS DOUBLE) / n AS accuracy,
             CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
             {f1_sql('tp', 'fp', 'fn')} AS f1, mse FROM c)
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(mse, 6) AS mse, round((accuracy + precision + recall + f1) / 4, 6) AS combined_score FROM m""",
          fx=["fx_scores"])
def q_clf_metrics(spark, sf):
    return rounded(mt.clf_metrics(fx.fx_scores(Tables(spark, sf)), "label", "output"))


@register("multilabel_f1", sql="""
WITH a AS (SELECT list_transform(generate_series(0, 4), lambda i: CAST(label = i AS INTEGER)) AS t,
                  list_transform(logits, lambda x: CAST(x > 0 AS INTEGER)) AS p FROM fx_logits5),
c AS (SELECT unnest(t) AS t, unnest(p) AS p FROM a),
s AS (SELECT count(*) FILTER (WHERE t = 1 AND p = 1) AS tp, count(*) FILTER (WHERE t = 0 AND p = 1) AS fp,
             count(*) FILTER (WHERE t = 1 AND p = 0) AS fn FROM c)
SELECT round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS micro_f1, tp, fp, fn FROM s""",
          fx=["fx_logits5"])
def q_multilabel_f1(spark, sf):
    lg = fx.fx_logits(Tables(spark, sf), k=5)
    a = lg.select(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (F.col("label") == i).cast("int")).alias("t"),
                  F.transform("logits", lambda x: (x > 0).cast("int")).alias("p"))
    return rounded(mt.multilabel_micro_f1(a, "t", "p"))


def _tok_arrays_spark(conv):
    w = tx.words("text")
    labels = F.transform(w, lambda x, i: F.when(i >= 30, F.lit(-100)).otherwise(F.octet_length(x)))
    preds = F.transform(w, lambda x, i: F.when(i % 4 == 0, F.lit(0)).otherwise(F.octet_length(F.get(w, i + 1))))
    return conv.select(labels.alias("labels"), preds.alias("preds"))


@register("token_accuracy", sql=f"""
WITH w AS (SELECT {words_sql('text')} AS w FROM conversations),
a AS (SELECT list_transform(generate_series(1, len(w)), lambda i: CASE WHEN i - 1 >= 30 THEN -100 ELSE strlen(w[i]) END) AS labels,
             list_transform(generate_series(1, len(w)), lambda i: CASE WHEN (i - 1) % 4 = 0 THEN 0 ELSE strlen(w[i + 1]) END) AS preds
      FROM w WHERE len(w) > 1),
c AS (SELECT preds[i - 1] AS p, labels[i] AS l FROM (SELECT labels, preds, unnest(generate_series(2, len(labels))) AS i FROM a))
SELECT round(avg(CAST(coalesce(p = l, false) AS DOUBLE)), 6) AS acc_all,
       round(avg(CASE WHEN l <> -100 THEN CAST(coalesce(p = l, false) AS DOUBLE) END), 6) AS acc_masked,
       count(*) AS n_tokens FROM c""")
def q_token_accuracy(spark, sf):
    a = _tok_arrays_spark(Tables(spark, sf).conversations)
    return rounded(mt.token_accuracy(a, "labels", "preds"))


@register("perplexity", sql="""
WITH e AS (SELECT label % 5 AS y, list_transform(logits, lambda v: exp(v - list_max(logits))) AS e FROM fx_logits5),
l AS (SELECT -ln(e[y + 1] / list_sum(e)) AS loss FROM e)
SELECT round(avg(loss), 6) AS eval_loss, round(exp(avg(loss)), 6) AS perplexity FROM l""", fx=["fx_logits5"])
def q_perplexity(spark, sf):
    lg = fx.fx_logits(Tables(spark, sf), k=5)
    loss = -F.log(F.get(cl.softmax("logits"), (F.col("label") % 5).cast("int")))
    return rounded(mt.perplexity(lg.select(loss.alias("loss")), "loss"))


@register("generated_length", sql=f"""
WITH t AS (SELECT list_transform({words_sql('answer')}, lambda w: CAST(strlen(w) % 4 AS INTEGER)) AS toks FROM fx_qa)
SELECT round(avg(len(toks) / 10.0), 6) AS eval_loss, round(exp(avg(len(toks) / 10.0)), 6) AS perplexity,
       round(avg(len(list_filter(toks, lambda x: x <> 0))), 6) AS gen_len FROM t""", fx=["fx_qa"])
def q_generated_length(spark, sf):
    """Perplexity and the mean length of generated ids without padding."""
    toks = F.transform(tx.words("answer"), lambda w: F.octet_length(w) % 4)
    q = fx.fx_qa(Tables(spark, sf)).select(toks.alias("toks"))
    return rounded(mt.perplexity(q.withColumn("loss", F.size("toks") / 10.0), "loss", "toks"))


@register("unseen_labels", sql=f"""
WITH l AS (SELECT id, dataset_name, concat(dataset_name, '/', CAST(id % 499 AS VARCHAR)) AS label FROM fx_fv),
s AS (SELECT label, CASE WHEN r <= floor(n * (1.0 - 0.2)) THEN 'train' ELSE 'valid' END AS split
      FROM (SELECT label, {rk('dataset_name')} AS r, {cnt('dataset_name')} AS n FROM l))
SELECT label FROM s GROUP BY label HAVING max(CAST(split = 'train' AS INTEGER)) = 0""", fx=["fx_fv"])
def q_unseen_labels(spark, sf):
    """Labels that the training split lacks."""
    f = fx.fx_fv(Tables(spark, sf)).select("id", "dataset_name", F.concat_ws("/", "dataset_name", (F.col("id") % 499).cast("string")).alias("label"))
    return mt.unseen_labels(mt.label_vocab(sm.shuffle_split(f, 0.2, by=["dataset_name"]), "label"))


@register("label_vocab", sql=f"""
WITH s AS (SELECT meta, CASE WHEN r <= floor(n * (1.0 - 0.2)) THEN 'train' ELSE 'valid' END AS split
           FROM (SELECT meta, {rk('dataset_name')} AS r, {cnt('dataset_name')} AS n FROM fx_fv))
SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id, in_train FROM (
  SELECT CAST(meta AS VARCHAR) AS label, max(CAST(split = 'train' AS INTEGER)) = 1 AS in_train
  FROM s WHERE meta IS NOT NULL GROUP BY meta)""", fx=["fx_fv"])
def q_label_vocab(spark, sf):
    f = fx.fx_fv(Tables(spark, sf)).select("id", "dataset_name", "meta")
    s = sm.shuffle_split(f, 0.2, by=["dataset_name"])
    return mt.label_vocab(s, "meta")


@register("value_share", sql=f"""
WITH w AS (SELECT dataset_name, {_qw_sql('question')} AS question_word FROM fx_qa),
c AS (SELECT dataset_name, question_word, count(*) AS n FROM w WHERE question_word IS NOT NULL GROUP BY ALL)
SELECT dataset_name, question_word, n, round(n / sum(n) OVER (PARTITION BY dataset_name), 6) AS share FROM c""",
          fx=["fx_qa"])
def q_value_share(spark, sf):
    """A1: question-word frequencies and shares per dataset (NULL excluded)."""
    q = fx.fx_qa(Tables(spark, sf)).select("dataset_name", tx.question_word("question").alias("question_word"))
    return rounded(st.value_share(q, "question_word", by=["dataset_name"]))
