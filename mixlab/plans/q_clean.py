"""Registered projection / cleaning / scalar-function queries (S11, P*, F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixlab.functions import text as tx
from mixlab.operators import cleaning as cl
from mixlab.operators import mixture as mx
from mixlab.plans.oracle_fixtures import words_sql
from mixlab.plans.registry import register, rounded
from mixlab.sources import fixtures as fx
from mixlab.sources.tables import Tables

SPLITS = ["train", "validation", "test", "valid", "dev", "val", "trn", "tst", "eval", "holdout"]
SPLIT_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in cl.SPLIT_MAP.items()) + "}"
TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _lst(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@register("split_map", sql=f"""
SELECT doc_id, raw_split, {SPLIT_SQL}[raw_split] AS split
FROM (SELECT doc_id, {_lst(SPLITS)}[doc_id % 10 + 1] AS raw_split FROM documents)""")
def q_split_map(spark, sf):
    d = Tables(spark, sf).documents
    raw = F.element_at(F.array(*[F.lit(s) for s in SPLITS]), (F.col("doc_id") % 10 + 1).cast("int"))
    return d.select("doc_id", raw.alias("raw_split")).withColumn("split", cl.normalize_split("raw_split"))


@register("drop_blank", sql=f"""
SELECT id FROM fx_qa WHERE syn_question IS NOT NULL AND {TRIM.format(x='syn_question')} <> ''
  AND syn_answer IS NOT NULL AND {TRIM.format(x='syn_answer')} <> ''""", fx=["fx_qa"])
def q_drop_blank(spark, sf):
    return cl.drop_blank(fx.fx_qa(Tables(spark, sf)), ["syn_question", "syn_answer"]).select("id")


@register("drop_any_null", sql="""
SELECT id FROM fx_qa WHERE id IS NOT NULL AND context_id IS NOT NULL AND dataset_name IS NOT NULL AND task IS NOT NULL
  AND question IS NOT NULL AND context IS NOT NULL AND answer IS NOT NULL AND syn_question IS NOT NULL
  AND syn_answer IS NOT NULL AND prediction IS NOT NULL AND meta IS NOT NULL""", fx=["fx_qa"])
def q_drop_any_null(spark, sf):
    return cl.drop_any_null(fx.fx_qa(Tables(spark, sf))).select("id")


RAW_LABELS = ["SUPPORTS", "REFUTES", "NOT ENOUGH INFO", "entailment", "neutral", "contradiction",
              "SUPPORT", "NEI", "CONTRADICT", "unknown"]
ALL_LABELS = {**cl.FEVER_LABELS, **cl.WANLI_LABELS, **cl.SCIFACT_LABELS}


@register("label_map", sql=f"""
SELECT doc_id, raw_label, CAST(MAP {{{", ".join(f"'{k}': {v}" for k, v in ALL_LABELS.items())}}}[raw_label] AS INTEGER) AS label
FROM (SELECT doc_id, {_lst(RAW_LABELS)}[doc_id % 10 + 1] AS raw_label FROM documents)""")
def q_label_map(spark, sf):
    d = Tables(spark, sf).documents
    raw = F.element_at(F.array(*[F.lit(s) for s in RAW_LABELS]), (F.col("doc_id") % 10 + 1).cast("int"))
    return d.select("doc_id", raw.alias("raw_label")).withColumn("label", cl.map_value("raw_label", ALL_LABELS))


CATS = list(cl.FACTIFY_LABELS) + ["Other"]


@register("drop_sentinel", sql=f"""
SELECT doc_id, category, label FROM (
  SELECT doc_id, category, CAST(MAP {{{", ".join(f"'{k}': {v}" for k, v in cl.FACTIFY_LABELS.items())}}}[category] AS INTEGER) AS label
  FROM (SELECT doc_id, {_lst(CATS)}[doc_id % 6 + 1] AS category FROM documents))
WHERE label IS NULL OR label <> -1""")
def q_drop_sentinel(spark, sf):
    d = Tables(spark, sf).documents
    cat = F.element_at(F.array(*[F.lit(s) for s in CATS]), (F.col("doc_id") % 6 + 1).cast("int"))
    x = d.select("doc_id", cat.alias("category")).withColumn("label", cl.map_value("category", cl.FACTIFY_LABELS))
    return cl.drop_sentinel(x)


@register("first_answer", sql=f"""
SELECT id, answers[1] AS answer FROM (
  SELECT id, list_filter(str_split(context, '.'), lambda t: {TRIM.format(x='t')} <> '') AS answers FROM fx_qa)
WHERE len(answers) > 0""", fx=["fx_qa"])
def q_first_answer(spark, sf):
    q = fx.fx_qa(Tables(spark, sf))
    ans = F.filter(tx.dot_pieces("context"), lambda t: tx.strip_ws(t) != "")
    return q.select("id", ans.alias("answers")).filter(F.size("answers") > 0).select(
        "id", cl.first_nonempty(F.col("answers")).alias("answer"))


@register("unpack_fv", sql="""
SELECT id, array_to_string(p[1:len(p) - 1], '|') AS context, p[-1] AS claim
FROM (SELECT id, str_split(context || ' | ' || claim, '|') AS p FROM fx_fv)""", fx=["fx_fv"])
def q_unpack_fv(spark, sf):
    m = mx.mixture(fx.fx_fv(Tables(spark, sf)), "fv", 0.0)
    ctx, claim = cl.unpack_fv("text")
    return m.select("id", ctx.alias("context"), claim.alias("claim"))


@register("unpack_qa", sql="""
WITH m AS (SELECT id, context || ' | ' || question || ' ANSWER: ' AS input,
                  context || ' | ' || question || ' ANSWER: ' || answer || ' |' AS text FROM fx_qa)
SELECT id, array_to_string(str_split(input, '|')[1:len(str_split(input, '|')) - 1], '|') AS context,
       str_split(str_split(input, '|')[-1], 'ANSWER:')[1] AS question,
       str_split(str_split(regexp_replace(text, '^[|]+|[|]+$', '', 'g'), '|')[-1], 'ANSWER:')[-1] AS answer
FROM m""", fx=["fx_qa"])
def q_unpack_qa(spark, sf):
    m = mx.mixture(fx.fx_qa(Tables(spark, sf)), "qa", 0.0)
    c, q, a = cl.unpack_qa("text", "input")
    return m.select("id", c.alias("context"), q.alias("question"), a.alias("answer"))


@register("normalize_text", sql=f"""
SELECT id, {TRIM.format(x='lower(question)')} AS question, {TRIM.format(x='lower(answer)')} AS answer,
       {TRIM.format(x="lower(split_part(prediction, '|', 1))")} AS prediction FROM fx_qa""", fx=["fx_qa"])
def q_normalize_text(spark, sf):
    q = fx.fx_qa(Tables(spark, sf))
    return q.select("id", tx.normalize("question").alias("question"), tx.normalize("answer").alias("answer"),
                    tx.normalize_prediction("prediction").alias("prediction"))


@register("paired_null_report", sql="""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE prediction IS NULL OR syn_question IS NULL) AS n_dropped,
       count(*) FILTER (WHERE NOT (prediction IS NULL OR syn_question IS NULL)) AS n_kept FROM fx_qa""", fx=["fx_qa"])
def q_paired_null_report(spark, sf):
    _, report = cl.paired_null_report(fx.fx_qa(Tables(spark, sf)), "prediction", "syn_question")
    return report


@register("cast_label", sql="""
SELECT doc_id, TRY_CAST(raw AS INTEGER) AS label, raw IS NOT NULL AND TRY_CAST(raw AS INTEGER) IS NULL AS rejected
FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' || CAST(quality AS VARCHAR) ELSE CAST(quality AS VARCHAR) END AS raw
      FROM labels)""")
def q_cast_label(spark, sf):
    lab = Tables(spark, sf).labels
    raw = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), F.col("quality").cast("string"))).otherwise(
        F.col("quality").cast("string"))
    return cl.cast_label(lab.select("doc_id", raw.alias("raw")), "raw").select("doc_id", "label", "rejected")


@register("word_counts", sql=f"""
SELECT id, {", ".join(f"CAST(coalesce(len({words_sql(c)}), 0) AS BIGINT) AS {c}_words" for c in ["question", "answer", "context", "syn_question"])}
FROM fx_qa""", fx=["fx_qa"])
def q_word_counts(spark, sf):
    q = fx.fx_qa(Tables(spark, sf))
    return q.select("id", *[tx.word_count(c).alias(f"{c}_words") for c in ["question", "answer", "context", "syn_question"]])


@register("truncate_words", sql=f"""
SELECT doc_id, array_to_string({words_sql('text')}[1:3000], ' ') AS text FROM documents""")
def q_truncate_words(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", tx.truncate_words("text", 3000).alias("text"))


@register("strip_urls", sql="""
SELECT id, regexp_replace(text, 'https?://\\S+|www\\.\\S+', '', 'g') AS text FROM fx_urls""", fx=["fx_urls"])
def q_strip_urls(spark, sf):
    u = fx.fx_urls(Tables(spark, sf))
    return u.select("id", tx.strip_urls("text").alias("text"))


def _qw_sql(x):
    return "CASE " + " ".join(f"WHEN contains(lower({x}), '{w}') THEN '{w}'" for w in tx.QUESTION_WORDS) + " END"


@register("question_word", sql=f"""
SELECT id, {_qw_sql('question')} AS question_word, {_qw_sql('syn_question')} AS syn_question_word FROM fx_qa""",
          fx=["fx_qa"])
def q_question_word(spark, sf):
    q = fx.fx_qa(Tables(spark, sf))
    return q.select("id", tx.question_word("question").alias("question_word"),
                    tx.question_word("syn_question").alias("syn_question_word"))


NORM = f"""SELECT id, {TRIM.format(x='lower(answer)')} AS y_true,
  {TRIM.format(x="lower(split_part(prediction, '|', 1))")} AS y_pred FROM fx_qa WHERE answer IS NOT NULL AND prediction IS NOT NULL"""


@register("inclusion", sql=f"""
SELECT id, y_pred = y_true AS exact_match, contains(y_pred, y_true) AS inclusion,
       contains(y_true, y_pred) AS reverse_inclusion FROM ({NORM})""", fx=["fx_qa"])
def q_inclusion(spark, sf):
    q = fx.fx_qa(Tables(spark, sf)).filter(F.col("answer").isNotNull() & F.col("prediction").isNotNull())
    t, p = tx.normalize("answer"), tx.normalize_prediction("prediction")
    return q.select("id", (p == t).alias("exact_match"), tx.contains_text(p, t).alias("inclusion"),
                    tx.contains_text(t, p).alias("reverse_inclusion"))


@register("fv_score", sql="""
SELECT id, round(1 - abs(label - output), 6) AS score FROM fx_scores""", fx=["fx_scores"])
def q_fv_score(spark, sf):
    s = fx.fx_scores(Tables(spark, sf))
    return rounded(s.select("id", (F.lit(1) - F.abs(F.col("label") - F.col("output"))).alias("score")))


@register("softmax", sql="""
WITH e AS (SELECT id, list_transform(logits, lambda v: exp(v - list_max(logits))) AS e FROM fx_logits5)
SELECT id, round(e[2] / list_sum(e), 6) AS p1, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS pred FROM e""",
          fx=["fx_logits5"])
def q_softmax(spark, sf):
    lg = fx.fx_logits(Tables(spark, sf), k=5)
    sm = lg.select("id", cl.softmax("logits").alias("p"))
    return rounded(sm.select("id", F.get("p", 1).alias("p1"), cl.argmax("p").alias("pred")))


@register("multi_hot", sql="""
WITH l AS (SELECT d.doc_id, [d.lang, 'q' || CAST(coalesce(l.quality, d.doc_id % 2) AS VARCHAR)] AS labels
           FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
v AS (SELECT list_sort(list_distinct(flatten(list(labels)))) AS vocab FROM l)
SELECT doc_id, array_to_string(list_transform(vocab, lambda x: CASE WHEN list_contains(labels, x) THEN 1 ELSE 0 END), ',') AS multi_hot
FROM l, v""")
def q_multi_hot(spark, sf):
    t = Tables(spark, sf)
    quality = F.coalesce(F.col("quality").cast("long"), F.col("doc_id") % 2)  # as in the views: not every document is labelled
    l = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", F.array("lang", F.concat(F.lit("q"), quality.cast("string"))).alias("labels"))
    distinct = l.select(F.explode("labels").alias("x")).distinct()  # the vocabulary alone is gathered
    vocab = distinct.select(F.sort_array(F.collect_list("x"))).scalar()
    l = l.withColumn("vocab", vocab)
    mh = cl.multi_hot("labels", F.col("vocab"))
    return l.select("doc_id", F.array_join(F.transform(mh, lambda x: x.cast("int").cast("string")), ",").alias("multi_hot"))


@register("label_id", sql="""
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN -1 WHEN lang = 'de' THEN 0 WHEN lang = 'en' THEN 1 WHEN lang = 'fr' THEN 2 END AS label_id FROM documents""")
def q_label_id(spark, sf):
    """F15 for one label: the marker -1 is kept, a label that training lacks is NULL."""
    label = F.when(F.col("doc_id") % 7 == 0, F.lit("-1")).otherwise(F.col("lang"))
    return Tables(spark, sf).documents.select("doc_id", cl.label_id(label, ["de", "en", "fr"]).alias("label_id"))


@register("display_name", sql="""
SELECT DISTINCT context_id, CASE WHEN strpos(path, 'wanli') > 0 THEN 'WANLI' WHEN strpos(path, 'fever') > 0 THEN 'FEVER' ELSE path END AS name
FROM (SELECT doc_id AS context_id, CASE doc_id % 3 WHEN 0 THEN 'exp/fever/run_' || lang WHEN 1 THEN 'exp/wanli/run_' || lang ELSE 'exp/' || source END AS path FROM documents)""")
def q_display_name(spark, sf):
    """F16: display name of the corpus a path names, else the path."""
    d = F.col("doc_id")
    path = (F.when(d % 3 == 0, F.concat(F.lit("exp/fever/run_"), "lang")).when(d % 3 == 1, F.concat(F.lit("exp/wanli/run_"), "lang"))
            .otherwise(F.concat(F.lit("exp/"), "source")))
    return Tables(spark, sf).documents.select(d.alias("context_id"), cl.display_name(path).alias("name")).distinct()


@register("path_columns", sql="SELECT doc_id, 'documents' AS table_name FROM documents")
def q_path_columns(spark, sf):
    """Scan a table keeping its file path; the table name is cut out of the path."""
    from mixlab.sources.io import path_columns

    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("_metadata.file_path").alias("path"))
    return path_columns(d, "path", r"/([a-z_]+)\.parquet", ["table_name"]).drop("path")


@register("column_inference", sql="SELECT id, context || ' | ' || claim AS text, label FROM fx_fv", fx=["fx_fv"])
def q_column_inference(spark, sf):
    """P10: input / output columns found from the schema and renamed."""
    from mixlab.sources.io import to_text_label

    m = mx.mixture(fx.fx_fv(Tables(spark, sf)), "fv", 0.0).select("id", "text", "label")
    return to_text_label(m, strict=True)
