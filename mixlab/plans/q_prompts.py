"""Registered generation-input queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixlab.functions.text import words
from mixlab.operators import prompts as pr
from mixlab.operators import sampling as sm
from mixlab.plans.oracle_fixtures import all_words_sql, words_sql
from mixlab.plans.q_sampling import cnt, rk
from mixlab.plans.registry import register
from mixlab.plans.sql_parse import fv_stages, qa_stages
from mixlab.sources import fixtures as fx
from mixlab.sources.tables import Tables

URL_SQL = "regexp_replace({x}, 'https?://\\S+|www\\.\\S+', '', 'g')"


def ctx_sql(x):
    filled = f"replace('Context: [CONTEXT]', '[CONTEXT]', {x})"
    return URL_SQL.format(x=f"array_to_string({words_sql(filled)}[1:3000], ' ')")


def lit(s):
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SYS_FV = lit(pr.SYSTEM[("fv", False)])
SYS_FVX = lit(pr.SYSTEM[("fv", True)])
ANS_FV = lit(pr.ANSWER_TEMPLATE[("fv", False)])
ANS_FVX = lit(pr.ANSWER_TEMPLATE[("fv", True)])
SYS_QA = lit(pr.SYSTEM[("qa", False)])
SYS_QAX = lit(pr.SYSTEM[("qa", True)])
ANS_QA = lit(pr.ANSWER_TEMPLATE[("qa", False)])
ANS_QAX = lit(pr.ANSWER_TEMPLATE[("qa", True)])
LAB_SYS = f"CASE WHEN label = 1 THEN {lit(pr.LABEL_TRUE_SYSTEM)} ELSE {lit(pr.LABEL_FALSE_SYSTEM)} END"
LAB_ANS = f"CASE WHEN ex_label = 1 THEN {lit(pr.LABEL_TRUE_ANSWER)} ELSE {lit(pr.LABEL_FALSE_ANSWER)} END"

FEW_SHOT_CTE = f"""r AS (SELECT *, {rk('dataset_name, label')} AS r, {cnt('dataset_name, label')} AS n FROM fx_fv),
ok AS (SELECT * FROM r WHERE n > 3),
w AS (SELECT ok.id, ok.dataset_name, ok.label, j, ((ok.r - 1 + j) % ok.n) + 1 AS pr FROM ok, (SELECT unnest([1, 2, 3]) AS j) jj),
ex AS (SELECT w.id, w.j, p.context AS ex_context, p.claim AS ex_claim, p.label AS ex_label
       FROM w JOIN ok p ON p.dataset_name = w.dataset_name AND p.label = w.label AND p.r = w.pr),
msgs AS (
  SELECT id, 0 AS pos, 'system' AS role, replace({SYS_FV}, '[LABEL]', {LAB_SYS}) AS content FROM ok
  UNION ALL SELECT id, 7, 'user', {ctx_sql('context')} FROM ok
  UNION ALL SELECT id, 2 * j - 1, 'user', {ctx_sql('ex_context')} FROM ex
  UNION ALL SELECT id, 2 * j, 'assistant', {URL_SQL.format(x=f"replace(replace({ANS_FV}, '[CLAIM]', ex_claim), '[LABEL]', {LAB_ANS})")} FROM ex)"""


def _fv(spark, sf):
    return fx.fx_fv(Tables(spark, sf))


@register("few_shot", sql=f"WITH {FEW_SHOT_CTE}\nSELECT id, pos, role, content FROM msgs", fx=["fx_fv"])
def q_few_shot(spark, sf):
    msgs, _ = pr.few_shot(_fv(spark, sf), "fv")
    return msgs


@register("few_shot_rejects", sql=f"""
WITH r AS (SELECT id, {cnt('dataset_name, label')} AS n FROM fx_fv) SELECT id FROM r WHERE n <= 3""", fx=["fx_fv"])
def q_few_shot_rejects(spark, sf):
    """Rows whose group has too few others to draw examples from."""
    return pr.few_shot(_fv(spark, sf), "fv")[1]


def explained_sql(task, src, pool):
    """Messages of G3 over src(id, dataset_name, ...) and the pool of explained rows."""
    group = ["dataset_name", "label"] if task == "fv" else ["dataset_name"]
    names = ", ".join(group)
    h = "md5(concat(CAST(x.id AS VARCHAR), '-', '42', '-', 'examples'))"
    number = lambda at: f"CAST('0x' || substr({h}, {at}, 8) AS BIGINT)"
    system = f"replace({SYS_FVX}, '[LABEL]', {LAB_SYS})" if task == "fv" else SYS_QAX
    if task == "fv":
        answer = f"replace(replace(replace({ANS_FVX}, '[CLAIM]', ex.claim), '[LABEL]', {LAB_ANS.replace('ex_label', 'ex.label')}), '[EXPLANATION]', ex.explanation)"
    else:
        answer = f"replace(replace(replace({ANS_QAX}, '[QUESTION]', ex.question), '[ANSWER]', ex.answer), '[EXPLANATION]', ex.explanation)"
    return f"""x AS ({src}),
pool AS (SELECT *, {rk(names)} - 1 AS r, {cnt(names)} AS m FROM ({pool})),
sizes AS (SELECT DISTINCT {names}, m FROM pool),
ok AS (SELECT x.*, s.m, o.r AS own, list_filter({pr.STRIDES}, lambda p: s.m % p <> 0) AS strides, {number(1)} AS h1, {number(9)} AS h2
       FROM x JOIN sizes s USING ({names}) LEFT JOIN pool o ON {" AND ".join(f"o.{c} = x.{c}" for c in ["id", *group])}
       WHERE s.m - CAST(o.r IS NOT NULL AS INTEGER) >= 3),
st AS (SELECT *, strides[CAST(h2 % len(strides) AS INTEGER) + 1] AS step FROM ok),
rs AS (SELECT *, list_filter(list_transform([0, 1, 2, 3], lambda j: (h1 + j * step) % m), lambda r: own IS NULL OR r <> own)[1:3] AS ranks FROM st),
w AS (SELECT id, {names}, unnest([1, 2, 3]) AS j, unnest(ranks) AS at FROM rs),
exs AS (SELECT w.id, w.j, pool.* EXCLUDE (id, r, m) FROM w JOIN pool ON {" AND ".join(f"pool.{c} = w.{c}" for c in group)} AND pool.r = w.at)
SELECT id, 0 AS pos, 'system' AS role, {system} AS content FROM ok
UNION ALL SELECT id, 7, 'user', {ctx_sql('context')} FROM ok
UNION ALL SELECT id, CAST(2 * j - 1 AS INTEGER), 'user', {ctx_sql('context')} FROM exs
UNION ALL SELECT id, CAST(2 * j AS INTEGER), 'assistant', {URL_SQL.format(x=answer)} FROM exs ex"""


FV_X = f"SELECT *, {all_words_sql('syn_claim')} AS explanation FROM fx_fv"
QA_X = f"SELECT *, {all_words_sql('meta')} AS explanation FROM fx_qa"


@register("few_shot_explained", sql="WITH " + explained_sql("fv", FV_X, FV_X), fx=["fx_fv"])
def q_few_shot_explained(spark, sf):
    """Every row is explained, so every group is its pool, whatever its size."""
    f = _fv(spark, sf).withColumn("explanation", F.array_join(words("syn_claim"), " "))
    return pr.few_shot_explained(f, f, "fv")[0].withColumn("pos", F.col("pos").cast("int"))


def _qa(spark, sf):
    return fx.fx_qa(Tables(spark, sf))


@register("few_shot_explained_qa", sql="WITH " + explained_sql("qa", QA_X, f"SELECT * EXCLUDE (cr) FROM (SELECT *, {rk('dataset_name')} AS cr FROM ({QA_X})) WHERE cr <= 10"), fx=["fx_qa"])
def q_few_shot_explained_qa(spark, sf):
    """Ten curated rows a dataset, some of which are asked for themselves."""
    f = _qa(spark, sf).withColumn("explanation", F.array_join(words("meta"), " "))
    return pr.few_shot_explained(f, pr.curated_examples(f, "qa", 10), "qa")[0].withColumn("pos", F.col("pos").cast("int"))


FEW_SHOT_QA_CTE = f"""r AS (SELECT *, {rk('dataset_name')} AS r, {cnt('dataset_name')} AS n FROM fx_qa),
ok AS (SELECT * FROM r WHERE n > 3),
w AS (SELECT ok.id, ok.dataset_name, j, ((ok.r - 1 + j) % ok.n) + 1 AS pr FROM ok, (SELECT unnest([1, 2, 3]) AS j) jj),
ex AS (SELECT w.id, w.j, p.context AS ex_context, p.question AS ex_question, p.answer AS ex_answer
       FROM w JOIN ok p ON p.dataset_name = w.dataset_name AND p.r = w.pr),
msgs AS (
  SELECT id, 0 AS pos, 'system' AS role, {SYS_QA} AS content FROM ok
  UNION ALL SELECT id, 7, 'user', {ctx_sql('context')} FROM ok
  UNION ALL SELECT id, 2 * j - 1, 'user', {ctx_sql('ex_context')} FROM ex
  UNION ALL SELECT id, 2 * j, 'assistant', {URL_SQL.format(x=f"replace(replace({ANS_QA}, '[QUESTION]', ex_question), '[ANSWER]', ex_answer)")} FROM ex)"""


@register("few_shot_qa", sql=f"WITH {FEW_SHOT_QA_CTE}\nSELECT id, pos, role, content FROM msgs", fx=["fx_qa"])
def q_few_shot_qa(spark, sf):
    return pr.few_shot(_qa(spark, sf), "qa")[0]


SLICES_CTE = f"""sl AS (SELECT id, dataset_name, r, per,
  CAST(CASE WHEN per = 0 THEN 4 ELSE least(floor((r - 1) / per), 4) END AS INTEGER) AS batch
  FROM (SELECT id, dataset_name, {rk('dataset_name')} AS r, floor({cnt('dataset_name')} * 0.2) AS per FROM fx_fv)),
sl2 AS (SELECT id, dataset_name, batch, CAST(CAST(r - 1 - batch * per AS BIGINT) AS VARCHAR) AS custom_id FROM sl)"""


@register("requests", sql=f"""
WITH {FEW_SHOT_CTE}, {SLICES_CTE},
b AS (SELECT id, json_object('model', 'gpt-3.5-turbo',
                             'messages', list(json_object('role', role, 'content', content) ORDER BY pos),
                             'max_tokens', 120)::VARCHAR AS body FROM msgs GROUP BY id)
SELECT sl2.id, dataset_name, batch, custom_id, 'POST' AS method, '/v1/chat/completions' AS url, body
FROM sl2 JOIN b USING (id)""", fx=["fx_fv"])
def q_requests(spark, sf):
    f = _fv(spark, sf)
    msgs, _ = pr.few_shot(f, "fv")
    return pr.requests(msgs, f)


SLICES_QA_CTE = SLICES_CTE.replace("fx_fv", "fx_qa")


@register("requests_qa", sql=f"""
WITH {FEW_SHOT_QA_CTE}, {SLICES_QA_CTE},
b AS (SELECT id, json_object('model', 'gpt-3.5-turbo',
                             'messages', list(json_object('role', role, 'content', content) ORDER BY pos),
                             'max_tokens', 120)::VARCHAR AS body FROM msgs GROUP BY id)
SELECT sl2.id, dataset_name, batch, custom_id, 'POST' AS method, '/v1/chat/completions' AS url, body
FROM sl2 JOIN b USING (id)""", fx=["fx_qa"])
def q_requests_qa(spark, sf):
    q = _qa(spark, sf)
    return pr.requests(pr.few_shot(q, "qa")[0], q)


def _results(spark, sf):
    """Batch results as the service would return them: one JSON line per
    request, completion text taken from the completions view."""
    t = Tables(spark, sf)
    f = fx.fx_fv(t)
    sl = sm.slices(f.select("id", "dataset_name"), by=["dataset_name"])
    comp = fx.fx_completions(t).select("id", "completion")
    lines = sl.join(comp, "id").select("dataset_name", "batch", pr.result_line(F.col("custom_id"), F.col("completion")).alias("value"))
    return sl, pr.read_results(lines)


@register("realign_results", sql=f"""
WITH {SLICES_CTE}, res AS (SELECT s.dataset_name, s.batch, s.custom_id, c.completion AS text FROM sl2 s JOIN fx_completions c USING (id))
SELECT s.id, s.batch, s.custom_id, r.text FROM sl2 s JOIN res r USING (dataset_name, batch, custom_id)""",
          fx=["fx_completions"])
def q_realign_results(spark, sf):
    sl, res = _results(spark, sf)
    return pr.realign(res, sl).select("id", "batch", "custom_id", "text")


@register("ingest_results", sql=f"""
WITH {SLICES_CTE}, {fv_stages("SELECT s.id, c.completion AS o FROM sl2 s JOIN fx_completions c USING (id)")}
SELECT id, claim AS syn_claim, label AS syn_label FROM fv_out WHERE NOT rejected""", fx=["fx_completions"])
def q_ingest_results(spark, sf):
    sl, res = _results(spark, sf)
    kept, _ = pr.ingest(pr.realign(res, sl), "fv")
    return kept.select("id", "syn_claim", "syn_label")


@register("ingest_results_qa", sql=f"""
WITH {SLICES_CTE}, {qa_stages("SELECT s.id, c.completion AS o FROM sl2 s JOIN fx_completions c USING (id)")}
SELECT id, question AS syn_question, answer AS syn_answer FROM qa_out WHERE NOT rejected""", fx=["fx_completions"])
def q_ingest_results_qa(spark, sf):
    sl, res = _results(spark, sf)
    kept, _ = pr.ingest(pr.realign(res, sl), "qa")
    return kept.select("id", "syn_question", "syn_answer")


@register("ingest_rejects_qa", sql=f"""
WITH {SLICES_CTE}, {qa_stages("SELECT s.id, c.completion AS o FROM sl2 s JOIN fx_completions c USING (id)")}
SELECT q.id, c.completion AS text FROM qa_out q JOIN fx_completions c USING (id) WHERE q.rejected""", fx=["fx_completions"])
def q_ingest_rejects_qa(spark, sf):
    sl, res = _results(spark, sf)
    return pr.ingest(pr.realign(res, sl), "qa")[1].select("id", "text")


@register("resume", sql=f"""
WITH {SLICES_CTE}, {fv_stages("SELECT s.id, c.completion AS o FROM sl2 s JOIN fx_completions c USING (id) WHERE s.batch < 2")}
SELECT id FROM fx_fv WHERE id NOT IN (SELECT id FROM fv_out WHERE NOT rejected)""", fx=["fx_completions"])
def q_resume(spark, sf):
    sl, res = _results(spark, sf)
    done, _ = pr.ingest(pr.realign(res.filter(F.col("batch") < 2), sl), "fv")
    return pr.resume(_fv(spark, sf).select("id"), done)
