"""SQL twins (DuckDB dialect) of the views in ``mixlab.sources.fixtures``.

``with_fx(sql, 'fx_fv', ...)`` prefixes a query with the CTEs it needs.
"""

from __future__ import annotations

WORDS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"


def words_sql(x: str) -> str:
    return WORDS.format(x=x)


def all_words_sql(x: str) -> str:
    return f"array_to_string({words_sql(x)}, ' ')"


FX: dict[str, str] = {}

FX["fx_fv"] = """
SELECT d.doc_id AS id, d.doc_id AS context_id, d.source AS dataset_name, 'fv' AS task,
       d.text AS context, b1.text AS claim, coalesce(l.quality, d.doc_id % 2) AS label, b2.text AS syn_claim,
       coalesce(l.toxic, 0) AS syn_label, d.lang AS meta
FROM documents d
LEFT JOIN labels l ON l.doc_id = d.doc_id
JOIN benchmark b1 ON b1.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
JOIN benchmark b2 ON b2.item_id = (d.doc_id + 1) % (SELECT count(*) FROM benchmark)
"""

FX["fx_qa"] = f"""
SELECT u.conv_id * 1000000 + u.turn AS id, u.conv_id AS context_id,
       'conv' || CAST(u.conv_id % 3 AS VARCHAR) AS dataset_name, 'qa' AS task,
       u.text AS question, a.text AS context,
       str_split(a.text, '.')[1] AS answer,
       n.text AS syn_question,
       str_split(a.text, '.')[2] AS syn_answer,
       CASE WHEN (u.conv_id * 1000000 + u.turn) % 17 = 0 THEN NULL
            ELSE a.text || ' | tail' END AS prediction,
       'turn' || CAST(u.turn AS VARCHAR) AS meta
FROM conversations u
JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
LEFT JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 2 AND n.role = 'user'
WHERE u.role = 'user'
"""

FX["fx_scores"] = """
SELECT d.doc_id AS id, coalesce(l.quality, d.doc_id % 2) AS label, CAST(d.n_chars % 1000 AS DOUBLE) / 1000.0 AS output
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

FX["fx_runs"] = """
SELECT dataset_name, task, frac, run, avg(metric) AS metric FROM (
  SELECT o_orderpriority AS dataset_name,
         CASE WHEN o_orderstatus = 'F' THEN 'Fact Verification' ELSE 'Question Answering' END AS task,
         CAST([0.0, 0.5, 0.95, 0.975, 1.0][o_custkey % 5 + 1] AS DOUBLE) AS frac,
         o_orderkey % 3 AS run,
         o_totalprice / 1e5 AS metric
  FROM orders) o
WHERE NOT (dataset_name = '5-LOW' AND frac = 0.0)
GROUP BY dataset_name, task, frac, run
"""

FX["fx_equiv"] = """
SELECT dataset_name, synthetic, real, avg(acc) AS acc FROM (
  SELECT p_brand AS dataset_name, CAST(1000 * (1 + p_size % 10) AS BIGINT) AS synthetic,
         CAST(CASE WHEN p_partkey % 2 = 1 THEN 200 ELSE 0 END AS BIGINT) AS real,
         p_retailprice / 1000.0 AS acc
  FROM part) p
GROUP BY dataset_name, synthetic, real
"""

FX["fx_usage"] = """
SELECT event_id AS request_id,
       CASE WHEN user_id % 2 = 0 THEN 'gpt-3.5-turbo-0125' ELSE 'gpt-4-turbo' END AS model,
       CAST(floor(value) * 10 AS BIGINT) AS prompt_tokens,
       CAST(floor(value) AS BIGINT) AS completion_tokens, ts
FROM events
"""

FX["fx_logits"] = """
SELECT vec_id AS id, label, CAST(embedding[1:2] AS DOUBLE[]) AS logits FROM embeddings
"""

FX["fx_logits5"] = """
SELECT vec_id AS id, label, CAST(embedding[1:5] AS DOUBLE[]) AS logits FROM embeddings
"""

FX["fx_token_vecs"] = """
SELECT CAST(floor(vec_id / 10) AS BIGINT) AS pair_id, vec_id % 2 AS side,
       CAST(floor(vec_id / 2) AS BIGINT) % 5 AS pos, vec_id,
       CAST(embedding AS DOUBLE[]) AS vector
FROM embeddings
"""

FX["fx_urls"] = """
SELECT page_id AS id, 'see ' || url || ' and ' || html AS text FROM pages
"""

_C = all_words_sql("claim")
_A = all_words_sql("context")
FX["fx_completions"] = f"""
SELECT id, dataset_name,
  [ 'Claim: ' || {_C} || '||' || chr(10) || 'Label: True',
    'Claim: ' || {_C} || '||' || chr(10) || 'Label: Untrue',
    'Claim: ' || {_C} || chr(10) || 'Verdict: not supported',
    'Question: ' || {_C} || '?||' || chr(10) || 'Answer: ' || {_A},
    'Question: ' || {_C} || '?|' || {_A} || '|x',
    '|True Claim: ' || {_C} || '|',
    '|Untrue Claim: ' || {_C} || '|',
    {_C} || '?' || chr(10) || {_A},
    'Claim: ' || {_C} || '||' || chr(10) || 'Label: incorrect',
    'nothing useful' ][id % 10 + 1] AS completion
FROM fx_fv
"""

_E = all_words_sql("syn_claim")
FX["fx_completions_x"] = f"""
SELECT id, dataset_name,
  CASE WHEN id % 10 < 5
       THEN 'Explanation: ' || {_E} || '||' || chr(10) || 'Question: ' || {_C} || '?||' || chr(10) || 'Answer: ' || {_A}
       ELSE 'Explanation: ' || {_E} || '||' || chr(10) || 'Claim: ' || {_C} || '||' || chr(10) || 'Label: '
            || CASE WHEN label = 1 THEN 'True' ELSE 'Untrue' END END AS completion
FROM fx_fv
"""

# which fixtures a fixture depends on
DEPS = {"fx_completions": ["fx_fv"], "fx_completions_x": ["fx_fv"]}


def with_fx(sql: str, *names: str) -> str:
    ordered: list[str] = []

    def add(n: str) -> None:
        for d in DEPS.get(n, []):
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{n} AS ({FX[n]})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
