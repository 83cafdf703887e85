"""Registered corpus-normalisation queries."""

from __future__ import annotations

from mixlab.operators import corpora as cp
from mixlab.plans.registry import register
from mixlab.sources import raw_views as rv
from mixlab.sources.tables import Tables


@register("canonical_fv")
def q_canonical_fv(spark, sf):
    """P1 + C1, C5, C6, C9: four fact-verification corpora in one canonical table."""
    t = Tables(spark, sf)
    return (cp.fever(rv.fever_raw(t)).unionByName(cp.factify(rv.factify_raw(t)))
            .unionByName(cp.wanli(rv.wanli_raw(t))).unionByName(cp.scifact(rv.scifact_raw(t))))


@register("canonical_qa")
def q_canonical_qa(spark, sf):
    """P1 + C2, C3, C4, C7, C8: five question-answering corpora in one canonical table."""
    t = Tables(spark, sf)
    recs, seg = rv.qaconv_raw(t)
    return (cp.narrativeqa(rv.narrativeqa_raw(t)).unionByName(cp.coqa(rv.coqa_raw(t)))
            .unionByName(cp.fairytaleqa(rv.fairytaleqa_raw(t))).unionByName(cp.qaconv(recs, seg))
            .unionByName(cp.ropes(rv.ropes_raw(t))))


def _blank_ok(x):
    return f"({x} IS NOT NULL AND regexp_replace({x}, '^\\s+|\\s+$', '', 'g') <> '')"


def _reshuffle_sql(src):
    return f"""SELECT * EXCLUDE (r, n) REPLACE (CASE WHEN r <= floor(n * (1.0 - 0.2)) THEN 'train' ELSE 'valid' END AS split)
  FROM (SELECT *, row_number() OVER (ORDER BY md5(concat(context_id, '-', '42')), context_id) AS r, count(*) OVER () AS n
        FROM ({src}) WHERE split = 'train')
  UNION ALL SELECT * FROM ({src}) WHERE split <> 'train'"""


SPLITS_SQL = "MAP {'train': 'train', 'validation': 'valid', 'test': 'test', 'valid': 'valid', 'dev': 'valid', 'val': 'valid', 'trn': 'train', 'tst': 'test', 'eval': 'test'}"
FV_COLS = "dataset_name, split, task, context, context_id, claim, label, meta"

CANONICAL_FV_SQL = f"""
WITH base AS (SELECT d.doc_id AS d, d.text, d.lang, b.text AS claim FROM documents d
              JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
fever0 AS (SELECT * FROM (
  SELECT {SPLITS_SQL}[['train', 'test', 'validation'][CAST(floor(d / 3) AS BIGINT) % 3 + 1]] AS split, claim,
         array_to_string(list_transform(str_split(text, '.'), lambda p: replace(replace(p, '-LRB-', '('), '-RRB-', ')')), chr(10)) AS context,
         CAST(d AS VARCHAR) AS context_id,
         CAST(['SUPPORTS', 'REFUTES', 'NOT ENOUGH INFO'][d % 3 + 1] = 'SUPPORTS' AS INTEGER) AS label, CAST(NULL AS VARCHAR) AS meta
  FROM base) WHERE {_blank_ok('context')} AND {_blank_ok('claim')}),
fever AS (
  SELECT * EXCLUDE (r, n) FROM (SELECT *, row_number() OVER (ORDER BY md5(concat(context_id, '-', '42')), context_id) AS r,
                                       count(*) OVER () AS n FROM fever0 WHERE split = 'train') WHERE r <= round_even(n * 0.3, 0)
  UNION ALL SELECT * FROM fever0 WHERE split <> 'train'),
factify0 AS (SELECT * FROM (
  SELECT CASE WHEN d % 4 = 0 THEN 'test' ELSE 'train' END AS split, text AS context, CAST(d AS VARCHAR) AS context_id, claim,
         CAST(MAP {{'Support_Text': 1, 'Insufficient_Text': 0, 'Refute': 0, 'Insufficient_Multimodal': -1, 'Support_Multimodal': -1}}
              [['Support_Text', 'Insufficient_Text', 'Refute', 'Insufficient_Multimodal', 'Support_Multimodal'][d % 5 + 1]] AS INTEGER) AS label,
         CAST(NULL AS VARCHAR) AS meta FROM base)
  WHERE (label IS NULL OR label <> -1) AND {_blank_ok('context')} AND {_blank_ok('claim')}),
wanli0 AS (SELECT * FROM (
  SELECT CASE WHEN d % 5 = 0 THEN 'test' ELSE 'train' END AS split, text AS context, CAST(d AS VARCHAR) AS context_id, claim,
         CAST(['neutral', 'contradiction', 'entailment'][d % 3 + 1] = 'entailment' AS INTEGER) AS label, lang AS meta FROM base)
  WHERE {_blank_ok('context')} AND {_blank_ok('claim')}),
scifact0 AS (SELECT * FROM (
  SELECT CASE WHEN d % 4 = 1 THEN 'test' ELSE 'train' END AS split,
         array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')[1:5], ' ') || ' ' || array_to_string(str_split(text, '.'), ' ') AS context,
         CAST(d AS VARCHAR) AS context_id, claim,
         CAST(['SUPPORT', 'NEI', 'CONTRADICT'][d % 3 + 1] = 'SUPPORT' AS INTEGER) AS label, CAST(NULL AS VARCHAR) AS meta FROM base)
  WHERE {_blank_ok('context')} AND {_blank_ok('claim')})
SELECT 'fever' AS dataset_name, split, 'fv' AS task, context, context_id, claim, label, meta FROM fever
UNION ALL SELECT 'factify', split, 'fv', context, context_id, claim, label, meta FROM ({_reshuffle_sql('SELECT * FROM factify0')})
UNION ALL SELECT 'wanli', split, 'fv', context, context_id, claim, label, meta FROM ({_reshuffle_sql('SELECT * FROM wanli0')})
UNION ALL SELECT 'scifact', split, 'fv', context, context_id, claim, label, meta FROM ({_reshuffle_sql('SELECT * FROM scifact0')})
"""

from mixlab.plans.registry import ORACLE  # noqa: E402

ORACLE["canonical_fv"] = CANONICAL_FV_SQL

CANONICAL_QA_SQL = f"""
WITH qb AS (SELECT u.conv_id AS c, u.turn AS t, u.text AS question, a.text AS context, str_split(a.text, '.') AS pieces
            FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
            WHERE u.role = 'user'),
narr AS (SELECT * FROM (
  SELECT {SPLITS_SQL}[['train', 'validation', 'test'][c % 3 + 1]] AS split, question, pieces[1] AS answer, context,
         CAST(c AS VARCHAR) AS context_id, 'turn' || CAST(t AS VARCHAR) AS meta FROM qb)
  WHERE {_blank_ok('context')} AND {_blank_ok('question')} AND {_blank_ok('answer')}
    AND split IS NOT NULL AND context_id IS NOT NULL AND meta IS NOT NULL),
coqa AS (SELECT * FROM (
  SELECT CASE WHEN c % 4 = 0 THEN 'test' ELSE 'train' END AS split, question, pieces[1] AS answer, context,
         CAST(c * 1000000 + t AS VARCHAR) AS context_id, CAST(NULL AS VARCHAR) AS meta FROM qb)
  WHERE {_blank_ok('context')} AND {_blank_ok('question')} AND {_blank_ok('answer')}),
ft0 AS (SELECT {SPLITS_SQL}[['train', 'validation', 'test'][c % 3 + 1]] AS split, c * 1000000 + t AS id, question,
               pieces[1] AS answer, context, 'turn' || CAST(t AS VARCHAR) AS meta FROM qb),
ftf AS (SELECT split, context, row_number() OVER (PARTITION BY split ORDER BY min(id), context) - 1 AS cid
        FROM ft0 GROUP BY split, context),
ft AS (SELECT * FROM (SELECT f.split, f.question, f.answer, f.context, CAST(x.cid AS VARCHAR) AS context_id, f.meta
                      FROM ft0 f JOIN ftf x ON x.split = f.split AND x.context = f.context)
       WHERE {_blank_ok('context')} AND {_blank_ok('question')} AND {_blank_ok('answer')}),
seg AS (SELECT 'seg' || CAST(conv_id AS VARCHAR) AS sid,
               string_agg(regexp_replace(role, '^\\s+|\\s+$', '', 'g') || ': ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || '|', '' ORDER BY turn) AS context
        FROM conversations GROUP BY conv_id),
qc AS (SELECT * FROM (
  SELECT {SPLITS_SQL}[['trn', 'tst', 'val'][q.c % 3 + 1]] AS split, q.question, q.answers[1] AS answer, s.context,
         q.sid AS context_id, q.qg AS meta
  FROM (SELECT c, question, 'seg' || CAST(c AS VARCHAR) AS sid, 'q' || CAST(t AS VARCHAR) AS qg,
               list_filter(pieces[1:2], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '') AS answers FROM qb) q
  LEFT JOIN seg s ON s.sid = q.sid WHERE len(q.answers) > 0)
  WHERE {_blank_ok('context')} AND {_blank_ok('question')} AND {_blank_ok('answer')}),
rp0 AS (SELECT * FROM (
  SELECT CASE WHEN c % 4 = 0 THEN 'test' ELSE 'train' END AS split, question, p[len(p)] AS answer,
         p[1] || chr(10) || array_to_string(p[2:len(p) - 1], '.') AS context, CAST(c * 1000000 + t AS VARCHAR) AS context_id, CAST(NULL AS VARCHAR) AS meta
  FROM (SELECT *, list_filter(pieces, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '') AS p FROM qb) WHERE len(p) >= 3)
  WHERE {_blank_ok('context')} AND {_blank_ok('question')} AND {_blank_ok('answer')})
SELECT 'narrativeqa' AS dataset_name, split, 'qa' AS task, question, answer, context, context_id, meta FROM narr
UNION ALL SELECT 'coqa', split, 'qa', question, answer, context, context_id, meta FROM coqa
UNION ALL SELECT 'fairytaleqa', split, 'qa', question, answer, context, context_id, meta FROM ft
UNION ALL SELECT 'qaconv', split, 'qa', question, answer, context, context_id, meta FROM qc
UNION ALL SELECT 'ropes', split, 'qa', question, answer, context, context_id, meta FROM ({_reshuffle_sql('SELECT * FROM rp0')})
"""

ORACLE["canonical_qa"] = CANONICAL_QA_SQL
