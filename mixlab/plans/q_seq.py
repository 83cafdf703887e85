"""Registered sequence-preparation and dialogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixlab.functions.text import words
from mixlab.operators import sequences as sq
from mixlab.plans.oracle_fixtures import words_sql
from mixlab.plans.registry import register
from mixlab.sources import fixtures as fx
from mixlab.sources.tables import Tables


def ints(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


VOCAB_SQL = f"""w AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos
       FROM (SELECT doc_id, {words_sql('text')} AS ws FROM documents)),
c AS (SELECT word, count(*) AS n FROM w GROUP BY word),
v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS id FROM c),
t AS (SELECT doc_id, pos, id FROM w JOIN v USING (word))"""


def _doc_ids(spark, sf):
    d = Tables(spark, sf).documents
    return sq.token_ids(d, "text", sq.vocabulary(d, "text"), id_col="doc_id")


@register("token_ids", sql=f"""
WITH {VOCAB_SQL}
SELECT doc_id, count(*) AS n_tokens, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids FROM t GROUP BY doc_id""")
def q_token_ids(spark, sf):
    t = _doc_ids(spark, sf)
    return t.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ints(F.col("ids")).alias("ids"))


@register("pack_blocks", sql=f"""
WITH {VOCAB_SQL},
d AS (SELECT doc_id, count(*) AS len FROM t GROUP BY doc_id),
r AS (SELECT doc_id, len, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS g FROM d),
o AS (SELECT doc_id, g, coalesce(sum(len) OVER (PARTITION BY g ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
             sum(len) OVER (PARTITION BY g) AS total FROM r),
p AS (SELECT o.g, o.off + t.pos - 1 AS gpos, o.total, t.id FROM t JOIN o USING (doc_id))
SELECT CAST(g AS BIGINT) AS "group", CAST(gpos // 256 AS BIGINT) AS block, string_agg(CAST(id AS VARCHAR), ',' ORDER BY gpos) AS input_ids
FROM p WHERE gpos // 256 < total // 256 GROUP BY g, gpos // 256""")
def q_pack_blocks(spark, sf):
    p = sq.pack_blocks(_doc_ids(spark, sf), "ids", "doc_id", 256)
    return p.select(F.col("group").cast("long").alias("group"), F.col("block").cast("long").alias("block"),
                    ints(F.col("input_ids")).alias("input_ids"))


def _lens_sql(x):
    return f"list_transform({words_sql(x)}, lambda w: CAST(strlen(w) AS INTEGER))"


@register("prompt_mask", sql=f"""
WITH a AS (SELECT id, {_lens_sql('question')} AS i, {_lens_sql('answer')} AS t FROM fx_qa),
b AS (SELECT id, i, (i || t)[1:64] AS j FROM a),
c AS (SELECT id, i, j || list_transform(generate_series(1, greatest(64 - len(j), 0)), lambda x: 0) AS ids FROM b)
SELECT id, array_to_string(ids, ',') AS input_ids,
       array_to_string(list_transform(generate_series(1, len(ids)),
                       lambda k: CASE WHEN ids[k] = 0 OR k - 1 < least(len(i), 64) THEN -100 ELSE ids[k] END), ',') AS labels
FROM c""", fx=["fx_qa"])
def q_prompt_mask(spark, sf):
    q = fx.fx_qa(Tables(spark, sf))
    lens = lambda c: F.transform(words(c), lambda w: F.octet_length(w))
    ids, labels = sq.prompt_mask(lens("question"), lens("answer"), 64)
    return q.select("id", ints(ids).alias("input_ids"), ints(labels).alias("labels"))


@register("pair_encode", sql=f"""
WITH a AS (SELECT id, {_lens_sql('question')}[1:64] AS s, {_lens_sql('answer')}[1:16] AS t FROM fx_qa)
SELECT id, array_to_string(s || list_transform(generate_series(1, 64 - len(s)), lambda x: 0), ',') AS input_ids,
       array_to_string(list_transform(t || list_transform(generate_series(1, 16 - len(t)), lambda x: 0),
                                      lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ',') AS labels
FROM a""", fx=["fx_qa"])
def q_pair_encode(spark, sf):
    q = fx.fx_qa(Tables(spark, sf))
    lens = lambda c: F.transform(words(c), lambda w: F.octet_length(w))
    ids, labels = sq.pair_encode(lens("question"), lens("answer"), 64, 16)
    return q.select("id", ints(ids).alias("input_ids"), ints(labels).alias("labels"))


ROLLUP_SQL = """SELECT conv_id, string_agg(regexp_replace(role, '^\\s+|\\s+$', '', 'g') || ': ' ||
                                  regexp_replace(text, '^\\s+|\\s+$', '', 'g') || '|', '' ORDER BY turn) AS context
FROM conversations GROUP BY conv_id"""


@register("dialogue_rollup", sql=ROLLUP_SQL)
def q_dialogue_rollup(spark, sf):
    c = Tables(spark, sf).conversations
    return sq.dialogue_rollup(c, "conv_id", "turn", "role", "text")


@register("lookup_join", sql=f"""
SELECT q.id, q.context_id, r.context FROM fx_qa q JOIN ({ROLLUP_SQL}) r ON r.conv_id = q.context_id""", fx=["fx_qa"])
def q_lookup_join(spark, sf):
    t = Tables(spark, sf)
    r = sq.dialogue_rollup(t.conversations, "conv_id", "turn", "role", "text")
    q = fx.fx_qa(t).select("id", "context_id")
    return q.join(r.withColumnRenamed("conv_id", "context_id"), "context_id", "inner").select("id", "context_id", "context")


@register("chat_corpus", sql=f"""
WITH g AS (SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS m,
                  arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id),
h AS (SELECT conv_id, CASE WHEN first_role = 'system' THEN m
                           ELSE [struct_pack(role := 'system', content := {"'" + sq.CHAT_SYSTEM + "'"})] || m END AS m FROM g),
k AS (SELECT * FROM h WHERE (len(m) - 1) % 2 = 0)
SELECT conv_id, CAST(unnest(generate_series(0, len(m) - 1)) AS INTEGER) AS pos, unnest(m).role AS role, unnest(m).content AS content FROM k""")
def q_chat_corpus(spark, sf):
    return sq.chat_corpus(Tables(spark, sf).conversations)
