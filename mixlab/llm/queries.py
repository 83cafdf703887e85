"""The registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlab.llm import chat, decontaminate, exact_dedup, line_dedup, packing, periodic_runs, phrases, sharding, simhash, token_store, toxicity, url_templates, weighted_prints
from mixlab.llm.common import read


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_files(read(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.mark_lines(read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), says.alias("text"))
    return chat.digests(chat.render(chat.from_turns(turns.unionByName(extra))))


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(read(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_prints.compare(read(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top(phrases.collocations(read(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.plant(read(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.mark_runs(docs))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS escaped,
         replace(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), chr(10), '\n'), ':', '\c') AS escaped_role
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(escaped_role) + 2 + length(escaped) + 9) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM benchmark
), dp AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM d),
bp AS (SELECT item_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM b),
bl AS (SELECT item_id, len(w) AS items FROM b),
dl AS (SELECT doc_id, len(w) AS doc_len FROM d),
eq AS (SELECT doc_id, item_id, dp.pos - bp.pos AS shift, bp.pos AS p FROM dp JOIN bp USING (word)),
enough AS (SELECT doc_id, item_id, shift FROM eq GROUP BY ALL HAVING count(*) >= {decontaminate.WINDOW - decontaminate.MAX_SUBSTITUTIONS}),
eqs AS (SELECT eq.* FROM eq JOIN enough USING (doc_id, item_id, shift)),
win AS (
  SELECT DISTINCT doc_id, item_id, shift, items, doc_len, unnest(generate_series(greatest(0, -shift, p - {decontaminate.WINDOW - 1}), least(p, items - {decontaminate.WINDOW}, doc_len - shift - {decontaminate.WINDOW}))) AS s
  FROM eqs JOIN bl USING (item_id) JOIN dl USING (doc_id)
), counted AS (
  SELECT win.doc_id, win.item_id, win.shift, win.s, count(*) AS m
  FROM win JOIN eqs ON win.doc_id = eqs.doc_id AND win.item_id = eqs.item_id AND win.shift = eqs.shift AND eqs.p BETWEEN win.s AND win.s + {decontaminate.WINDOW - 1}
  GROUP BY ALL HAVING count(*) >= {decontaminate.WINDOW - decontaminate.MAX_SUBSTITUTIONS}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY m DESC, s + shift, s) AS r, count(*) OVER (PARTITION BY doc_id, item_id) AS n FROM counted
)
SELECT doc_id, item_id, CAST(s + shift AS BIGINT) AS doc_pos, CAST(s AS BIGINT) AS item_pos, m AS window_matches, n AS n_windows
FROM ranked WHERE r = 1
"""


def op10_sql() -> str:
    size, shards = sharding.TABLE_SIZE, [f"shard-{k:03d}" for k in range(sharding.SHARDS)]
    table = sharding.lookup_table(shards, size)
    slot = f"CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {size} AS INTEGER)"
    return f"WITH t AS (SELECT {table} AS owners) SELECT doc_id, {slot} AS slot, 'shard-' || lpad(CAST(owners[{slot} + 1] AS VARCHAR), 3, '0') AS shard FROM documents, t"


QUERIES = {f.__name__: f for f in (op1_token_store, op2_exact_dedup, op3_line_dedup, op4_simhash, op5_toxicity, op6_chat, op7_url_templates, op8_decontaminate, op9_packing, op10_sharding, op11_fingerprints, op12_phrases, op13_periodic_runs)}
ORACLE = {"op2_exact_dedup": OP2_SQL, "op6_chat": OP6_SQL, "op8_decontaminate": OP8_SQL, "op10_sharding": op10_sql()}
