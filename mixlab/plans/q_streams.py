"""Registered streaming queries (T1-T3). Each runs its stream to completion
(availableNow) over data derived from the driver tables and returns the
sink table; T1 and T3 share their oracle with the batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixlab.operators import sampling as sm
from mixlab.plans.q_prompts import SLICES_CTE
from mixlab.plans.registry import register, rounded
from mixlab.plans.sql_parse import fv_stages
from mixlab.sources import fixtures as fx
from mixlab.sources.tables import Tables
from mixlab.streaming import streams as st


@register("stream_ingest", sql=f"""
WITH {SLICES_CTE}, {fv_stages("SELECT s.id, c.completion AS o FROM sl2 s JOIN fx_completions c USING (id)")}
SELECT f.dataset_name, s.batch, s.custom_id, o.claim, o.label
FROM fv_out o JOIN sl2 s USING (id) JOIN fx_fv f USING (id) WHERE NOT o.rejected""", fx=["fx_completions"])
def q_stream_ingest(spark, sf):
    t = Tables(spark, sf)
    f = fx.fx_fv(t)
    sl = sm.slices(f.select("id", "dataset_name"), by=["dataset_name"])
    comp = fx.fx_completions(t).select("id", "completion")
    lines = sl.join(comp, "id").select(
        "dataset_name", "batch", "custom_id",
        F.struct(F.struct(F.array(F.struct(F.struct(F.col("completion").alias("content")).alias("message")))
                          .alias("choices")).alias("body")).alias("response"))
    run = st.new_run_dir(spark, "stream-ingest")
    lines.write.partitionBy("batch").json(f"{run}/incoming")  # the service's result files, one folder per batch
    q = st.ingest_stream(spark, f"{run}/incoming", f"{run}/out", "fv")
    q.awaitTermination()
    return spark.read.parquet(f"{run}/out/parsed").select("dataset_name", "batch", "custom_id", "claim", "label")


def _lines(spark, sf):
    t = Tables(spark, sf)
    sl = sm.slices(fx.fx_fv(t).select("id", "dataset_name"), by=["dataset_name"])
    text = F.struct(F.struct(F.array(F.struct(F.struct(F.col("completion").alias("content")).alias("message"))).alias("choices")).alias("body"))
    return sl, sl.join(fx.fx_completions(t).select("id", "completion"), "id").select("id", "dataset_name", "batch", "custom_id", text.alias("response"))


@register("stream_ingest_repeats", sql=f"""
WITH {SLICES_CTE}, {fv_stages("SELECT s.id, c.completion AS o FROM sl2 s JOIN fx_completions c USING (id)")},
d AS (SELECT *, CAST(id % 7 <> 0 AS INTEGER) + CAST(id % 7 <> 0 AND id % 3 = 0 AS INTEGER) + CAST(id % 7 < 3 AS INTEGER) AS copies FROM fv_out JOIN sl2 USING (id)),
k AS (SELECT id, 'parsed' AS kind, 1 AS copies FROM d WHERE NOT rejected AND copies > 0
  UNION ALL SELECT id, 'repeats', copies - 1 FROM d WHERE NOT rejected AND copies > 1
  UNION ALL SELECT id, 'rejects', copies FROM d WHERE rejected AND copies > 0
  UNION ALL SELECT id, 'unfinished', 1 FROM d WHERE rejected OR copies = 0)
SELECT s.dataset_name, s.batch, s.custom_id, k.kind, CAST(k.copies AS BIGINT) AS copies FROM k JOIN sl2 s USING (id)""", fx=["fx_completions"])
def q_stream_ingest_repeats(spark, sf):
    """Two deliveries in several files with repeats inside and between them, a restart before the second, and what is still to do."""
    sl, lines = _lines(spark, sf)
    run = st.new_run_dir(spark, "stream-repeats")
    first = lines.where("id % 7 <> 0")
    for files in (first, first.where("id % 3 = 0")):
        files.drop("id").write.mode("append").json(f"{run}/incoming")
    st.ingest_stream(spark, f"{run}/incoming", f"{run}/out", files_per_batch=64).awaitTermination()
    lines.where("id % 7 < 3").drop("id").write.mode("append").json(f"{run}/incoming")
    st.ingest_stream(spark, f"{run}/incoming", f"{run}/out", files_per_batch=64).awaitTermination()
    tables = [spark.read.parquet(f"{run}/out/{kind}").select(*st.RESULT_KEYS, F.lit(kind).alias("kind")) for kind in ("parsed", "repeats", "rejects")]
    tables.append(st.unfinished(sl, f"{run}/out").select(*st.RESULT_KEYS, F.lit("unfinished").alias("kind")))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*st.RESULT_KEYS, "kind").agg(F.count(F.lit(1)).alias("copies"))


@register("stream_dedup", sql=f"""
WITH {SLICES_CTE} SELECT f.dataset_name, s.batch, s.custom_id, c.completion FROM sl2 s JOIN fx_completions c USING (id) JOIN fx_fv f USING (id)""",
          fx=["fx_completions"])
def q_stream_dedup(spark, sf):
    """Results delivered twice, deduplicated on (dataset, batch, custom id) within the watermark."""
    t = Tables(spark, sf)
    f = fx.fx_fv(t)
    sl = sm.slices(f.select("id", "dataset_name"), by=["dataset_name"])
    sent = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 1800)
    lines = sl.join(fx.fx_completions(t).select("id", "completion"), "id").select(
        "dataset_name", "batch", "custom_id", "completion", sent.alias("ts"))
    run = st.new_run_dir(spark, "stream-dedup")
    for delivery in ("first", "again"):
        lines.write.parquet(f"{run}/incoming/{delivery}")
    q = st.dedup_stream(spark, f"{run}/incoming", f"{run}/out", ["dataset_name", "batch", "custom_id"])
    q.awaitTermination()
    return spark.read.parquet(f"{run}/out").select("dataset_name", "batch", "custom_id", "completion")


@register("stream_cost", sql="""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, model, count(*) AS requests,
       CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
       round(sum(prompt_tokens * ((CASE model WHEN 'gpt-3.5-turbo-0125' THEN 0.5 ELSE 10.0 END) / 1000000)), 9) AS prompt_cost,
       round(sum(completion_tokens * ((CASE model WHEN 'gpt-3.5-turbo-0125' THEN 1.5 ELSE 30.0 END) / 1000000)), 9) AS completion_cost
FROM fx_usage GROUP BY ALL""", fx=["fx_usage"])
def q_stream_cost(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    usage = ev.select(
        F.when(F.col("user_id") % 2 == 0, F.lit(fx.MODEL_EVEN)).otherwise(F.lit(fx.MODEL_ODD)).alias("model"),
        (F.floor("value") * 10).cast("long").alias("prompt_tokens"), F.floor("value").cast("long").alias("completion_tokens"),
        F.col("ts"))
    run = st.new_run_dir(spark, "stream-cost")
    q = st.cost_stream(spark, usage, f"{run}/out")
    q.awaitTermination()
    out = st.cost_table(spark, f"{run}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return rounded(out.select("window_start", "model", "requests", "prompt_tokens",
                                                           "completion_tokens", "prompt_cost", "completion_cost"), 9)
