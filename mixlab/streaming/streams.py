"""Structured Streaming jobs.

* T1 incremental result ingestion: JSON-lines file source -> completion
  parser -> parsed / rejected tables, idempotent per micro-batch (dynamic
  partition overwrite keyed by the batch id), restartable from the
  checkpoint (the streaming form of resume, G6).
* T2 duplicate results dropped within a watermark bound.
* T3 running usage / cost per model in tumbling event-time windows with a
  watermark for late data.

Sinks are parquet tables under the shared checkpoint folder; nothing is
collected into driver memory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixlab.operators.cost import priced
from mixlab.operators.parse import parse_fv, parse_qa
from mixlab.session import scratch_path

RESULT_LINE_SCHEMA = ("dataset_name string, batch int, custom_id string, "
                      "response struct<body:struct<choices:array<struct<message:struct<content:string>>>>>")


def new_run_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _upsert_batch(path: str, partition: str = "micro_batch"):
    def write(bdf: DataFrame, batch_id: int) -> None:
        (bdf.withColumn(partition, F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))
    return write


RESULT_KEYS = ["dataset_name", "batch", "custom_id"]


def ingest_stream(spark: SparkSession, source_dir: str, out_dir: str, task: str = "fv", available_now: bool = True,
                  files_per_batch: int | None = None):
    """Start the ingestion stream; returns the StreamingQuery.

    Of the results of a request (dataset, batch, custom id) the first that parses stays, by the file's time and
    path: it goes to ``out_dir``/parsed, later ones that parse to ``out_dir``/repeats, those that do not
    to ``out_dir``/rejects, so that a request sent anew after a reject can still be answered. A micro-batch compares its keys
    with those of earlier micro-batches only and writes a partition of its own, rewritten whole on replay: retries never duplicate."""
    reader = spark.readStream.schema(RESULT_LINE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.json(source_dir)
    text = F.get(F.col("response.body.choices"), 0)["message"]["content"]
    arrival = F.struct("_metadata.file_modification_time", "_metadata.file_path")
    res = lines.select(*RESULT_KEYS, text.alias("text"), arrival.alias("arrival"))
    parsed = (parse_fv if task == "fv" else parse_qa)(res, "text", "p")

    def write(bdf: DataFrame, batch_id: int) -> None:
        bdf = bdf.persist()
        bad = bdf.filter(F.col("p.rejected")).select(*RESULT_KEYS, "text")
        order = Window.partitionBy(*RESULT_KEYS).orderBy("arrival", "text")
        good = bdf.filter(~F.col("p.rejected")).withColumn("nth", F.row_number().over(order))
        if batch_id > 0:  # the first micro-batch has made the table
            before = bdf.sparkSession.read.schema("dataset_name string, batch int, custom_id string, micro_batch long").parquet(f"{out_dir}/parsed")
            before = before.where(F.col("micro_batch") < batch_id).select(*[F.col(c).alias(f"_{c}") for c in RESULT_KEYS], F.lit(True).alias("_done"))
            same = F.lit(True)
            for c in RESULT_KEYS:  # a request without a name is one
                same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
            good = good.join(before, same, "left")
            first = F.col("_done").isNull() & (F.col("nth") == 1)
        else:
            first = F.col("nth") == 1
        _upsert_batch(f"{out_dir}/parsed")(good.filter(first).select(*RESULT_KEYS, "p.*").drop("rejected"), batch_id)
        _upsert_batch(f"{out_dir}/repeats")(good.filter(~first).select(*RESULT_KEYS, "text"), batch_id)
        _upsert_batch(f"{out_dir}/rejects")(bad, batch_id)
        bdf.unpersist()

    w = parsed.writeStream.foreachBatch(write).option("checkpointLocation", f"{out_dir}/_checkpoint")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def unfinished(requests: DataFrame, out_dir: str) -> DataFrame:
    """G6 on a stream's sink: the requests without a result that parsed."""
    done = requests.sparkSession.read.parquet(f"{out_dir}/parsed").select(*RESULT_KEYS)
    return requests.join(done, RESULT_KEYS, "left_anti")


def dedup_stream(spark: SparkSession, source_dir: str, out_dir: str, keys: list[str], ts: str = "ts",
                 delay: str = "1 hour", glob: str = "*.parquet"):
    """Drop redelivered rows. ``keys`` identify a row for good (a result's batch and custom id): whichever
    copy comes first stays, so the result does not depend on the files' order as long as
    copies arrive within ``delay`` of event time."""
    schema = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).parquet(source_dir).schema
    s = (spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
         .parquet(source_dir))
    s = s.withColumn("_event_time", F.col(ts).cast("timestamp"))  # watermarks need TIMESTAMP (not NTZ)
    d = s.withWatermark("_event_time", delay).dropDuplicatesWithinWatermark(keys).drop("_event_time")
    return (d.writeStream.foreachBatch(_upsert_batch(out_dir)).option("checkpointLocation", f"{out_dir}_checkpoint")
            .trigger(availableNow=True).start())


def cost_stream(spark: SparkSession, usage: DataFrame, out_dir: str, window: str = "1 hour",
                delay: str = "10 minutes"):
    """Tokens and cost per model per tumbling window. ``usage`` is a
    streaming frame (model, prompt_tokens, completion_tokens, ts)."""
    ok, _ = priced(usage.withColumn("ts", F.col("ts").cast("timestamp")))
    agg = ok.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "model").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("prompt_cost").alias("prompt_cost"),
        F.sum("completion_cost").alias("completion_cost"))
    out = agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "model", "requests", "prompt_tokens",
                     "completion_tokens", "prompt_cost", "completion_cost")

    # update mode emits only the (window, model) rows that changed: each batch keeps a partition of its
    # own, rewritten whole on replay, and ``cost_table`` reads the newest row of each pair
    return (out.writeStream.outputMode("update").foreachBatch(_upsert_batch(out_dir))
            .option("checkpointLocation", f"{out_dir}_checkpoint").trigger(availableNow=True).start())


def cost_table(spark: SparkSession, out_dir: str) -> DataFrame:
    """T3 as of now: per window and model the row of the last batch that changed it."""
    rows = spark.read.parquet(out_dir)
    last = [c for c in rows.columns if c not in ("window_start", "model", "micro_batch")]
    newest = rows.groupBy("window_start", "model").agg(F.max_by(F.struct(*last), "micro_batch").alias("r"))
    return newest.select("window_start", "model", "r.*")
