"""Registered source and sink queries (S1-S5, S7-S9). Each writes a table derived from the driver's into the shared
folder, reads it back through the source and returns what the source read."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixlab.operators import sampling as sm
from mixlab.plans.q_prompts import SLICES_CTE
from mixlab.plans.registry import register, rounded
from mixlab.sources import fixtures as fx
from mixlab.sources import io
from mixlab.sources.tables import Tables
from mixlab.streaming.streams import new_run_dir

FV_COLS = ["id", "dataset_name", "context", "claim", "label", "syn_claim"]


@register("csv_round_trip", sql=f"SELECT {', '.join(FV_COLS)} FROM fx_fv", fx=["fx_fv"])
def q_csv_round_trip(spark, sf):
    """Whole texts with line ends, quotes and outer blanks through header CSV."""
    f = fx.fx_fv(Tables(spark, sf)).select(*FV_COLS)
    run = new_run_dir(spark, "csv")
    io.write_csv(f, f"{run}/out", null_value="\\N")
    return io.read_csv(spark, f"{run}/out", f.schema, null_value="\\N")


@register("jsonl_round_trip", sql=f"""
WITH {SLICES_CTE} SELECT s.id, s.dataset_name, s.batch, s.custom_id, c.completion AS text FROM sl2 s JOIN fx_completions c USING (id)""",
          fx=["fx_completions"])
def q_jsonl_round_trip(spark, sf):
    """Result lines, one folder per request batch."""
    t = Tables(spark, sf)
    sl = sm.slices(fx.fx_fv(t).select("id", "dataset_name"), by=["dataset_name"])
    lines = sl.join(fx.fx_completions(t).select("id", F.col("completion").alias("text")), "id")
    run = new_run_dir(spark, "jsonl")
    io.write_jsonl(lines.select("id", "dataset_name", "batch", "custom_id", "text"), f"{run}/out", partition_by=["batch"])
    return io.read_jsonl(spark, f"{run}/out", "id long, dataset_name string, batch int, custom_id string, text string")


@register("keyed_json", sql="""
SELECT CAST(conv_id AS VARCHAR) AS key, CAST(turn AS BIGINT) AS turn, role AS speaker, text FROM conversations""")
def q_keyed_json(spark, sf):
    """Keyed JSON documents of a hundred conversations each, an entry a line, read entry by entry."""
    c = Tables(spark, sf).conversations
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").alias("speaker"), "text")))
    records = c.groupBy("conv_id").agg(turns.alias("turns"))
    entry = F.concat(F.to_json(F.create_map(F.col("conv_id").cast("string"), F.struct("turns"))))
    lines = records.select((F.col("conv_id") / 100).cast("long").alias("doc"), F.substr(entry, F.lit(2), F.length(entry) - 2).alias("line"))
    docs = lines.groupBy("doc").agg(F.concat(F.lit("{\n"), F.array_join(F.collect_list("line"), ",\n"), F.lit("\n}")).alias("value"))
    run = new_run_dir(spark, "keyed")
    docs.select("value").write.text(f"{run}/out")
    back = io.read_keyed_json(spark, f"{run}/out", "struct<turns:array<struct<turn:long,speaker:string,text:string>>>", by_line=True)
    return back.select("key", F.inline("turns"))


# The layout of an experiment's results: exp/model/cot/dataset/size/frac/run.
LAYOUT = ["exp", "model", "cot", "dataset", "size", "frac", "run"]
LAYOUT_SCHEMA = "metric double, exp string, model string, cot string, dataset string, size int, frac double, run int"
LAYOUT_SQL = f"""r AS (SELECT metric, CASE task WHEN 'Fact Verification' THEN 'fv' ELSE 'qa' END AS exp,
  CASE WHEN run % 2 = 0 THEN '{fx.MODEL_EVEN}' ELSE '{fx.MODEL_ODD}' END AS model, CASE run WHEN 1 THEN 'cot' ELSE 'direct' END AS cot,
  dataset_name AS dataset, CAST(1000 * (run + 1) AS INTEGER) AS size, frac, CAST(run AS INTEGER) AS run FROM fx_runs)"""


def _layout(spark, sf, name):
    r = fx.fx_runs(Tables(spark, sf)).select(
        "metric", F.when(F.col("task") == "Fact Verification", "fv").otherwise("qa").alias("exp"),
        F.when(F.col("run") % 2 == 0, fx.MODEL_EVEN).otherwise(fx.MODEL_ODD).alias("model"),
        F.when(F.col("run") == 1, "cot").otherwise("direct").alias("cot"), F.col("dataset_name").alias("dataset"),
        (1000 * (F.col("run") + 1)).cast("int").alias("size"), "frac", F.col("run").cast("int").alias("run"))
    run = new_run_dir(spark, name)
    return r, run


@register("scan_layout", sql=f"""
WITH {LAYOUT_SQL}, names AS (SELECT DISTINCT o_orderpriority AS dataset, lower(o_orderpriority[3:]) AS display_name FROM orders)
SELECT display_name, exp, model, cot, dataset, size, frac, run, round(metric, 6) AS metric
FROM r JOIN names USING (dataset) WHERE display_name IN ('urgent', 'low')""", fx=["fx_runs"])
def q_scan_layout(spark, sf):
    """The layout by partition discovery; the folders to read are chosen at run time by display name."""
    r, run = _layout(spark, sf, "layout")
    io.write_layout(r, f"{run}/results", LAYOUT)
    prio = Tables(spark, sf).orders.select(F.col("o_orderpriority").alias("dataset")).distinct()
    prio.select("dataset", F.lower(F.substring("dataset", 3, 100)).alias("display_name")).write.parquet(f"{run}/names")
    names = spark.read.parquet(f"{run}/names").where(F.col("display_name").isin("urgent", "low"))
    return rounded(io.scan_layout(spark, f"{run}/results", LAYOUT_SCHEMA, names, "dataset").select("display_name", *LAYOUT, "metric"))


@register("scan_paths", sql=f"""
WITH {LAYOUT_SQL} SELECT exp, model, dataset, frac, CAST(run AS VARCHAR) AS run, round(metric, 6) AS metric FROM r""", fx=["fx_runs"])
def q_scan_paths(spark, sf):
    """One recursive scan over many CSV files, a folder of which is skipped; columns are cut out of the paths."""
    r, run = _layout(spark, sf, "paths")
    io.write_csv(r, f"{run}/exp", partition_by=["exp", "dataset", "run"])
    io.write_csv(r, f"{run}/exp/batches", partition_by=["exp", "dataset", "run"])  # to be left out
    files = io.scan_dir(spark, f"{run}/exp", "csv", "*.csv", "metric double, model string, cot string, size int, frac double", "batches", header=True)
    cut = io.path_columns(files, "source_path", r"/exp=([^/]+)/dataset=([^/]+)/run=([^/]+)/[^/]*$", ["exp", "dataset", "run"])
    return rounded(cut.select("exp", "model", "dataset", "frac", "run", "metric"))
