"""Raw corpus shapes (FIXTURES.md §1) built from the driver tables as
nested columns, so the corpus adapters run on data that grows with the
scale factor. Split names deliberately use the raw spellings
(validation, val, trn, ...) that the adapters normalise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlab.functions.text import WS, strip_ws
from mixlab.sources.tables import Tables


def _pick(values, idx):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def fv_base(t: Tables) -> DataFrame:
    n = t.benchmark.select(F.count(F.lit(1))).scalar()
    b = t.benchmark.select(F.col("item_id").alias("_i"), F.col("text").alias("claim"))
    return t.documents.withColumn("_i", F.col("doc_id") % n).join(b, "_i").drop("_i")


def fever_raw(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    ev = F.transform(F.split("text", r"[.]"), lambda p, i: F.array(d.cast("string"), i.cast("string"), p))
    return fv_base(t).select(d.alias("id"), "claim", _pick(["SUPPORTS", "REFUTES", "NOT ENOUGH INFO"], d % 3).alias("label"),
                             ev.alias("evidence"), _pick(["train", "test", "validation"], F.floor(d / 3) % 3).alias("split"))


def factify_raw(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    cats = ["Support_Text", "Insufficient_Text", "Refute", "Insufficient_Multimodal", "Support_Multimodal"]
    return fv_base(t).select(d.alias("Id"), "claim", F.col("text").alias("document"), _pick(cats, d % 5).alias("Category"),
                             F.when(d % 4 == 0, F.lit("val")).otherwise(F.lit("train")).alias("split"))


def wanli_raw(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return fv_base(t).select(d.alias("id"), F.col("text").alias("premise"), F.col("claim").alias("hypothesis"),
                             _pick(["neutral", "contradiction", "entailment"], d % 3).alias("gold"), F.col("lang").alias("genre"),
                             F.when(d % 5 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"))


def scifact_raw(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    first = F.array_remove(F.split("text", WS, 7), "")  # the first five words need no split of the whole text
    return fv_base(t).select(d.alias("abstract_id"), F.array_join(F.slice(first, 1, 5), " ").alias("title"),
                             F.split("text", r"[.]").alias("abstract"), "claim",
                             _pick(["SUPPORT", "NEI", "CONTRADICT"], d % 3).alias("verdict"),
                             F.when(d % 4 == 1, F.lit("validation")).otherwise(F.lit("train")).alias("split"))


def qa_base(t: Tables) -> DataFrame:
    c = t.conversations
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    return u.join(a, ["conv_id", "turn"]).withColumn("pieces", F.split("context", r"[.]"))


def narrativeqa_raw(t: Tables) -> DataFrame:
    q = qa_base(t)
    doc = F.struct(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("kind"),
                   F.struct(F.col("context").alias("text")).alias("summary"))
    return q.select(doc.alias("document"), F.struct(F.col("question").alias("text")).alias("question"),
                    F.transform(F.slice("pieces", 1, 2), lambda p: F.struct(p.alias("text"))).alias("answers"),
                    _pick(["train", "validation", "test"], F.col("conv_id") % 3).alias("split"))


def coqa_raw(t: Tables) -> DataFrame:
    q = qa_base(t)
    return q.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), F.col("context").alias("story"),
                    F.array("question").alias("questions"), F.struct(F.slice("pieces", 1, 2).alias("input_text")).alias("answers"),
                    F.when(F.col("conv_id") % 4 == 0, F.lit("validation")).otherwise(F.lit("train")).alias("split"))


def fairytaleqa_raw(t: Tables) -> DataFrame:
    q = qa_base(t)
    return q.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), F.col("context").alias("content"), "question",
                    F.get("pieces", 0).alias("answer"), F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("attribute"),
                    _pick(["train", "validation", "test"], F.col("conv_id") % 3).alias("split"))


def qaconv_raw(t: Tables) -> tuple[DataFrame, DataFrame]:
    q = qa_base(t)
    recs = q.select(F.concat(F.lit("seg"), F.col("conv_id").cast("string")).alias("article_segment_id"), "question",
                    F.filter(F.slice("pieces", 1, 2), lambda x: strip_ws(x) != "").alias("answers"),
                    F.concat(F.lit("q"), F.col("turn").cast("string")).alias("QG"),
                    _pick(["trn", "tst", "val"], F.col("conv_id") % 3).alias("split"))
    seg = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text"))).alias("_d"))
    seg = seg.select(F.concat(F.lit("seg"), F.col("conv_id").cast("string")).alias("article_segment_id"),
                     F.transform("_d", lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"))).alias("seg_dialog"))
    return recs, seg


def ropes_raw(t: Tables) -> DataFrame:
    # every piece that is not blank is used: the first, those between, the last
    q = qa_base(t).withColumn("p", F.filter("pieces", lambda x: strip_ws(x) != ""))
    between = F.array_join(F.slice("p", 2, F.greatest(F.size("p") - 2, F.lit(0))), ".")
    return q.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), F.get("p", F.lit(0)).alias("background"),
                    between.alias("situation"), "question",
                    F.struct(F.when(F.size("p") >= 3, F.slice("p", -1, 1)).otherwise(F.slice("p", 1, 0)).alias("text")).alias("answers"),
                    F.when(F.col("conv_id") % 4 == 0, F.lit("validation")).otherwise(F.lit("train")).alias("split"))
