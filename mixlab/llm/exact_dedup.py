"""Exact duplicates with a heavy-hitter split (operator 2, DataFrame functions only).

A Misra-Gries summary (``freqItems``, built per partition and merged) names every digest that may
hold more than ``support`` of all rows. Those candidates are counted exactly; the digests that really
pass the bound, at most ``1 / support`` of them, are broadcast, and their rows are settled
map-side without a shuffle. All other digests are shuffled; none has more than ``support`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlab.llm.common import saved

#: Share of all rows from which a digest counts as heavy: at most 1 / SUPPORT digests are broadcast.
SUPPORT = 0.001
BLANKS = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays. Rows without an id come after all others; of
    repeated rows (same id, same text) exactly one is kept. An empty table gives no rows.
    """
    norm = normalised(F.col(text_col))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(norm, 256)).alias("sha"))
    rows = saved(narrow.withColumn("tag", F.monotonically_increasing_id()), "dedup")
    n = rows.count()
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")

    frequent = rows.select(F.xxhash64("sha").alias("digest")).stat.freqItems(["digest"], support)
    candidates = frequent.select(F.explode("digest_freqItems").alias("digest"))
    counted = rows.join(F.broadcast(candidates), F.xxhash64("sha") == F.col("digest"), "left_semi")
    counted = counted.groupBy("sha").agg(F.count("*").alias("group_size"), F.min(order).alias("first"))
    winners = saved(counted.where(F.col("group_size") > F.lit(support * n)), "winners")  # at most 1 / support rows

    heavy = rows.join(F.broadcast(winners), "sha").withColumn("kept", F.col("tag") == F.col("first.tag"))
    heavy = heavy.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", "kept", "sha")

    light = rows.join(F.broadcast(winners.select("sha")), "sha", "left_anti")
    group = Window.partitionBy("sha")
    light = light.withColumn("first", F.min(order).over(group)).withColumn("group_size", F.count("*").over(group))
    light = light.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("tag") == F.col("first.tag")).alias("kept"), "sha")

    return heavy.unionAll(light).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows that stay, with all their columns."""
    marks = mark_duplicates(docs, id_col, text_col, support).where("kept").select(F.col("doc_id").alias("_keep_id"), "text_sha256")
    sha = F.sha2(normalised(F.col(text_col)), 256)
    stay = docs.withColumn("_sha", sha).join(marks, F.col(id_col).eqNullSafe(F.col("_keep_id")) & (F.col("_sha") == F.col("text_sha256")), "left_semi")
    return stay.dropDuplicates([id_col, "_sha"]).drop("_sha")
