"""Benchmark decontamination by spaced seeds (operator 8, DataFrame functions only).

A seed is the hash of the words at the positions a fixed mask selects; the positions between are
ignored. The two masks are such that any ``WINDOW`` aligned words with at most ``MAX_SUBSTITUTIONS``
substitutions hold a hit of one of them wherever the substitutions fall. Hits of documents and benchmark
are joined on the hash, grouped by (document, item, alignment), and every window of the alignment
that covers a hit is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlab.llm.common import prepare, row_key, saved

#: Fixed masks of weight 6: positions that take part in the hash.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW = 13
MAX_SUBSTITUTIONS = 2
#: Benchmark seeds that may be broadcast (16 bytes each and the table around them); beyond, both sides are shuffled.
BROADCAST_SEEDS = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _seeds(hashes: str) -> Column:
    """Seeds of all positions, mask after mask, as (position, seed)."""
    spans = [m[-1] + 1 for m in MASKS]
    parts = []
    for k, (mask, span) in enumerate(zip(MASKS, spans)):
        taken = ", ".join(f"{hashes}[i + {o}]" for o in mask)
        parts.append(f"if(size({hashes}) < {span}, array(), transform(sequence(0, size({hashes}) - {span}), i -> xxhash64({k}, {taken})))")
    return F.expr(f"array({', '.join(parts)})")


def _seed_rows(texts: DataFrame, key: str) -> DataFrame:
    """(key, pos, seed) for every position and mask of (key, text)."""
    hashed = texts.select(key, F.explode(F.array(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))).alias("h"))
    by_mask = hashed.select(key, F.explode(_seeds("h")).alias("seeds"))
    return by_mask.select(key, F.posexplode("seeds").alias("pos", "seed"))


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", null_ids: bool = False) -> DataFrame:
    """The rows of ``contaminated`` with the key of the document's row (``row_key``)."""
    prepare(docs.sparkSession)
    if not null_ids:
        docs = docs.where(F.col(id_col).isNotNull())
    docs = docs.select(row_key(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where(F.col(item_col).isNotNull())
    seeds = saved(_seed_rows(items, "item_id").select("item_id", F.col("pos").alias("item_pos"), "seed"), "seeds")
    few = seeds.count() <= BROADCAST_SEEDS
    distinct = seeds.select("seed").distinct()
    rows = _seed_rows(docs, "row")
    # first which positions hit at all: a very frequent seed of the benchmark multiplies only hits
    hits = rows.join(F.broadcast(distinct) if few else distinct, "seed", "left_semi")
    hits = hits.join(F.broadcast(seeds) if few else seeds, "seed")
    # a window covers every hit of its alignment that lies within it, so hits are counted per alignment
    aligned = hits.groupBy("row", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.count("*").alias("n_hits"))
    aligned = saved(aligned, "alignments")

    touched = aligned.select("row").distinct()
    doc_words = docs.join(touched, "row", "left_semi").dropDuplicates(["row"]).select("row", "doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("dw"))
    item_words = items.select("item_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("iw"))
    item_words = F.broadcast(item_words) if few else item_words
    # words of the item that lie on the document, and the document's words beside them
    pairs = aligned.join(item_words, "item_id").join(doc_words, "row")
    pairs = pairs.withColumn("first", F.expr("greatest(0, -shift)")).withColumn("n", F.expr("least(size(iw), size(dw) - shift) - first")).where(f"n >= {WINDOW}")
    equal = F.expr("transform(sequence(0, n - 1), k -> if(iw[first + k] = dw[first + shift + k], 1, 0))")
    pairs = pairs.select("row", "doc_id", "item_id", "shift", "first", "n", F.explode(F.array(equal)).alias("eq"))
    windows = F.expr(f"transform(sequence(0, n - {WINDOW}), k -> aggregate(slice(eq, k + 1, {WINDOW}), 0, (a, x) -> a + x))")
    found = pairs.select("row", "doc_id", "item_id", "shift", "first", F.explode(F.array(windows)).alias("m"))
    least = WINDOW - MAX_SUBSTITUTIONS
    found = found.select("row", "doc_id", "item_id", "shift", "first", F.array_max("m").alias("best"), "m", F.expr(f"size(filter(m, x -> x >= {least}))").alias("n_windows")).where(f"best >= {least}")
    at = F.col("first") + F.array_position("m", F.col("best")).cast("int") - 1
    best = F.min_by(F.struct((at + F.col("shift")).alias("doc_pos"), at.alias("item_pos")), F.struct(-F.col("best"), at + F.col("shift"), at))
    out = found.groupBy("row", "doc_id", "item_id").agg(F.max("best").cast("long").alias("window_matches"), F.sum("n_windows").alias("n_windows"), best.alias("at"))
    return out.select("row", "doc_id", "item_id", F.col("at.doc_pos").cast("long").alias("doc_pos"), F.col("at.item_pos").cast("long").alias("item_pos"), "window_matches", "n_windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, doc_pos, item_pos, window_matches, n_windows.

    An overlap is a window of ``WINDOW`` aligned words with at most ``MAX_SUBSTITUTIONS`` different ones;
    the row gives the number of such windows, and the first of the best one. Items and documents of fewer than
    ``WINDOW`` words, nulls and empty texts never overlap. Rows of one id are judged each by its own text; those of
    the same text count once. Rows without an id are left out, or reported with a null id under ``null_ids``.
    """
    return _overlaps(docs, benchmark, **options).drop("row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without an overlap, with all their columns. Each row is judged by its own text; rows without an
    id stay unless ``null_ids`` has them judged too."""
    found = _overlaps(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("row").alias("_found")).distinct()
    return docs.join(found, row_key(id_col, text_col) == F.col("_found"), "left_anti")
