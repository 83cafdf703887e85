"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; between stages the rows are
written as Parquet to the shared folder and read again. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mixlab.llm import decontaminate, line_dedup, packing, simhash, toxicity
from mixlab.llm.common import prepare, read, saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents scored 0.3 or more go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: lines with a similar line before them go, and documents of which nothing is left."""
    return line_dedup.remove_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of near-duplicates the document of the smallest id stays."""
    prepare(spark)
    return simhash.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that overlap a benchmark item go, with or without an id."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), null_ids=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Tokenizing, training and the similarity stages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
