"""Helpers shared by the corpus operators: shared folders, written tables, scans."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlab.session import checkpoint_dir

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Rows and bytes per Arrow batch in the operators that hand whole texts to Python: a batch has to fit a worker. A
#: longer text is a batch of its own.
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and make this package importable on the executors.

    The package is shipped once per context, and only when neither the working folder nor
    ``PYTHONPATH`` already leads to it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(PACKAGE)
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if root in known or os.path.abspath(os.getcwd()) == root or getattr(sc, "_mixlab_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="mixlab-code-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "mixlab"), "zip", root, os.path.basename(PACKAGE)))
    sc._mixlab_shipped = True


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder of this run below the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    Spark removes shuffle files once the driver has collected what refers to them, so a collection is asked for:
    those behind a written table are not kept until the driver happens to need memory.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of a SHA-256 over id and text, never null: tells rows apart that share an id or have none. Rows
    equal in both share a key, and it does not depend on the partitioning."""
    name = F.col(id_col).cast("string")
    tagged = F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), name), F.lit("-"))
    return F.unhex(F.substring(F.sha2(F.concat(tagged, F.coalesce(F.col(text_col), F.lit(""))), 256), 1, 32))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
