"""Sources and sinks (S1-S11) with explicit schemas.

CSV / JSON are read with a fixed ``StructType`` (no inference pass over the
data); contexts hold newlines and quotes, so CSV uses multiLine + quote
escaping. The default sink is parquet; experiment layouts are written with
``partitionBy`` so readers prune partitions by path.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, null_value: str | None = None) -> DataFrame:
    """Header CSV with embedded newlines and doubled quotes. An empty field is NULL, unless ``null_value`` is
    what stands for NULL in the file."""
    r = (spark.read.schema(schema).option("header", True).option("multiLine", True)
         .option("escape", '"').option("quote", '"'))
    if null_value is not None:
        r = r.option("nullValue", null_value).option("lineSep", "\n")
    return r.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = (),
              null_value: str | None = None) -> None:
    """Header CSV without an index column; blanks around a text stay. With ``null_value`` in place of
    NULL all fields are quoted and empty texts come back as such."""
    w = df.write.mode(mode).option("header", True).option("escape", '"').option("quote", '"')
    w = w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if null_value is not None:
        w = w.option("nullValue", null_value).option("quoteAll", True).option("lineSep", "\n")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """S3: JSON lines with a fixed schema."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """JSON lines (one folder per partition value, e.g. request batch)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def read_keyed_json(spark: SparkSession, path: str, value_schema: str, key: str = "key", by_line: bool = False) -> DataFrame:
    """JSON documents mapping id -> record, exploded to rows. Each file is one record of the
    text source (wholetext); files parallelise. ``by_line``: documents with an entry a line are read
    line by line, so that one large document is split over tasks."""
    doc = spark.read.text(path, wholetext=not by_line)
    if by_line:
        entry = F.rtrim(F.rtrim(F.trim("value"), F.lit(",")))
        doc = doc.select(F.concat(F.lit("{"), entry, F.lit("}")).alias("value")).where(F.length("value") > 4)
    m = F.from_json(F.col("value"), f"map<string,{value_schema}>")
    return doc.select(F.explode(m).alias(key, "v")).select(key, "v.*")


def scan_dir(spark: SparkSession, root: str, fmt: str = "csv", glob: str | None = None, schema=None,
             skip_dir: str | None = None, **options) -> DataFrame:
    """One scan over many files (recursive), keeping each row's source
    path; a named sub-folder can be skipped by a path filter."""
    r = spark.read.format(fmt).option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if schema is not None:
        r = r.schema(schema)
    for k, v in options.items():
        r = r.option(k, v)
    path = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))  # a plain + is no blank in a path
    df = r.load(root).withColumn("source_path", F.url_decode(path))
    if skip_dir:
        df = df.filter(~F.col("source_path").contains(f"/{skip_dir}/"))
    return df


def path_columns(df: DataFrame, path_col: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """Columns cut out of the file path by a regex with one group per name."""
    return df.withColumns({n: F.regexp_extract(F.col(path_col), pattern, i + 1) for i, n in enumerate(names)})


def write_layout(df: DataFrame, path: str, partition_by: Sequence[str], mode: str = "errorifexists") -> None:
    """Partitioned experiment layout, e.g. exp/model/cot/dataset/size/frac/run."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def scan_layout(spark: SparkSession, path: str, schema: StructType | str, names: DataFrame, key: str) -> DataFrame:
    """The rows of a partitioned layout whose partition column ``key`` is in the (filtered) table ``names``, with its
    columns. Folders come from partition discovery; if ``names`` is small enough for the engine to broadcast it, its keys also
    choose the folders to read at run time (dynamic partition pruning)."""
    return spark.read.schema(schema).parquet(path).join(names, key)


def guard_paths(input_path: str, output_path: str, rewrite: bool = False) -> None:
    """Refuse to overwrite the input unless asked."""
    if os.path.abspath(input_path) == os.path.abspath(output_path) and not rewrite:
        raise ValueError("input and output are the same file; pass rewrite=True to overwrite it")


def guard_new_column(df: DataFrame, column: str, overwrite: bool = False) -> None:
    """Refuse to add a prediction column that already exists."""
    if column in df.columns and not overwrite:
        raise ValueError(f"column {column!r} already present; refusing to overwrite it")


# Candidate input / output column names, in order of preference.
INPUT_CANDIDATES = ["text", "sentence", "input"]
OUTPUT_CANDIDATES = ["label", "target", "output"]


def infer_io_columns(df: DataFrame, strict: bool = True) -> tuple[str, str | None]:
    """P10: pick the input and output columns from the schema. strict: more
    than one candidate -> error, no input -> error, no output -> None
    (warning); non-strict: first match wins."""
    cols = df.columns
    ins = [c for c in INPUT_CANDIDATES if c in cols]
    outs = [c for c in OUTPUT_CANDIDATES if c in cols]
    if not ins:
        raise ValueError(f"no input column among {INPUT_CANDIDATES}")
    if strict and (len(ins) > 1 or len(outs) > 1):
        raise ValueError(f"ambiguous columns: inputs {ins}, outputs {outs}")
    return ins[0], (outs[0] if outs else None)


def to_text_label(df: DataFrame, strict: bool = True) -> DataFrame:
    """P10: rename the inferred columns to ``text`` / ``label``."""
    i, o = infer_io_columns(df, strict)
    out = df.withColumnRenamed(i, "text") if i != "text" else df
    if o and o != "label":
        out = out.withColumnRenamed(o, "label")
    return out
