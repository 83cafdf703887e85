"""Projection, filtering and cleaning operators.

All are narrow transformations (no shuffle) built from column expressions,
so Catalyst pushes their filters into the scan and prunes unused columns.
Label and split maps are literal ``map`` expressions: a handful of entries
evaluated inside whole-stage codegen, no join at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlab.functions.text import normalize, normalize_prediction, words

# Split-name normalisation of the reference.
SPLIT_MAP = {"train": "train", "validation": "valid", "test": "test", "valid": "valid", "dev": "valid",
             "val": "valid", "trn": "train", "tst": "test", "eval": "test"}
# Per-corpus label maps of the reference.
FEVER_LABELS = {"SUPPORTS": 1, "REFUTES": 0, "NOT ENOUGH INFO": 0}
WANLI_LABELS = {"neutral": 0, "contradiction": 0, "entailment": 1}
SCIFACT_LABELS = {"SUPPORT": 1, "NEI": 0, "CONTRADICT": 0}
FACTIFY_LABELS = {"Support_Text": 1, "Insufficient_Text": 0, "Refute": 0,
                  "Insufficient_Multimodal": -1, "Support_Multimodal": -1}


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])


def map_value(c: str | Column, mapping: dict) -> Column:
    """Lookup; unmapped (or NULL) -> NULL."""
    key = F.col(c) if isinstance(c, str) else c
    return F.try_element_at(literal_map(mapping), key)


def normalize_split(c: str | Column) -> Column:
    return map_value(c, SPLIT_MAP)


def drop_blank(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows NULL or blank (whitespace only) in any of ``cols``: the search ends at the first letter, no text is stripped."""
    cond = None
    for c in cols:
        ok = F.col(c).isNotNull() & F.col(c).rlike(r"\S")
        cond = ok if cond is None else cond & ok
    return df.filter(cond)


def drop_any_null(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """``dropna`` over all columns or a subset."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def drop_sentinel(df: DataFrame, label: str = "label", sentinel: int = -1) -> DataFrame:
    """P5: drop the sentinel label; NULL labels survive (as NaN != -1 does)."""
    return df.filter(F.col(label).isNull() | (F.col(label) != sentinel))


def first_nonempty(arr: Column) -> Column:
    """First element of a list (rows with an empty list are dropped by the caller)."""
    return F.get(arr, 0)


def paired_null_report(df: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row report) -- one pass, counts via count_if."""
    bad = F.col(a).isNull() | F.col(b).isNull()
    report = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_dropped"),
                    F.count_if(~bad).alias("n_kept"))
    return df.filter(~bad), report


def cast_label(df: DataFrame, c: str, to: str = "int", name: str = "label") -> DataFrame:
    """Typed label via ``try_cast``; rows that do not cast are flagged."""
    v = F.col(c).try_cast(to)
    return df.withColumn(name, v).withColumn("rejected", F.col(c).isNotNull() & v.isNull())


def unpack_fv(text: str | Column) -> tuple[Column, Column]:
    """P12 (fv): text = context || '|' || claim -> (context, claim)."""
    parts = F.split(F.col(text) if isinstance(text, str) else text, r"[|]")
    return (F.array_join(F.slice(parts, 1, F.size(parts) - 1), "|"), F.element_at(parts, -1))


def unpack_qa(text: str, inp: str) -> tuple[Column, Column, Column]:
    """P12 (qa): from ``input`` (context | question ANSWER: ) and ``text``
    (... ANSWER: answer |). The answer is read after stripping the trailing
    bar (the reference reads it before, so it always gets '' -- quirk Q1)."""
    ip = F.split(F.col(inp), r"[|]")
    context = F.array_join(F.slice(ip, 1, F.size(ip) - 1), "|")
    question = F.element_at(F.split(F.element_at(ip, -1), "ANSWER:"), 1)
    stripped = F.regexp_replace(F.col(text), r"^[|]+|[|]+\z", "")
    answer = F.element_at(F.split(F.element_at(F.split(stripped, r"[|]"), -1), "ANSWER:"), -1)
    return context, question, answer


def softmax(logits: str | Column) -> Column:
    """softmax over an array<double>, max subtracted first."""
    x = F.col(logits) if isinstance(logits, str) else logits
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / total)


def argmax(arr: str | Column) -> Column:
    """0-based index of the first maximum."""
    x = F.col(arr) if isinstance(arr, str) else arr
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def multi_hot(labels: str | Column, vocab: Column) -> Column:
    """array<double> with 1.0 where the vocabulary entry is in the list."""
    lab = F.col(labels) if isinstance(labels, str) else labels
    return F.transform(vocab, lambda v: F.when(F.array_contains(lab, v), F.lit(1.0)).otherwise(F.lit(0.0)))


def label_id(label: str | Column, vocab: list[str]) -> Column:
    """F15 (one label): its place in the vocabulary; the marker -1 stays -1, an unknown label is NULL."""
    lab = (F.col(label) if isinstance(label, str) else label).cast("string")
    place = F.array_position(F.array(*map(F.lit, vocab)), lab)
    return F.when(lab == "-1", F.lit(-1)).when(place > 0, (place - 1).cast("int"))


# Display names of the corpora.
DISPLAY_NAMES = {
    "factify": "Factify",
    "scifact": "SciFact",
    "wanli": "WANLI",
    "fever": "FEVER",
    "ropes": "ROPES",
    "qaconv": "QAConv",
    "coqa": "CoQA",
    "narrativeqa": "NarrativeQA",
    "fairytaleqa": "FairytaleQA",
}


def display_name(path: str | Column) -> Column:
    """F16: the display name of the first corpus (in the order above) whose key the path holds, else the path."""
    p = F.col(path) if isinstance(path, str) else path
    return F.coalesce(*[F.when(p.contains(k), F.lit(v)) for k, v in DISPLAY_NAMES.items()], p)


__all__ = ["DISPLAY_NAMES", "display_name", "label_id", "normalize", "normalize_prediction", "words"]
