"""Corpus adapters (C1-C9): raw corpus shape -> canonical qa / fv records.

Each adapter is a ``DataFrame -> DataFrame`` function registered by name
(the reference adds a corpus by writing a new processing function). Inputs
carry a raw ``split`` column; outputs carry the normalised ``split``
(S11), an explicit ``context_id`` (never row position) and the canonical
columns. Shuffled 80/20 splits and fractional samples use the exact
bucketed rank over the md5 key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlab.functions.keys import DEFAULT_SEED, exact_rank, frac_count, order_key
from mixlab.operators.cleaning import (FACTIFY_LABELS, FEVER_LABELS, SCIFACT_LABELS, WANLI_LABELS, drop_any_null,
                                       drop_blank, drop_sentinel, map_value, normalize_split)
from mixlab.operators.sampling import first_seen_id
from mixlab.operators.sequences import dialogue_rollup

QA_COLUMNS = ["dataset_name", "split", "task", "question", "answer", "context", "context_id", "meta"]
FV_COLUMNS = ["dataset_name", "split", "task", "context", "context_id", "claim", "label", "meta"]
# Fever keeps 30 % of its training split; holdout share of shuffled splits.
FEVER_TRAIN_FRAC = 0.3
VALID_FRAC = 0.2

ADAPTERS: dict[str, Callable[..., DataFrame]] = {}


def adapter(name: str):
    def deco(fn):
        ADAPTERS[name] = fn
        return fn
    return deco


def _fv(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("dataset_name", F.lit(name)).withColumn("task", F.lit("fv")).select(*FV_COLUMNS)


def _qa(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("dataset_name", F.lit(name)).withColumn("task", F.lit("qa")).select(*QA_COLUMNS)


def _reshuffle_train(df: DataFrame, seed: int = DEFAULT_SEED, valid_frac: float = VALID_FRAC) -> DataFrame:
    """Shuffle the train split and cut it at int(n*(1-f)) into train / valid."""
    tr = exact_rank(df.filter(F.col("split") == "train"), order_key("context_id", seed), tiebreak=["context_id"],
                    name="_r", size_name="_n")
    cut = F.floor(F.col("_n").cast("double") * F.lit(1.0 - valid_frac))
    tr = tr.withColumn("split", F.when(F.col("_r") <= cut, F.lit("train")).otherwise(F.lit("valid"))).drop("_r", "_n")
    return tr.unionByName(df.filter(F.col("split") != "train"))


def _first(arr: Column) -> Column:
    return F.get(arr, 0)


@adapter("fever")
def fever(raw: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """Evidence text = third element of each triple, bracket tokens
    restored, joined by newlines; SUPPORTS -> 1 else 0; train kept at 30 %."""
    ctx = F.array_join(F.transform("evidence", lambda e: F.replace(F.replace(F.get(e, 2), F.lit("-LRB-"), F.lit("(")),
                                                                   F.lit("-RRB-"), F.lit(")"))), "\n")
    d = raw.select(normalize_split("split").alias("split"), "claim", ctx.alias("context"),
                   F.col("id").cast("string").alias("context_id"), map_value("label", FEVER_LABELS).alias("label"),
                   F.lit(None).cast("string").alias("meta"))
    d = drop_blank(d, ["context", "claim"])
    tr = exact_rank(d.filter(F.col("split") == "train"), order_key("context_id", seed), tiebreak=["context_id"],
                    name="_r", size_name="_n")
    tr = tr.filter(F.col("_r") <= frac_count(F.col("_n"), FEVER_TRAIN_FRAC, "half_even")).drop("_r", "_n")
    return _fv(tr.unionByName(d.filter(F.col("split") != "train")), "fever")


@adapter("narrativeqa")
def narrativeqa(raw: DataFrame) -> DataFrame:
    """Summary as context, first answer, document kind as meta; rows with any NULL dropped."""
    d = raw.select(normalize_split("split").alias("split"), F.col("question.text").alias("question"),
                   _first(F.col("answers"))["text"].alias("answer"), F.col("document.summary.text").alias("context"),
                   F.col("document.id").alias("context_id"), F.col("document.kind").alias("meta"))
    return _qa(drop_any_null(drop_blank(d, ["context", "question", "answer"])), "narrativeqa")


@adapter("coqa")
def coqa(raw: DataFrame) -> DataFrame:
    """First question and first answer; validation is the test split."""
    sp = F.when(F.col("split") == "validation", F.lit("test")).otherwise(normalize_split("split"))
    d = raw.select(sp.alias("split"), _first(F.col("questions")).alias("question"),
                   _first(F.col("answers.input_text")).alias("answer"), F.col("story").alias("context"),
                   F.col("id").cast("string").alias("context_id"), F.lit(None).cast("string").alias("meta"))
    return _qa(drop_blank(d, ["context", "question", "answer"]), "coqa")


@adapter("fairytaleqa")
def fairytaleqa(raw: DataFrame) -> DataFrame:
    """C4: context id = order of first appearance of the story in its split."""
    d = raw.select(normalize_split("split").alias("split"), "id", "question", "answer", F.col("content").alias("context"),
                   F.col("attribute").alias("meta"))
    parts = []
    for s in ("train", "valid", "test"):
        part = first_seen_id(d.filter(F.col("split") == s), "context", "id", "_cid")
        parts.append(part.withColumn("context_id", F.col("_cid").cast("string")).drop("_cid"))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return _qa(drop_blank(out, ["context", "question", "answer"]), "fairytaleqa")


@adapter("factify")
def factify(raw: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """Five categories -> {1, 0, -1}; -1 dropped (NULL kept); val is the
    test split; train reshuffled 80/20 into train / valid."""
    sp = F.when(F.col("split") == "val", F.lit("test")).otherwise(normalize_split("split"))
    d = raw.select(sp.alias("split"), F.col("document").alias("context"), F.col("Id").cast("string").alias("context_id"),
                   "claim", map_value("Category", FACTIFY_LABELS).alias("label"), F.lit(None).cast("string").alias("meta"))
    d = drop_blank(drop_sentinel(d), ["context", "claim"])
    return _fv(_reshuffle_train(d, seed), "factify")


@adapter("wanli")
def wanli(raw: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """Premise / hypothesis, three labels -> {1, 0}, genre as meta; train 80/20."""
    d = raw.select(normalize_split("split").alias("split"), F.col("premise").alias("context"),
                   F.col("id").cast("string").alias("context_id"), F.col("hypothesis").alias("claim"),
                   map_value("gold", WANLI_LABELS).alias("label"), F.col("genre").alias("meta"))
    return _fv(_reshuffle_train(drop_blank(d, ["context", "claim"]), seed), "wanli")


@adapter("qaconv")
def qaconv(raw: DataFrame, segments: DataFrame) -> DataFrame:
    """context = 'speaker: text|' per dialogue turn of the record's
    segment (lookup join; a missing segment drops the row); first answer."""
    turns = segments.select("article_segment_id", F.posexplode("seg_dialog").alias("pos", "t")).select(
        "article_segment_id", "pos", F.col("t.speaker").alias("speaker"), F.col("t.text").alias("text"))
    ctx = dialogue_rollup(turns, "article_segment_id", "pos", "speaker", "text")
    d = raw.filter(F.size("answers") > 0).join(ctx, "article_segment_id", "left")
    d = d.select(normalize_split("split").alias("split"), "question", _first(F.col("answers")).alias("answer"), "context",
                 F.col("article_segment_id").alias("context_id"), F.col("QG").alias("meta"))
    return _qa(drop_blank(d, ["context", "question", "answer"]), "qaconv")


@adapter("ropes")
def ropes(raw: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """Empty answers dropped; context = background + newline + situation
    (NULL part -> NULL -> dropped); validation is the test split; train 80/20."""
    sp = F.when(F.col("split") == "validation", F.lit("test")).otherwise(normalize_split("split"))
    d = raw.filter(F.size("answers.text") > 0).select(
        sp.alias("split"), "question", _first(F.col("answers.text")).alias("answer"),
        F.concat(F.col("background"), F.lit("\n"), F.col("situation")).alias("context"),
        F.col("id").cast("string").alias("context_id"), F.lit(None).cast("string").alias("meta"))
    return _qa(_reshuffle_train(drop_blank(d, ["context", "question", "answer"]), seed), "ropes")


@adapter("scifact")
def scifact(raw: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """context = title + ' ' + abstract sentences joined by spaces;
    SUPPORT -> 1 else 0; train 80/20; validation is the test split."""
    sp = F.when(F.col("split") == "validation", F.lit("test")).otherwise(normalize_split("split"))
    d = raw.select(sp.alias("split"), F.concat(F.col("title"), F.lit(" "), F.array_join("abstract", " ")).alias("context"),
                   F.col("abstract_id").cast("string").alias("context_id"), "claim",
                   map_value("verdict", SCIFACT_LABELS).alias("label"), F.lit(None).cast("string").alias("meta"))
    return _fv(_reshuffle_train(drop_blank(d, ["context", "claim"]), seed), "scifact")
