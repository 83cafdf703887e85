"""Enrichment of generated / predicted tables (E3, P11) and the reports
built on them (X1-X3). One best-sentence pass scores every text variant
in its row, and so does the score of a prediction: rows are shuffled once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlab.functions.text import normalize, normalize_prediction, question_word, word_count
from mixlab.operators.cleaning import unpack_fv, unpack_qa
from mixlab.operators.sampling import sort_by_score
from mixlab.operators.score import best_sentence, bleu_pairs
from mixlab.operators.stats import describe


def infer_task(df: DataFrame) -> str:
    """The value of the ``task`` column if there is one (the first row that has it is
    read), else from the schema: answer -> qa, claim -> fv, numeric label -> fv, else qa."""
    cols = set(df.columns)
    if "task" in cols:
        row = df.select("task").filter(F.col("task").isNotNull()).first()
        if row is not None:
            return row["task"]
    if "answer" in cols:
        return "qa"
    if "claim" in cols:
        return "fv"
    if "label" in cols:
        from pyspark.sql.types import NumericType

        return "fv" if isinstance(df.schema["label"].dataType, NumericType) else "qa"
    raise ValueError(f"no label column and no claim or answer column in {sorted(cols)}")


def enrich(df: DataFrame, task: str | None = None, id_col: str = "id") -> DataFrame:
    """Normalised texts, best-evidence features for every text variant,
    question words (qa), and the per-row score when predictions exist."""
    task = task or infer_task(df)
    text = "question" if task == "qa" else "claim"
    if text not in df.columns and "text" in df.columns:  # a prediction file: P12 first
        if task == "qa":
            parts = dict(zip(("context", "question", "answer"), unpack_qa("text", "input")))
        else:
            parts = dict(zip(("context", "claim"), unpack_fv("text")))
        df = df.withColumns(parts)
    cols = set(df.columns)
    d = df.withColumn("context", normalize("context"))
    lowered = [text] + ([f"syn_{text}"] if f"syn_{text}" in cols else [])
    if task == "qa":
        lowered += ["answer"] + (["syn_answer"] if "syn_answer" in cols else [])
    d = d.withColumns({c: normalize(c) for c in lowered})
    has_pred = "prediction" in cols
    if task == "qa" and has_pred:
        d = d.withColumn("prediction", normalize_prediction("prediction"))  # before locations (Q13)
    variants = {c: c for c in lowered}
    if task == "qa" and has_pred:
        variants["prediction"] = "prediction"
    # rows without an id are left out; scores are columns of their row, so no join of rows to their scores is needed
    d = d.where(F.col(id_col).isNotNull())
    out = best_sentence(d, variants, "context", id_col, wide=True)
    ren = {}
    if task == "qa":
        for v in [text] + ([f"syn_{text}"] if f"syn_{text}" in cols else []):
            ren[f"{v}_best_bleu"] = f"{v}_best_bleu_w_context"
        for v, p in [("answer", "answer"), ("syn_answer", "syn_answer"), ("prediction", "pred")]:
            if v in variants:  # Q2: the prediction's own location
                ren[f"{v}_best_bleu"] = f"{p}_location_bleu"
                ren[f"{v}_location"] = f"{p}_location"
                ren[f"{v}_location_ratio"] = f"{p}_location_ratio"
        out = out.withColumn("question_word", question_word("question"))
        if "syn_question" in cols:
            out = out.withColumn("syn_question_word", question_word("syn_question"))
    else:
        for v in variants:
            ren[f"{v}_best_bleu"] = f"{v}_best_bleu_w_context"
    out = out.withColumnsRenamed(ren)
    drop = [c for c in out.columns if c.startswith(("question_location", "syn_question_location"))]
    out = out.drop(*drop)
    out = out.withColumn("task", F.lit(task))
    if has_pred:
        if task == "qa":
            out = bleu_pairs(out, "answer", "prediction", id_col, wide=True).withColumnRenamed("bleu", "score")
        else:
            out = out.withColumn("score", 1 - F.abs(F.col("label") - F.col("prediction")))
    return out


def enrich_predictions(df: DataFrame, task: str | None = None, id_col: str = "id") -> DataFrame:
    """E3 on a prediction file (id, text, label, input, prediction): task (P11), unpacked texts (P12),
    features, and the rows in order of falling score (W1)."""
    scored = enrich(df, task, id_col)
    # a sort looks at its input twice, first for the bounds: behind a shuffle of the results the scores are made once
    return sort_by_score(scored.repartition(F.xxhash64(id_col)), "score", id_col)


def corpus_profile(df: DataFrame, by: str = "dataset_name") -> DataFrame:
    """Rows and share per dataset, mean/sum of text lengths and labels,
    and label agreement of generated rows -- one grouped aggregate."""
    lens = {c: word_count(c) for c in ("context", "claim", "syn_claim")}
    d = df.withColumns({f"{c}_words": e for c, e in lens.items()})
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in [*[f"{c}_words" for c in lens], "label", "syn_label"]:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.sum(c).alias(f"{c}_sum")]
    aggs.append(F.avg((F.col("label") == F.col("syn_label")).cast("double")).alias("label_agreement"))
    g = d.groupBy(by).agg(*aggs)
    total = g.select(F.sum("n")).scalar()
    return g.withColumn("share", F.col("n") / total)


def generated_report(enriched: DataFrame, text: str = "claim", features: Sequence[str] | None = None) -> DataFrame:
    """Describe of paired human / generated features (melted, one grouped job)."""
    feats = features or ["words", "best_bleu_w_context", "location_ratio"]
    d = enriched.withColumn(f"{text}_words", word_count(text)).withColumn(f"syn_{text}_words", word_count(f"syn_{text}"))
    rows = []
    for f in feats:
        rows.append(F.struct(F.lit(f).alias("feature"), F.lit("human").alias("origin"),
                             F.col(f"{text}_{f}").cast("double").alias("value")))
        rows.append(F.struct(F.lit(f).alias("feature"), F.lit("generated").alias("origin"),
                             F.col(f"syn_{text}_{f}").cast("double").alias("value")))
    long = d.select(F.inline(F.array(*rows)))
    return describe(long, "value", by=["feature", "origin"])


def prediction_report(enriched: DataFrame, features: Sequence[str], id_col: str = "id", frac: float = 0.25) -> DataFrame:
    """Top vs bottom quartile by score: describe of each feature per cohort."""
    from mixlab.operators.stats import quartile_contrast

    q = quartile_contrast(enriched, "score", id_col, frac)
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    long = q.select("cohort", F.inline(F.array(*rows)))
    return describe(long, "value", by=["cohort", "feature"])
