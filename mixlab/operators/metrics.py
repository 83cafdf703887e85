"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlab.functions.selection import quantiles
from mixlab.functions.text import contains_text, normalize, normalize_prediction
from mixlab.operators.score import bleu_pairs, rouge1_pairs


def _binary_f1(tp: Column, fp: Column, fn: Column) -> Column:
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    return F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))


def threshold_metrics(df: DataFrame, label: str = "label", score: str = "output") -> DataFrame:
    """Accuracy and macro-F1 at thresholds 0.5, mean and median of the
    score; prediction = score > threshold (strict); zero-division guards -> 0.
    Thresholds are scalar subqueries; all confusion counts for all
    thresholds come from one aggregate (no row replication)."""
    stats = quantiles(df, score, [0.5], extra=[F.avg("v").alias("mean")])
    ths = [("0.5", F.lit(0.5)), ("mean", stats.select("mean").scalar()), ("median", stats.select(F.get("q", F.lit(0))).scalar())]
    y = F.col(label).cast("int")
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (_, t) in enumerate(ths):
        pred = (F.col(score) > t).cast("int")
        aggs += [F.count_if(pred == y).alias(f"c{i}"), F.count_if((pred == 1) & (y == 1)).alias(f"tp{i}"),
                 F.count_if((pred == 1) & (y == 0)).alias(f"fp{i}"), F.count_if((pred == 0) & (y == 0)).alias(f"tn{i}"),
                 F.count_if((pred == 0) & (y == 1)).alias(f"fn{i}")]
    c = df.agg(*aggs)
    rows = []
    for i, (name, t) in enumerate(ths):
        tp, fp, tn, fn = (F.col(f"{x}{i}").cast("double") for x in ("tp", "fp", "tn", "fn"))
        macro = (_binary_f1(tp, fp, fn) + _binary_f1(tn, fn, fp)) / 2
        rows.append(F.struct(F.lit(name).alias("threshold_name"), t.cast("double").alias("threshold"),
                             (F.col(f"c{i}") / F.col("n")).alias("accuracy"), macro.alias("macro_f1")))
    return c.select(F.inline(F.array(*rows)))


def qa_metrics(df: DataFrame, target: str = "answer", output: str = "prediction", id_col: str = "id") -> DataFrame:
    """One row -- rows dropped for NULLs, exact match, inclusion, reverse
    inclusion, BLEU and ROUGE-1 means over normalised (target, output) pairs."""
    kept = df.filter(F.col(target).isNotNull() & F.col(output).isNotNull())
    # BLEU and ROUGE-1 depend on the texts alone: equal pairs are scored once and weighted
    pairs = kept.groupBy(normalize(target).alias("ref"), normalize_prediction(output).alias("pred")).agg(
        F.count(F.lit(1)).alias("_w"))
    pairs = pairs.withColumn("pair_id", F.md5(F.concat_ws("\x01", F.col("ref"), F.lit(""), F.col("pred"))))
    b = bleu_pairs(pairs)
    r = rouge1_pairs(pairs)
    j = pairs.join(b, "pair_id").join(r, "pair_id")

    def mean(c):
        return F.sum(c * F.col("_w")) / F.sum("_w")

    n_all = df.select(F.count(F.lit(1))).scalar()
    return j.agg(
        (n_all - F.coalesce(F.sum("_w"), F.lit(0))).alias("dropped"),
        mean((F.col("ref") == F.col("pred")).cast("double")).alias("exact_match"),
        mean(contains_text("pred", "ref").cast("double")).alias("inclusion"),
        mean(contains_text("ref", "pred").cast("double")).alias("reverse_inclusion"),
        mean(F.col("bleu")).alias("bleu"), mean(F.col("rouge1")).alias("rouge1"))


def clf_metrics(df: DataFrame, label: str, prob: str, threshold: float = 0.5) -> DataFrame:
    """A18 (binary): accuracy, precision, recall, F1 of prob > threshold, MSE
    of the probability (lower is better, so not part of it), and
    combined_score = mean of the other four."""
    pred = (F.col(prob) > threshold).cast("int")
    y = F.col(label).cast("int")
    c = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(pred == y).alias("correct"),
               F.count_if((pred == 1) & (y == 1)).alias("tp"), F.count_if((pred == 1) & (y == 0)).alias("fp"),
               F.count_if((pred == 0) & (y == 1)).alias("fn"),
               F.avg(F.pow(F.col(prob) - y, 2)).alias("mse"))
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    out = c.select((F.col("correct") / F.col("n")).alias("accuracy"), prec.alias("precision"),
                   rec.alias("recall"), _binary_f1(tp, fp, fn).alias("f1"), F.col("mse"))
    return out.withColumn("combined_score", (F.col("accuracy") + F.col("precision") + F.col("recall")
                                              + F.col("f1")) / 4)


def multilabel_micro_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """A18 (multi-label): micro-F1 over all cells of two multi-hot arrays."""
    z = F.arrays_zip(F.col(truth).alias("t"), F.col(pred).alias("p"))
    cells = df.select(F.inline(z))
    c = cells.agg(F.count_if((F.col("t") == 1) & (F.col("p") == 1)).alias("tp"),
                  F.count_if((F.col("t") == 0) & (F.col("p") == 1)).alias("fp"),
                  F.count_if((F.col("t") == 1) & (F.col("p") == 0)).alias("fn"))
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    return c.select(F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("micro_f1"),
                    "tp", "fp", "fn")


def token_accuracy(df: DataFrame, labels: str, preds: str, ignore: int = -100) -> DataFrame:
    """Shifted token accuracy -- prediction at t against label at t+1;
    ``acc_all`` counts masked (-100) labels as wrong, ``acc_masked`` skips them."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(labels) - 1),
                        lambda i: F.struct(F.get(F.col(preds), i - 1).alias("p"), F.get(F.col(labels), i).alias("l")))
    cells = df.filter(F.size(labels) > 1).select(F.inline(pairs))
    hit = (F.col("p") == F.col("l")).cast("double")
    return cells.agg(F.avg(hit).alias("acc_all"),
                     F.avg(F.when(F.col("l") != ignore, hit)).alias("acc_masked"),
                     F.count(F.lit(1)).alias("n_tokens"))


def perplexity(df: DataFrame, loss: str, gen_tokens: str | None = None, pad: int = 0) -> DataFrame:
    """perplexity = exp(mean loss) (overflow -> +inf), mean generated
    length without padding."""
    m = F.avg(loss)
    aggs = [m.alias("eval_loss"), F.when(m > 709.78, F.lit(float("inf"))).otherwise(F.exp(m)).alias("perplexity")]
    if gen_tokens:
        aggs.append(F.avg(F.size(F.filter(gen_tokens, lambda t: t != pad))).alias("gen_len"))
    return df.agg(*aggs)


def label_vocab(df: DataFrame, label: str, split: str = "split", train: str = "train") -> DataFrame:
    """Labels of all splits (list labels exploded), sorted as strings,
    dense 0-based ids, and whether each label occurs in the training split. The
    marker -1 ("no label") is not a label; see ``check_vocab`` for the one-label error.
    The vocabulary is a distinct aggregate -- tiny by nature -- ranked with a
    window over that small table only."""
    from pyspark.sql import Window

    lab = F.col(label)
    exploded = df.select(F.col(split), F.explode(lab).alias("_l")) if isinstance(
        df.schema[label].dataType, __import__("pyspark.sql.types", fromlist=["ArrayType"]).ArrayType
    ) else df.select(F.col(split), lab.alias("_l"))
    v = exploded.filter(F.col("_l").isNotNull() & (F.col("_l").cast("string") != "-1")).select(F.col("_l").cast("string").alias("label"), split)
    agg = v.groupBy("label").agg(F.max((F.col(split) == train).cast("int")).alias("_t"))
    return agg.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("label_id"),
                      (F.col("_t") == 1).alias("in_train"))


def check_vocab(vocab: DataFrame) -> DataFrame:
    """A classifier needs two labels at least; raises otherwise (reads two rows)."""
    if len(vocab.limit(2).collect()) < 2:
        raise ValueError("at least two distinct labels are needed")
    return vocab


def unseen_labels(vocab: DataFrame) -> DataFrame:
    """Labels of the other splits that the training split lacks."""
    return vocab.filter(~F.col("in_train")).select("label")
