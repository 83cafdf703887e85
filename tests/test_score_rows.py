"""Scores are made within their row: no gram goes through an aggregate, a window or a second shuffle."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mixlab.functions.bleu import tokens_13a
from mixlab.operators.enrich import enrich
from mixlab.operators.score import best_sentence, bleu_pairs


def _bleu(ref, pred):
    rl, pl, logs = len(ref), len(pred), 0.0
    order = min(rl, 4)
    if not rl or not pl:
        return 0.0
    for n in range(1, order + 1):
        r, p = (Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1)) for t in (ref, pred))
        m = sum((r & p).values())
        if not m:
            return 0.0
        logs += math.log(m / (pl - n + 1)) / order
    return (1.0 if pl > rl else math.exp(1 - rl / pl)) * math.exp(logs)


def test_repeated_grams_are_clipped(spark):
    """Few different words, so that most grams come more than once in a piece and in a text."""
    rnd = random.Random(7)
    text = lambda most: " ".join(rnd.choice("aab") for _ in range(rnd.randint(0, most)))
    rows = [(i, ".".join(text(14) for _ in range(rnd.randint(1, 5))), text(14), text(30)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, context string, a string, b string")
    got = {(r.id, r.variant): (r.location, r.bleu) for r in best_sentence(df, {"a": "a", "b": "b"}).collect()}
    for i, context, *texts in rows:
        for name, t in zip("ab", texts):
            if t:
                each = [_bleu(p.split(), t.split()) for p in context.split(".")]
                assert got[i, name] == (each.index(max(each)), pytest.approx(max(each))), (context, t)
    pairs = {r.pair_id: r.bleu for r in bleu_pairs(df.select(F.col("id").alias("pair_id"), F.col("a").alias("ref"), F.col("b").alias("pred"))).collect()}
    for i, _, a, b in rows:
        assert pairs[i] == pytest.approx(_bleu(a.split(), b.split()) if a and b else float(a == b)), (a, b)


def test_tokens_with_spaces(spark):
    df = spark.createDataFrame([("a  b\t c\n(d),e 5,6 5, 6 ,,7 x-\ny 3-4 & .",)], "t string")
    assert df.select(tokens_13a("t").alias("t")).first().t == "a b c ( d ) , e 5,6 5 , 6 , ,7 xy 3 - 4 & .".split()


def test_enrichment_keeps_grams_in_the_row(spark):
    rows = [(1, "A b c d. e f.", "a b?", "A b", "A b c d | x"), (1, "A b c d. e f.", "a b?", "A b", "A b c d | x"), (None, "x", "y", "z", "w"), (2, None, "q", "", "")]
    df = spark.createDataFrame(rows, "id long, context string, question string, answer string, prediction string")
    out = enrich(df, "qa")
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r.id, r.pred_location, r.answer_location, r.score and round(r.score, 6)) for r in out.collect()), key=str)
    assert got == [(1, 0, 0, 0.408248), (1, 0, 0, 0.408248), (2, None, None, 1.0)]  # rows of one id stay apart, rows without one are left out
    assert not any(x in plan for x in ("Aggregate", "Window", "Join")), plan
    assert plan.count("Exchange") == 1, plan


def test_prediction_files_are_scored_once_before_the_sort(spark):
    from mixlab.operators.enrich import enrich_predictions

    df = spark.createDataFrame([(1, "fv", "A b c|a b", 1, 0.9), (2, "fv", "x y|y", 0, 0.8)], "id long, task string, text string, label int, prediction double")
    out = enrich_predictions(df)
    plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
    lines = [k for k, x in enumerate(plan) if "Exchange" in x]
    assert "rangepartitioning" in plan[lines[0]] and "xxhash64" in plan[lines[1]], plan
    assert not any("Generate" in x for x in plan[lines[0]:lines[1]])  # the sort samples shuffled results
    assert [r.id for r in out.collect()] == [1, 2]
