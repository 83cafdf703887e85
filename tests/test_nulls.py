"""NULL groups, NULL ids, repeated ids, pairs with an empty side, streams over several files."""

import datetime as dt

from pyspark.sql import functions as F

from mixlab.operators import enrich, metrics, mixture, sampling, score
from mixlab.streaming import streams as st


def _rows(spark):
    data = [(None if k == 7 else k, None if k % 4 == 0 else "ab"[k % 2], f"c{k}", f"claim {k}", 1, f"s {k}", 0, "m") for k in range(20)]
    return spark.createDataFrame(data, "id long, dataset_name string, context string, claim string, label int, syn_claim string, syn_label int, meta string")


def test_null_groups_and_ids_are_kept(spark):
    df = _rows(spark)
    by = ["dataset_name"]
    assert sampling.sample_frac(df, 1.0, by=by).count() == 20
    split = sampling.shuffle_split(df, by=by)
    assert split.count() == 20 and split.filter("dataset_name is null").count() == 5
    assert sampling.slices(df, by=by).count() == 20
    assert sampling.cap_per_split(df, {"a": 2}, split_col="dataset_name").count() == 20 - df.filter("dataset_name = 'a'").count() + 2
    assert [mixture.mixture(df, "fv", f).count() for f in (0.0, 0.5, 1.0)] == [20, 20, 20]
    assert sampling.shuffle_split(df.filter("id in (6, 8) or id is null")).count() == 3


def test_repeated_ids_are_scored_apart(spark):
    pairs = spark.createDataFrame([(1, "a b c d", "a b c d"), (1, "a b c d", "x"), (1, "a b c d", "x"), (2, "q", "q")], "pair_id long, ref string, pred string")
    got = sorted((r.pair_id, r.bleu) for r in score.bleu_pairs(pairs).collect())
    assert got == [(1, 0.0), (1, 0.0), (1, 1.0), (2, 1.0)]
    assert score.rouge1_pairs(pairs).count() == 4
    qa = pairs.select(F.col("pair_id").alias("id"), F.col("ref").alias("answer"), F.col("pred").alias("prediction"))
    row = metrics.qa_metrics(qa).first()
    assert row.exact_match == 0.5 and row.dropped == 0
    fv = spark.createDataFrame([(1, "one. two", "one", 1, 0.5), (1, "one. two", "two", 0, 0.5)], "id long, context string, claim string, label int, prediction double")
    assert sorted((r.claim, r.claim_location) for r in enrich.enrich(fv, "fv").collect()) == [("one", 0), ("two", 1)]


def test_task_column_comes_first(spark):
    df = spark.createDataFrame([(None, "x"), ("fv", "y")], "task string, answer string")
    assert enrich.infer_task(df) == "fv"
    assert enrich.infer_task(df.drop("task")) == "qa"


def test_pair_with_an_empty_side_scores_zero(spark):
    v = spark.createDataFrame([(1, 0, 0, [1.0, 0.0]), (1, 1, 0, [1.0, 0.0]), (2, 0, 0, [1.0, 0.0])], "pair_id long, side int, pos int, vector array<double>")
    assert sorted((r.pair_id, r.f1) for r in score.vector_match_f1(v).collect()) == [(1, 1.0), (2, 0.0)]


def test_labels_without_the_marker(spark):
    df = spark.createDataFrame([("train", "a"), ("test", "b"), ("train", "-1")], "split string, label string")
    vocab = metrics.label_vocab(df, "label")
    assert sorted(r.label for r in vocab.collect()) == ["a", "b"]
    assert [r.label for r in metrics.unseen_labels(vocab).collect()] == ["b"]


def test_cost_stream_over_two_files_keeps_every_model(spark):
    run = st.new_run_dir(spark, "cost-test")
    schema = "model string, prompt_tokens long, completion_tokens long, ts timestamp"
    at = dt.datetime(2024, 1, 1, 0, 5)
    m1, m2 = "gpt-3.5-turbo-0125", "gpt-4-turbo"
    for k, rows in enumerate(([(m1, 1, 1, at), (m2, 2, 2, at)], [(m1, 10, 10, at)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{run}/in/f{k}")
        usage = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{run}/in")
        st.cost_stream(spark, usage, f"{run}/out").awaitTermination()
    got = {r.model: (r.requests, r.prompt_tokens) for r in st.cost_table(spark, f"{run}/out").collect()}
    assert got == {m1: (2, 11), m2: (1, 2)}


def test_numeric_rank_with_outliers_and_a_hot_value(spark):
    import math
    import random

    from mixlab.functions.keys import numeric_rank

    rng = random.Random(4)
    rows = [(k, rng.choice([0.5, rng.random(), 1e300, -1e300, math.inf, None])) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, score double")
    for desc in (True, False):
        got = {r.id: r.rank for r in numeric_rank(df, "score", desc).collect()}
        key = lambda r: (r[1] is None, (-r[1] if desc else r[1]) if r[1] is not None else 0, r[0])
        assert got == {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=key))}


def test_label_ids_names_and_blank_inputs(spark):
    from mixlab.operators import cleaning

    df = spark.createDataFrame([("a", "x/fever/1", "t"), ("-1", "other", " "), ("z", "coqa", None)], "label string, path string, text string")
    got = df.select(cleaning.label_id("label", ["a", "b"]).alias("l"), cleaning.display_name("path").alias("n")).collect()
    assert [tuple(r) for r in got] == [(0, "FEVER"), (-1, "other"), (None, "CoQA")]
    assert sampling.cap_per_split(df, {}, split_col="path", id_col="label", input_col="text").count() == 1
