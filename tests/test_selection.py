"""Distributed selection: quantiles, draws, top n-grams, the frequency-split join of vocabulary ids."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixlab.functions.selection import draw_keys, drawn, quantiles
from mixlab.operators import mixture as mx
from mixlab.operators import sampling as sm
from mixlab.operators import sequences as sq
from mixlab.operators import stats as st


def values(name):
    rnd = random.Random(name)
    if name == "normal":
        return [rnd.gauss(0, 1) for _ in range(3001)]
    if name == "heavy":  # one value in half of all places, and outliers
        return [7.0] * 1500 + [rnd.random() * 10 for _ in range(1400)] + [1e300, -1e300, 1e18]
    if name == "whole":
        return [float(rnd.randrange(5)) for _ in range(2000)]
    return [3.5]


@pytest.mark.parametrize("parts", [1, 7, 31])
@pytest.mark.parametrize("name", ["normal", "heavy", "whole", "one"])
def test_quantiles_are_exact_however_rows_are_dealt(spark, name, parts):
    v = values(name)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    df = spark.createDataFrame([(x,) for x in [*v, None]], "x double").repartition(parts)
    got = quantiles(df, "x", probs).first().q
    s = sorted(v)
    for p, q in zip(probs, got):
        at = p * (len(s) - 1)
        low = s[int(at)]
        assert q == low + (s[min(int(at) + 1, len(s) - 1)] - low) * (at - int(at)) or q == pytest.approx(np.quantile(v, p))


def test_quantiles_by_group_with_null_groups_and_empty_ones(spark):
    rows = [(None, 1.0), (None, 4.0), ("a", None), ("b", 2.0), ("b", 9.0), ("b", 3.0)]
    out = {r.g: (r.n, r.q) for r in quantiles(spark.createDataFrame(rows, "g string, x double"), "x", [0.5], ["g"], [F.count("v").alias("n")]).collect()}
    assert out[None] == (2, [2.5]) and out["b"] == (3, [3.0]) and out["a"][0] == 0 and not out["a"][1]
    assert quantiles(spark.createDataFrame([], "g string, x double"), "x", [0.5], ["g"]).count() == 0


def test_describe_has_no_buffer_of_values(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("g"), F.col("id").alias("x"))
    plan = st.describe(df, "x", by=["g"])._jdf.queryExecution().executedPlan().toString().replace("percentile_approx", "")
    assert "percentile(" not in plan and "median(" not in plan and "collect_list" not in plan


def key(i, *salt):
    return hashlib.md5("-".join(map(str, (i, 42, *salt))).encode()).hexdigest()


def test_draws_take_the_first_keys_of_each_group(spark):
    rows = [(i, ["a", "b", None][i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string").repartition(5)
    draws = {"x": (10, ("x",)), "y": (99, ()), "all": (500, ()), "none": (0, ())}
    got = {(r.g, d): set() for r in df.select("g").distinct().collect() for d in draws}
    for r in drawn(df, draws, by=["g"]).collect():
        for d in r._in:
            got[r.g, d].add(r.id)
    for (g, d), ids in got.items():
        n, salt = draws[d]
        assert ids == set(sorted((i for i, h in rows if h == g), key=lambda i: (key(i, *salt), i))[:n])


def test_draws_rows_without_an_id_come_last(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    assert sorted(str(r.id) for r in drawn(df, {"d": (2, ())}).where("size(_in) = 1").collect()) == ["1", "2"]
    assert drawn(df, {"d": (3, ())}).where("size(_in) = 1").count() == 3
    assert draw_keys(df.limit(0), {"d": (3, ())}).first().last == {} and drawn(df.limit(0), {"d": (3, ())}).count() == 0


def test_draws_shuffle_no_texts(spark):
    df = spark.range(1000).select("id", F.lit("text").alias("text"), F.lit("d").alias("dataset_name"))
    plan = sm.repeat_draws(df, [10, 20], 3, by=["dataset_name"])._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "text" in x]


def records(spark, n, name="d"):
    return spark.range(n).select("id", F.lit(name).alias("dataset_name"), F.lit("c").alias("context"), F.lit("h").alias("claim"), F.lit("g").alias("syn_claim"),
                                 F.lit(1).alias("label"), F.lit(0).alias("syn_label"), F.lit(None).cast("string").alias("meta"))


def test_size_sweep_counts_small_files_and_own_sizes(spark):
    df = records(spark, 700).unionByName(records(spark, 600, "scifact"))
    out = mx.size_sweep(df, "fv", sizes=[50, 400], runs=2, fracs=[0.0, 0.5, 1.0])
    got = {tuple(r)[:-1]: r["count"] for r in out.groupBy("dataset_name", "size", "run", "frac", "small", "synthetic").count().collect()}
    want = {}
    for name, sizes in (("d", [50, 400]), ("scifact", [100, 300, 500])):
        for s in sizes:
            for run in (0, 1):
                want |= {(name, s, run, 0.0, small, False): s for small in (False, True)}
                want |= {(name, s, run, 0.5, small, False): s // 2 for small in (False, True)}
                want |= {(name, s, run, 0.5, False, True): s // 2, (name, s, run, 1.0, False, True): s}
    assert got == want


def test_replacement_value_has_own_sizes_per_corpus(spark):
    out = mx.replacement_value(records(spark, 400, "scifact"), "fv")
    got = {(r.base_size, r.variant): r["count"] for r in out.groupBy("base_size", "variant").count().collect()}
    assert got == {(s, v): s + add for s in (100, 200, 300) for v, add in [("train", 0), ("real_train", 20), *[(f"synth_{i}_train", 20 * (i + 1)) for i in range(4)]]}


@pytest.mark.parametrize("buckets", [1, 8, 1 << 18])
def test_top_ngrams_is_exact_with_any_number_of_buckets(spark, monkeypatch, buckets):
    monkeypatch.setattr(st, "GRAM_BUCKETS", buckets)
    monkeypatch.setattr(st, "FIRST_BUCKETS", 2)
    rnd = random.Random(buckets)
    texts = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 30))) for _ in range(200)]
    grams = Counter(" ".join(w[i : i + 2]) for w in map(str.split, texts) for i in range(len(w) - 1))
    want = sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:7]
    got = st.top_ngrams(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 2, 7).collect()
    assert [(r.ngram, r.n) for r in got] == want
    assert got[0].pct == pytest.approx(100 * want[0][1] / sum(grams.values()))


def test_top_ngrams_of_few_grams(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    assert [(r.ngram, r.n) for r in st.top_ngrams(df, "t", 2, 5).collect()] == [("a b", 1)]
    assert st.top_ngrams(df.limit(0), "t", 2, 5).count() == 0


def test_token_ids_keep_a_hot_word_out_of_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(sq, "HEAD_WORDS", 3)
    rnd = random.Random(5)
    texts = [(i, " ".join("the" if rnd.random() < 0.5 else f"w{rnd.randrange(40)}" for _ in range(30))) for i in range(100)]
    df = spark.createDataFrame(texts, "id long, t string")
    vocab = sq.vocabulary(df, "t").persist()
    place = {r.word: r.id for r in vocab.collect()}
    assert place["the"] == 1
    out = sq.token_ids(df, "t", vocab)
    assert {r.id: list(r.ids) for r in out.collect()} == {i: [place[w] for w in t.split()] for i, t in texts}
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    vocab.unpersist()
