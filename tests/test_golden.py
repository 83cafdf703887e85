"""Golden vectors derived by hand from the reference rules (FIXTURES.md §4)."""

import pytest
from pyspark.sql import functions as F

from mixlab.functions.keys import frac_count
from mixlab.functions.text import question_word, strip_urls
from mixlab.operators import mixture as mx
from mixlab.operators import parse as ps
from mixlab.operators import sampling as sm
from mixlab.operators.metrics import threshold_metrics
from mixlab.operators.score import best_sentence, bleu_pairs
from mixlab.operators.sequences import pack_blocks

BLEU_CASES = [(None, "a", 0.0), ("", "", 1.0), ("", "a", 0.0), ("paris", "paris", 1.0), ("paris", "in paris", 0.5),
              ("new york", "york", 0.0), ("a b c d", "a b c d", 1.0), ("a b c d", "a b c", 0.0)]


def test_bleu_golden(spark):
    df = spark.createDataFrame([(i, r, p) for i, (r, p, _) in enumerate(BLEU_CASES)], "pair_id long, ref string, pred string")
    got = {r.pair_id: r.bleu for r in bleu_pairs(df).collect()}
    for i, (_, _, want) in enumerate(BLEU_CASES):
        assert got[i] == pytest.approx(want), BLEU_CASES[i]


def test_best_sentence_golden(spark):
    df = spark.createDataFrame([(1, "x y. a b. a b", "a b"), (2, "no dot here", "dot"), (3, "a.", "zzz")],
                               "id long, context string, t string")
    got = {r.id: (r.location, r.location_ratio, r.bleu) for r in best_sentence(df, {"t": "t"}).collect()}
    assert got[1] == (1, pytest.approx(1 / 3), pytest.approx(1.0))
    assert got[2][0] == 0 and got[2][1] == 0.0
    assert got[3] == (0, 0.0, 0.0)


def test_best_sentence_variants_are_independent(spark):
    df = spark.createDataFrame([(1, "the cat sat. a dog ran far away. x", "the cat sat", "a dog ran"),
                                (2, "one two three. four five", "four five", "one")], "id long, context string, a string, b string")
    one = {r.id: (r.location, r.bleu) for r in best_sentence(df, {"a": "a"}).collect()}
    two = {r.id: (r.location, r.bleu) for r in best_sentence(df, {"a": "a", "b": "b"}).filter("variant = 'a'").collect()}
    assert one == two


PARSE = [
    ("Claim: Cats purr||\nLabel: True", ("Cats purr", "True"), ("Cats purr", 1)),
    ("Claim: Cats bark||\nLabel: Untrue", ("Cats bark", "Untrue"), ("Cats bark", 0)),
    ("Claim: Cats bark\nVerdict: not supported", ("Cats bark", "not supported"), ("Cats bark", 0)),
    ("Question: Who ran?||\nAnswer: Ann", ("Who ran?", "Ann"), None),
    ("Question: Who ran?|Ann ran far|x", ("Who ran?", "Ann ran far"), None),
    ("|True Claim: Cats purr|", ("Cats purr", "True"), ("Cats purr", 1)),
    ("|Untrue Claim: Cats bark|", ("Cats bark", "False"), ("Cats bark", 0)),
    ("Who ran?\nAnn", ("Who ran?", "Ann"), None),
    ("Claim: Cats bark||\nLabel: incorrect", ("Cats bark", "incorrect"), ("Cats bark", 1)),  # quirk Q6 kept
    ("nothing useful", None, None),
]


def test_parse_golden(spark):
    df = spark.createDataFrame([(i, o) for i, (o, _, _) in enumerate(PARSE)], "id int, o string")
    d = ps.parse_fv(ps.parse_qa(df, "o", "q"), "o", "f")
    for r in d.collect():
        _, qa, fv = PARSE[r.id]
        assert (None if r.q.rejected else (r.q.question, r.q.answer)) == qa, PARSE[r.id]
        assert (None if r.f.rejected else (r.f.claim, r.f.label)) == fv, PARSE[r.id]


def test_parse_explained_golden(spark):
    df = spark.createDataFrame([(1, "Explanation: e||\nQuestion: q?||\nAnswer: a")], "id int, o string")
    r = ps.parse_cot_qa(df, "o", "p").collect()[0].p
    assert (r.explanation, r.question, r.answer, r.rejected) == ("e", "q?", "a", False)


def test_question_word(spark):
    df = spark.createDataFrame([("the whole story",), ("show me",), ("which and what",), ("is it?",)], "q string")
    assert [r.w for r in df.select(question_word("q").alias("w")).collect()] == ["who", "how", "what", None]


def test_url_removal(spark):
    df = spark.createDataFrame([("see https://a.b/c x www.d.e",)], "t string")
    assert df.select(strip_urls("t").alias("x")).collect()[0].x == "see  x "


def test_counts(spark):
    n = spark.createDataFrame([(40,), (100,), (5,)], "n long")
    r = n.select(frac_count(F.col("n"), 0.5).alias("a"), frac_count(F.col("n"), 0.95).alias("b"),
                 frac_count(F.col("n"), 0.975).alias("c"), frac_count(F.col("n"), 0.3, "half_even").alias("d"),
                 frac_count(F.col("n"), 0.5, "half_even").alias("e")).collect()
    assert (r[0].a, r[0].b, r[0].c) == (20, 38, 39)
    assert (r[2].d, r[2].e) == (2, 2)


def _ids(spark, n):
    return spark.range(n).select(F.col("id"), F.lit("d").alias("dataset_name"))


def test_mixture_count_and_nesting(spark):
    base = _ids(spark, 40).withColumns({"context": F.lit("c"), "claim": F.lit("h"), "syn_claim": F.lit("g"),
                                        "label": F.lit(1), "syn_label": F.lit(0), "meta": F.lit(None).cast("string")})
    sweep = mx.mixture_sweep(base, "fv").groupBy("frac").agg(F.sum(F.col("synthetic").cast("int")).alias("s"))
    got = {r.frac: r.s for r in sweep.collect()}
    assert got == {0.0: 0, 0.5: 20, 0.95: 38, 0.975: 39, 1.0: 40}
    s95 = {r.id for r in mx.mixture(base, "fv", 0.95).filter("synthetic").collect()}
    s50 = {r.id for r in mx.mixture(base, "fv", 0.5).filter("synthetic").collect()}
    assert s50 < s95


def test_split_point_and_disjoint(spark):
    s = sm.shuffle_split(_ids(spark, 100), 0.2).groupBy("split").count()
    assert {r.split: r["count"] for r in s.collect()} == {"train": 80, "valid": 20}


def test_slices_take_remainder(spark):
    s = sm.slices(_ids(spark, 13)).groupBy("batch").count()
    assert {r.batch: r["count"] for r in s.collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 5}


def test_nested_samples_are_nested(spark):
    s = sm.nested_samples(_ids(spark, 50), [30, 20, 10]).collect()
    by = {}
    for r in s:
        by.setdefault(r.size, set()).add(r.id)
    assert by[10] < by[20] < by[30] and len(by[30]) == 30


def test_replacement_value_variants(spark):
    base = _ids(spark, 3500).withColumns({"context": F.lit("c"), "claim": F.lit("h"), "syn_claim": F.lit("g"),
                                          "label": F.lit(1), "syn_label": F.lit(0), "meta": F.lit(None).cast("string")})
    m = mx.replacement_value(base, "fv", [1000, 2000, 3000], 200, by=())
    v = {r.variant for r in m.select("variant").distinct().collect()}
    assert v == {"train", "real_train", "synth_0_train", "synth_1_train", "synth_2_train", "synth_3_train"}
    sizes = {(r.base_size, r.variant): r["count"] for r in m.groupBy("base_size", "variant").count().collect()}
    assert sizes[(1000, "synth_3_train")] == 1000 + 800 and sizes[(3000, "real_train")] == 3200


def test_macro_f1(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1)], "label int, output double")
    r = {x.threshold_name: x for x in threshold_metrics(df).collect()}
    assert r["0.5"].accuracy == 1.0 and r["0.5"].macro_f1 == 1.0


def test_quartiles(spark):
    from mixlab.operators.stats import quartile_contrast

    df = spark.range(10).select("id", (F.col("id") / 10.0).alias("score"))
    c = {r.cohort: r["count"] for r in quartile_contrast(df, "score").groupBy("cohort").count().collect()}
    assert c == {"top": 2, "bottom": 3}


def test_packing(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5, 6, 7]), (3, [8, 9])], "k long, ids array<int>")
    blocks = sorted((r.block, list(r.input_ids)) for r in pack_blocks(df, "ids", "k", 4).collect())
    assert blocks == [(0, [1, 2, 3, 4]), (1, [5, 6, 7, 8])]


def test_sweep_never_mixes_test_and_samples_fever_holdout(spark):
    base = spark.range(200).select(
        "id", F.when(F.col("id") % 2 == 0, F.lit("fever")).otherwise(F.lit("wanli")).alias("dataset_name"),
        F.when(F.col("id") % 10 < 6, F.lit("train")).when(F.col("id") % 10 < 8, F.lit("valid")).otherwise(F.lit("test")).alias("split"),
        F.lit("c").alias("context"), F.lit("h").alias("claim"), F.lit("g").alias("syn_claim"), F.lit(1).alias("label"),
        F.lit(0).alias("syn_label"), F.lit(None).cast("string").alias("meta"))
    s = mx.mixture_sweep(base, "fv", split_col="split")
    test_fracs = {r.frac for r in s.filter("split = 'test'").select("frac").distinct().collect()}
    assert test_fracs == {0.0}
    n = {(r.dataset_name, r.split): r["count"] for r in s.filter("frac = 0.0").groupBy("dataset_name", "split").count().collect()}
    assert n[("fever", "train")] == 60 and n[("fever", "valid")] == 5 and n[("fever", "test")] == 5
    assert n[("wanli", "valid")] == 20


def test_sort_by_score(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.9), (4, 0.5)], "id long, score double")
    assert [r.id for r in sm.sort_by_score(df).collect()] == [3, 1, 4, 2]


def test_qaconv_missing_segment_is_dropped(spark):
    from mixlab.operators.corpora import qaconv

    recs = spark.createDataFrame(
        [("s1", "q1", ["a1"], "g", "trn"), ("s2", "q2", ["a2"], "g", "tst"), ("s1", "q3", [], "g", "val")],
        "article_segment_id string, question string, answers array<string>, QG string, split string")
    seg = spark.createDataFrame([("s1", [(" A ", " hi "), ("B", "yo")])],
                                "article_segment_id string, seg_dialog array<struct<speaker:string,text:string>>")
    rows = qaconv(recs, seg).collect()
    assert [(r.question, r.context, r.split) for r in rows] == [("q1", "A: hi|B: yo|", "train")]
