"""N-grams of several columns are counted in the same passes; packing makes the ids once."""

from collections import Counter

from pyspark.sql import functions as F

from mixlab.functions.text import word_ngrams
from mixlab.operators import reports as rp
from mixlab.operators import sequences as sq


def test_ngram_report_counts_columns_together(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(rp, "top_ngrams", lambda *a, of=rp.top_ngrams, **k: calls.append(1) or of(*a, **k))
    rows = [("a b c a b c", "x y x y"), ("a b  c\td", None), ("", "x y"), ("b c", "one")]
    out = rp.ngram_report(spark.createDataFrame(rows, "p string, q string"), ["p", "q"], n=2, k=2).collect()
    assert len(calls) == 1
    want = []
    for i, c in enumerate("pq"):
        grams = Counter(" ".join(w[j:j + 2]) for w in ((r[i] or "").split() for r in rows) for j in range(len(w) - 1))
        want += [(c, g, n, n * 100.0 / sum(grams.values())) for g, n in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:2]]
    assert [tuple(r) for r in out] == want


def test_word_ngrams(spark):
    df = spark.createDataFrame([(" a bb\n a bb a ",), ("a bb",), ("",), (None,)], "t string")
    got = [(r.n, r.m) for r in df.select(word_ngrams("t", 3).alias("n"), word_ngrams("t", 1).alias("m")).collect()]
    assert got == [(["a bb a", "bb a bb", "a bb a"], ["a", "bb", "a", "bb", "a"]), ([], ["a", "bb"]), ([], []), ([], [])]


def test_packing_makes_the_ids_once(spark):
    made = spark.sparkContext.accumulator(0)

    def ids(rows):
        for k, in rows:
            made.add(1)
            yield k, [k] * 3

    df = spark.createDataFrame(spark.sparkContext.parallelize([(k,) for k in range(40)], 4).mapPartitions(ids), "k long, ids array<long>")
    assert sq.pack_blocks(df, "ids", "k", 4).agg(F.count("*")).first()[0] == 30
    assert made.value <= 2 * 40  # a checkpoint reads its rows twice


def test_blank_rows_are_found_without_stripping(spark):
    from mixlab.operators.cleaning import drop_blank

    df = spark.createDataFrame([("a",), (" \t\n\x0b\f\r ",), ("",), (None,), ("\n\n x \n",), ("\u00a0",)], "t string")
    out = drop_blank(df, ["t"])
    assert [r.t for r in out.collect()] == ["a", "\n\n x \n", "\u00a0"]
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
