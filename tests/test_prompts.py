"""Explained examples (G3): distinct partners of the own group, never the row itself, pools of any size."""

import pytest

from mixlab.operators import prompts as pr


def _rows(spark, n, group="d"):
    return spark.createDataFrame([(i, group, f"ctx{i}", f"q{i}", f"a{i}", f"why{i}") for i in range(n)],
                                 "id long, dataset_name string, context string, question string, answer string, explanation string")


@pytest.mark.parametrize("n, pool", [(7, 4), (7, 3), (300, 101), (300, 300), (5, 5)])
def test_examples_are_distinct_others_of_the_pool(spark, n, pool):
    rows = _rows(spark, n)
    curated = rows.where(f"id < {pool}")
    msgs, rejects = pr.few_shot_explained(rows, curated, "qa", k=3)
    got: dict = {}
    for r in msgs.where("role = 'user' AND pos < 7").collect():
        got.setdefault(r.id, []).append(int(r.content.split("ctx")[1]))
    lost = {r.id for r in rejects.collect()}
    assert lost == {i for i in range(n) if pool - (i < pool) < 3}
    assert set(got) == set(range(n)) - lost
    for i, ex in got.items():
        assert len(ex) == len(set(ex)) == 3 and i not in ex and max(ex) < pool


def test_partners_spread_over_a_large_pool(spark):
    rows = _rows(spark, 400)
    msgs, _ = pr.few_shot_explained(rows, rows, "qa", k=3)
    used = {r.content for r in msgs.where("role = 'assistant'").collect()}
    assert len(used) > 300  # 1,200 draws from 400 rows: about 380 are met


def test_rows_without_a_group_or_examples_are_rejects(spark):
    rows = _rows(spark, 5).unionByName(_rows(spark, 6, "e").selectExpr("id + 100 AS id", *["dataset_name", "context", "question", "answer", "explanation"]))
    rows = rows.unionByName(rows.where("id = 0").selectExpr("id + 50 AS id", "CAST(NULL AS STRING) AS dataset_name", "context", "question", "answer", "explanation"))
    msgs, rejects = pr.few_shot_explained(rows, rows.where("dataset_name = 'd'"), "qa", k=3)
    assert {r.id for r in msgs.collect()} == set(range(5))
    assert {r.id for r in rejects.collect()} == {50, *range(100, 106)}
