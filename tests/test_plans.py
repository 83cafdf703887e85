"""Plan-shape and invariance checks."""

import re

import mixlab.plans.catalog  # noqa: F401
from mixlab.plans.registry import QUERIES

from .conftest import SF01


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_sentence_single_shuffle(spark):
    plan = _plan(QUERIES["best_sentence"](spark, SF01))
    shuffles = re.findall(r"Exchange hashpartitioning", plan)
    assert len(shuffles) == 1, plan


def test_no_python_udfs(spark):
    for name in ["best_sentence", "parse_qa", "mixture_share", "enrich_qa", "few_shot", "pack_blocks"]:
        plan = _plan(QUERIES[name](spark, SF01))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_exact_rank_avoids_single_partition_window(spark):
    """What goes to one partition is summed before: bucket counts and totals, never rows of the table."""
    for name in ["mixture", "slices", "shuffle_split", "nested_samples"]:
        lines = _plan(QUERIES[name](spark, SF01)).split("\n")
        for k, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert any("Aggregate" in x for x in lines[k + 1 : k + 5]), (name, lines[k : k + 5])


def test_partition_invariance(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        res = []
        for n in ("1", "7", "31"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            res.append(sorted(tuple(r) for r in QUERIES["mixture_share"](spark, SF01).collect()))
        assert res[0] == res[1] == res[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
