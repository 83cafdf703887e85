"""Examples of a row are read beside it where it is ranked; texts are not shuffled again for each of them."""

import hashlib

from mixlab.operators.prompts import answer_message, context_message, few_shot, requests  # noqa: F401


def _rows():
    rows = [(i, "ds" if i % 3 else "other", f"context {i}.", f"claim {i}", i % 2) for i in range(900)]
    rows += [(5000 + i, None, f"context n{i}.", f"claim n{i}", 1) for i in range(5)]  # a NULL group: no examples
    rows += [(6000 + i, "small", f"context s{i}.", f"claim s{i}", 1) for i in range(3)]  # too few: rejects
    return rows


SCHEMA = "id long, dataset_name string, context string, claim string, label int"


def test_examples_are_the_next_rows_of_the_group(spark):
    rows = _rows()
    msgs, rejects = few_shot(spark.createDataFrame(rows, SCHEMA), "fv")
    got: dict = {}
    for r in msgs.collect():
        got.setdefault(r.id, []).append((r.pos, r.role, r.content))
    assert sorted(r.id for r in rejects.collect()) == [6000, 6001, 6002]
    groups: dict = {}
    for r in rows:
        groups.setdefault((r[1], r[4]), []).append(r)
    for (name, _), members in groups.items():
        if name == "small":
            continue
        members.sort(key=lambda r: (hashlib.md5(f"{r[0]}-42".encode()).hexdigest(), r[0]))
        for at, r in enumerate(members):
            label = "True" if r[4] == 1 else "Untrue (either False or just not supported)"
            want = [(0, "system", f"Given the context, come up with a {label} claim. Answer in the format below:"), (7, "user", f"Context: {r[2]}")]
            for j in (1, 2, 3) if name else ():
                e = members[(at + j) % len(members)]
                want += [(2 * j - 1, "user", f"Context: {e[2]}"), (2 * j, "assistant", f"Claim: {e[3]}||\nLabel: {'True' if e[4] == 1 else 'Untrue'}")]
            assert sorted(got.pop(r[0])) == sorted(want)
    assert not got


def test_texts_are_ranked_once_and_not_joined_to_each_row(spark):
    df = spark.createDataFrame(_rows(), SCHEMA).repartition(4)
    plan = few_shot(df, "fv")[0]._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [x for x in plan if "Join Inner" in x and "_pr" in x]
    heads = [x for x in plan if "Filter" in x and "<= 3)" in x]
    assert len(joins) == 1 and heads, plan  # only the first rows of a bucket are joined


def test_rows_that_share_an_id_keep_all_their_messages(spark):
    df = spark.createDataFrame([(i // 2, "ds", f"context {i}.", f"claim {i}", 1) for i in range(40)], SCHEMA)
    msgs, _ = few_shot(df, "fv")
    per_id = {r.id: r["count"] for r in msgs.groupBy("id").count().collect()}
    assert per_id == {i: 16 for i in range(20)}
    assert requests(msgs, df).count() == 40
