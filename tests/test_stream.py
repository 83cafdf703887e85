"""Streaming restart: a second run on the same checkpoint adds nothing, new
files are picked up once, and replays never duplicate rows (T1 / G6)."""

import json
import os

from mixlab.streaming import streams as st


def _line(batch, cid, content):
    return json.dumps({"dataset_name": "d", "batch": batch, "custom_id": str(cid),
                       "response": {"body": {"choices": [{"message": {"content": content}}]}}})


def test_ingest_stream_restart_is_idempotent(spark):
    run = st.new_run_dir(spark, "test-stream")
    os.makedirs(f"{run}/in")
    with open(f"{run}/in/a.json", "w") as f:
        f.write("\n".join([_line(0, 0, "Claim: a||\nLabel: True"), _line(0, 1, "nothing useful")]) + "\n")
    st.ingest_stream(spark, f"{run}/in", f"{run}/out").awaitTermination()
    first = spark.read.parquet(f"{run}/out/parsed").count()
    st.ingest_stream(spark, f"{run}/in", f"{run}/out").awaitTermination()  # restart, no new input
    assert spark.read.parquet(f"{run}/out/parsed").count() == first == 1
    assert spark.read.parquet(f"{run}/out/rejects").count() == 1
    with open(f"{run}/in/b.json", "w") as f:
        f.write(_line(1, 0, "Claim: b||\nLabel: Untrue") + "\n")
    st.ingest_stream(spark, f"{run}/in", f"{run}/out").awaitTermination()
    rows = sorted((r.custom_id, r.claim, r.label) for r in spark.read.parquet(f"{run}/out/parsed").collect())
    assert rows == [("0", "a", 1), ("0", "b", 0)]


def test_first_result_that_parses_wins_and_later_ones_are_repeats(spark):
    run = st.new_run_dir(spark, "test-repeats")
    os.makedirs(f"{run}/in")
    deliveries = [[_line(0, 0, "nothing useful"), _line(0, 1, "Claim: a||\nLabel: True"), _line(0, 1, "Claim: a||\nLabel: True")],
                  [_line(0, 0, "Claim: b||\nLabel: Untrue"), _line(0, 1, "Claim: z||\nLabel: Untrue")],
                  [_line(0, 0, "Claim: y||\nLabel: True"), _line(0, 2, "nothing useful")]]
    for k, lines in enumerate(deliveries):  # a run each: every one starts from the checkpoint of the last
        with open(f"{run}/in/{k}.json", "w") as f:
            f.write("\n".join(lines) + "\n")
        st.ingest_stream(spark, f"{run}/in", f"{run}/out").awaitTermination()
    read = lambda kind: spark.read.parquet(f"{run}/out/{kind}")
    assert sorted((r.custom_id, r.claim, r.label) for r in read("parsed").collect()) == [("0", "b", 0), ("1", "a", 1)]
    assert sorted(r.custom_id for r in read("repeats").collect()) == ["0", "1", "1"]
    assert sorted(r.custom_id for r in read("rejects").collect()) == ["0", "2"]
    asked = spark.createDataFrame([("d", 0, str(i)) for i in range(4)], "dataset_name string, batch int, custom_id string")
    assert sorted(r.custom_id for r in st.unfinished(asked, f"{run}/out").collect()) == ["2", "3"]
