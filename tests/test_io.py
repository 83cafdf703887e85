"""Source / sink round trips (S1-S5, S7-S10) on small files in a scratch folder."""

import json
import os
import tempfile

import pytest

from mixlab.sources import io


def test_csv_round_trip_with_newlines_and_quotes(spark):
    d = tempfile.mkdtemp(prefix="mixlab-csv-")
    df = spark.createDataFrame([(1, 'a "quoted"\nline', 0.5)], "id long, context string, score double")
    io.write_csv(df, f"{d}/out")
    back = io.read_csv(spark, f"{d}/out", "id long, context string, score double").collect()
    assert back[0].context == 'a "quoted"\nline' and back[0].score == 0.5


def test_keyed_json_document(spark):
    d = tempfile.mkdtemp(prefix="mixlab-json-")
    with open(f"{d}/seg.json", "w") as f:
        json.dump({"s1": {"seg_dialog": [{"speaker": "A", "text": "hi"}]}, "s2": {"seg_dialog": []}}, f)
    rows = io.read_keyed_json(spark, f"{d}/seg.json", "struct<seg_dialog:array<struct<speaker:string,text:string>>>",
                              "article_segment_id").collect()
    assert sorted(r.article_segment_id for r in rows) == ["s1", "s2"]


def test_layout_scan_and_path_columns(spark):
    d = tempfile.mkdtemp(prefix="mixlab-layout-")
    df = spark.createDataFrame([(1, "x", 0.5, 0), (2, "y", 1.0, 1)], "id long, text string, frac double, run int")
    io.write_layout(df, f"{d}/exp", ["frac", "run"])
    os.makedirs(f"{d}/exp/batches")
    back = io.scan_dir(spark, f"{d}/exp", fmt="parquet", glob="*.parquet", skip_dir="batches")
    back = io.path_columns(back, "source_path", r"frac=([0-9.]+)/run=([0-9]+)", ["p_frac", "p_run"])
    got = sorted((r.id, r.p_frac, r.p_run) for r in back.collect())
    assert got == [(1, "0.5", "0"), (2, "1.0", "1")]


def test_guards(spark):
    with pytest.raises(ValueError):
        io.guard_paths("/a/b.csv", "/a/b.csv")
    io.guard_paths("/a/b.csv", "/a/b.csv", rewrite=True)
    df = spark.createDataFrame([(1, "p")], "id long, prediction string")
    with pytest.raises(ValueError):
        io.guard_new_column(df, "prediction")


def test_column_inference(spark):
    df = spark.createDataFrame([(1, "t", 1)], "id long, sentence string, target int")
    assert io.to_text_label(df).columns == ["id", "text", "label"]
    amb = spark.createDataFrame([(1, "t", "u", 1)], "id long, sentence string, input string, label int")
    with pytest.raises(ValueError):
        io.infer_io_columns(amb, strict=True)
    assert io.infer_io_columns(amb, strict=False) == ("sentence", "label")
    with pytest.raises(ValueError):
        io.infer_io_columns(spark.createDataFrame([(1, "t")], "id long, claim string"))
