"""Sources: blanks and nulls through CSV, keyed JSON by line, folders of a layout chosen at run time."""

import tempfile

from mixlab.sources import io


def test_csv_keeps_blanks_line_ends_and_nulls(spark):
    d = tempfile.mkdtemp(prefix="mixlab-csv-")
    rows = [(1, "  a "), (2, ""), (3, None), (4, 'x "y", z\r\nw\\'), (5, "\tb\n")]
    df = spark.createDataFrame(rows, "id long, text string")
    io.write_csv(df, f"{d}/out", null_value="\\N")
    assert sorted(map(tuple, io.read_csv(spark, f"{d}/out", df.schema, null_value="\\N").collect())) == rows
    io.write_csv(df, f"{d}/plain")  # an empty field is NULL
    assert sorted(map(tuple, io.read_csv(spark, f"{d}/plain", df.schema).collect())) == [(i, t or None) for i, t in rows]


def test_keyed_json_by_line(spark):
    d = tempfile.mkdtemp(prefix="mixlab-json-")
    with open(f"{d}/doc.json", "w") as f:
        f.write('{\n"a": {"n": 1},\n "b, c": {"n": null} ,\n\n"d": {"n": 3}\n}\n')
    got = io.read_keyed_json(spark, f"{d}/doc.json", "struct<n:long>", by_line=True)
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b, c", None), ("d", 3)]


def test_layout_folders_are_chosen_at_run_time(spark):
    d = tempfile.mkdtemp(prefix="mixlab-layout-")
    rows = spark.createDataFrame([(float(i), f"d{i % 4}", i % 3) for i in range(24)], "metric double, dataset string, run int")
    io.write_layout(rows, f"{d}/exp", ["dataset", "run"])
    spark.createDataFrame([(f"d{i}", f"Name {i}") for i in range(4)], "dataset string, display_name string").write.parquet(f"{d}/names")
    names = spark.read.parquet(f"{d}/names").where("display_name = 'Name 2'")
    out = io.scan_layout(spark, f"{d}/exp", "metric double, dataset string, run int", names, "dataset")
    assert sorted(r.metric for r in out.collect()) == [float(i) for i in range(24) if i % 4 == 2]
    assert "dynamicpruning" in out._jdf.queryExecution().toString()
