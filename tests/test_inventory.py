"""Counts from Parquet footers against counts over the rows."""

import math

import pyarrow as pa
import pyarrow.parquet as pq

from marketweave.operators.profile import dataset_rollup
from marketweave.session import new_shared_path
from marketweave.sources import inventory as inv


def test_inventory_equals_a_scan_of_all_rows(spark):
    frames = {
        "gaps": spark.createDataFrame([(i, None if i % 7 else "x", float("nan") if i % 5 == 0 else 1.0, None if i % 3 else 2) for i in range(90)], "id long, s string, v double, n int"),
        "one gap": spark.createDataFrame([(i, None if i % 4 else "y") for i in range(30)], "id long, s string"),
        "nested": spark.createDataFrame([(1, [1, 2]), (2, None), (None, [])], "id long, a array<int>"),
        "none": spark.createDataFrame([], "id long, v double"),
    }
    paths = {}
    for name, df in frames.items():
        paths[name] = new_shared_path(spark, "table")
        df.repartition(3).write.parquet(paths[name])
    got = inv.inventory(spark, paths)
    want = dataset_rollup({n: spark.read.parquet(p) for n, p in paths.items()})
    assert sorted(map(tuple, got.drop("scanned_columns").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r["dataset"]: r["scanned_columns"] for r in got.collect()} == {"gaps": 3, "one gap": 0, "nested": 2, "none": 1}
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_files_without_statistics_are_read(spark):
    folder = new_shared_path(spark, "bare").removeprefix("file:")
    table = pa.table({"id": pa.array([1, None, 3]), "s": ["a", "b", None]})
    spark.createDataFrame([(9, "z")], "id long, s string").write.parquet(folder)
    pq.write_table(table, f"{folder}/bare.parquet", write_statistics=False)
    row = inv.inventory(spark, {"t": folder}).first()
    assert (row["rows"], row["missing_cells"], row["complete_rows"], row["scanned_columns"]) == (4, 2, 2, 2)


def test_counts_come_from_the_footers(spark):
    path = new_shared_path(spark, "table")
    spark.range(1000).write.parquet(path)
    with inv._pushed_aggregates(spark):
        plan = spark.read.parquet(path).selectExpr("count(id)")._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(id)]" in plan and math.isclose(inv.footer_counts(spark, path, ["id"])["id"], 1000)
