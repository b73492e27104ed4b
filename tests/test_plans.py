"""Guards and edge cases of the analysis queries; their results are compared with SQL elsewhere."""

import pytest
from millrace.functions.errors import OperationError
from millrace.functions.windows import running
from millrace.plans import business, graph, history, preview
from pyspark.sql import functions as F


def test_preview(spark):
    assert preview.preview(spark.range(5), 3).truncated and not preview.preview(spark.range(3), 3).truncated
    with pytest.raises(OperationError):
        preview.preview(spark.range(3), 0)


def test_reach_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "read"), ("b", "c", "write"), ("c", "a", "read"), ("d", "c", "refresh")], "source string, target string, kind string")
    seed = spark.createDataFrame([("a",)], "id string")
    assert {tuple(r) for r in graph.reach(edges.select("source", "target"), seed).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r["id"] for r in graph.neighbourhood(edges, seed, "both", 2).collect()} == {"a", "b", "c", "d"}
    assert {r["id"]: r["reason"] for r in graph.stale(edges, seed).collect()} == {"a": "direct", "b": "inherited", "c": "inherited"}
    assert graph.layers(edges.select("source", "target"), spark.createDataFrame([(x,) for x in "abcd"], "id string"), rounds=3).count() == 4
    with pytest.raises(ValueError):
        graph.neighbourhood(edges, seed, "both", 9)


def test_layers_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(54)], "source long, target long")
    assert {r["id"]: r["layer"] for r in graph.layers(edges, spark.range(55)).collect()} == {i: i for i in range(55)}


def test_validity_keeps_facts_without_range(spark):
    facts = spark.createDataFrame([(1, 5), (1, 50), (2, 5)], "k long, t long")
    ranges = spark.createDataFrame([(1, 0, 10, "a"), (1, 40, None, "b")], "k long, valid_from long, valid_to long, v string")
    assert sorted((r["k"], r["t"], r["v"]) for r in business.valid_at(facts, ranges, "k", "t").collect() if r["v"]) == [(1, 5, "a"), (1, 50, "b")]
    assert business.valid_at(facts, ranges, "k", "t").count() == 3


def test_running_counts_rows(spark):
    t = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", 2, 1)], "k string, o long, v long")
    assert sorted(r[0] for r in t.select(running(F.sum("v"), ["k"], ["o"])).collect()) == [1, 2, 3]


def test_hourly_access_fills_empty_hours(spark):
    audit = spark.createDataFrame([("2024-03-31 00:30:00", "login", "success")], "ts string, action string, outcome string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = history.hourly_access(audit, F.lit("2024-03-31 03:00:00").cast("timestamp_ntz"), 5, "Europe/Rome").collect()
    assert len(out) == 5 and sum(r["succeeded"] for r in out) == 1


def test_errors(spark):
    t = spark.createDataFrame([("Killed by SIGKILL",), ("bad",), (None,)], "e string")
    assert [r[0] for r in t.select(history.error_class(F.col("e"))).collect()] == ["out_of_memory", "other", None]


def test_storage_sizes_and_export(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "store/raw/a"))
    spark.range(10).write.parquet(str(tmp_path / "store/out/b"))
    spark.range(10).write.parquet(str(tmp_path / "store/else/c"))
    found = {r["prefix"]: r["objects"] for r in history.storage_sizes(spark, str(tmp_path / "store")).collect()}
    assert set(found) == {"raw", "out"} and all(n > 0 for n in found.values())
    preview.export_csv(spark.range(4), str(tmp_path / "p"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 4


def test_registered_queries_have_sql():
    import __spark_entry__ as entry
    from millrace.registry import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
