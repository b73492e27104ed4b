"""Column names with dots and clashes through every operation; what isolated queries and loops refuse."""

import pytest
from millrace.functions.errors import OperationError
from millrace.functions.guards import run_isolated
from millrace.operators import Context, apply


@pytest.fixture(scope="module")
def dotted(spark):
    return spark.createDataFrame([(1, "x", 1.5, None), (2, "y", None, "b"), (2, "y", 2.0, "b"), (3, None, 2.5, "c")], "`a.b` long, `k.1` string, v double, `_on` string")


@pytest.mark.parametrize("steps,n", [
    ([{"type": "drop_nulls", "params": {}}], 1), ([{"type": "drop_nulls", "params": {"subset": ["k.1"]}}], 3), ([{"type": "fill_null", "params": {"value": "z"}}], 4), ([{"type": "fill_null", "params": {"value": 0}}], 4),
    ([{"type": "fill_null", "params": {"columns": {"k.1": "z"}}}], 4), ([{"type": "unique", "params": {"subset": ["a.b"]}}], 3), ([{"type": "unique", "params": {"subset": ["a.b"], "keep": "none"}}], 2),
    ([{"type": "unique", "params": {"subset": ["a.b"], "keep": "last", "order_by": ["v"]}}], 3), ([{"type": "sort", "params": {"by": ["k.1"]}}], 4), ([{"type": "select", "params": {"columns": ["a.b", "k.1"]}}], 4),
    ([{"type": "rename", "params": {"mapping": {"a.b": "c.d"}}}, {"type": "drop", "params": {"columns": ["c.d"]}}], 4), ([{"type": "cast", "params": {"columns": {"a.b": "str"}}}], 4),
    ([{"type": "filter", "params": {"column": "a.b", "operator": "gt", "value": 1}}], 3), ([{"type": "group_by", "params": {"by": ["k.1"], "aggregations": [{"column": "a.b", "func": "median"}, {"column": "v", "func": "n_unique"}]}}], 3),
    ([{"type": "pivot", "params": {"index": ["k.1"], "on": ["v"], "values": "a.b", "func": "count"}}], 3), ([{"type": "pivot", "params": {"index": ["k.1"], "on": ["_on"], "values": "a.b"}}], 3),
    ([{"type": "unpivot", "params": {"index": ["k.1"], "on": ["a.b", "v"]}}], 8), ([{"type": "foreach", "params": {"items": [{"x": 1}, {"x": 2}], "body": [{"type": "filter", "params": {"column": "a.b", "operator": "eq", "value": "{{x}}"}}, {"type": "drop_nulls", "params": {}}]}}], 1),
])
def test_dotted_names(spark, dotted, steps, n):
    out = apply(dotted, steps, Context(spark))
    assert out.count() == n
    if steps[0]["type"] == "pivot" and "v" in steps[0]["params"]["on"]:
        assert {r["k.1"]: r["1.5"] for r in out.collect()} == {"x": 1, "y": 0, None: 0}


def test_clashing_headers(spark):
    df = spark.createDataFrame([("k", "id", 1)], "id string, h string, v long")
    with pytest.raises(OperationError, match="index column as well"):
        apply(df, [{"type": "pivot", "params": {"index": ["id"], "on": ["h"], "values": "v"}}], Context(spark))


def test_isolation_is_by_containment(spark, tmp_path):
    spark.range(5).selectExpr("id", "'s' || id AS secret").write.mode("overwrite").saveAsTable("jt")
    spark.createDataFrame([(1,)], "x long").createOrReplaceGlobalTempView("sec")
    part = spark.table("jt").filter("id = 1")
    for good in ("SELECT * FROM self", "WITH a AS (SELECT * FROM input) SELECT * FROM a UNION ALL SELECT * FROM self", "SELECT * FROM self WHERE id = (SELECT max(id) FROM input)", "SELECT s.id FROM self s JOIN (VALUES (1)) t(i) ON s.id = t.i"):
        assert run_isolated(part, good).count() in (1, 2)
    for bad in (
        "SELECT * FROM self UNION ALL SELECT * FROM jt", "SELECT * FROM self WHERE id IN (SELECT id FROM jt)", "SELECT *, (SELECT max(x) FROM IDENTIFIER('global' || '_temp.sec')) FROM self",
        "WITH self AS (SELECT * FROM jt) SELECT * FROM self", "SELECT * FROM self JOIN global_temp.sec ON true", "SELECT * FROM self, LATERAL (SELECT * FROM jt)", "SELECT * FROM self, parquet.`/tmp`",
    ):
        with pytest.raises(OperationError):
            run_isolated(part, bad)
    within = spark.table("jt").filter("id IN (SELECT id FROM jt WHERE id < 3)")
    assert run_isolated(within, "SELECT count(*) AS n FROM self").first()["n"] == 3
    spark.sql("DROP TABLE jt")


def test_loops_look_at_the_plan(spark):
    df = spark.range(2000).selectExpr("id", "id % 7 AS g")
    late = [{"type": "group_by", "params": {"by": ["g"], "aggregations": [{"column": "id", "func": "max", "alias": "top"}]}}, {"type": "filter", "params": {"column": "top", "operator": "eq", "value": "{{x}}"}}]
    items = [{"x": 1990 + i} for i in range(20)]
    with pytest.raises(OperationError, match="row"):
        apply(df, [{"type": "foreach", "params": {"items": items, "body": [{"type": "filter", "params": {"column": "id", "operator": "lt", "value": "{{x}}"}}]}}], Context(spark, cross_join_limit=100))
    out = apply(df, [{"type": "foreach", "params": {"items": items, "body": late}}], Context(spark))
    assert out.count() == 7
    early = [{"type": "filter", "params": {"column": "id", "operator": "eq", "value": "{{x}}"}}]
    assert apply(df, [{"type": "foreach", "params": {"items": items, "body": early}}], Context(spark, cross_join_limit=1)).count() == 10


def test_loop_forms_agree_on_texts(spark):
    df = spark.range(20)
    body = [{"type": "filter", "params": {"column": "id", "operator": "lt", "value": "{{x}}"}}]
    for extra in ([], [{"type": "limit", "params": {"n": 100}}]):  # the second can't be a join
        with pytest.raises(Exception, match="10.5"):
            apply(df, [{"type": "foreach", "params": {"items": [{"x": "10.5"}], "body": body + extra}}], Context(spark)).collect()
        assert apply(df, [{"type": "foreach", "params": {"items": [{"x": "10"}], "body": body + extra}}], Context(spark)).count() == 10
