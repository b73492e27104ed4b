"""Operations on small tables with expectations written by hand."""

from datetime import date

import pytest
from millrace.functions.errors import OperationError, SourceNotFound
from millrace.functions.types import common_type
from millrace.operators import Context, apply
from pyspark.sql import types as T

SALES = [("IT", 100, date(2024, 1, 15)), ("FR", 50, date(2024, 3, 1)), ("DE", 250, date(2025, 2, 10)), ("IT", 300, date(2024, 6, 30))]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(SALES, "country string, sold long, day date")


def s(kind, **params):
    return {"type": kind, "params": params}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def refused(df, *steps, match=".", context=None):
    with pytest.raises(OperationError, match=match):
        apply(df, list(steps), context).collect()


@pytest.mark.parametrize(
    ("operator", "value", "expected"),
    [("eq", 100, {100}), ("ne", 100, {50, 250, 300}), ("gt", 100, {250, 300}), ("ge", 100, {100, 250, 300}), ("lt", 100, {50}), ("le", 100, {50, 100}), ("in", [50, 100], {50, 100}), ("in", [], set()),
     ("not_in", [50, 100], {250, 300}), ("between", [50, 100], {50, 100}), ("contains", "5", {50, 250}), ("starts_with", "3", {300}), ("ends_with", "50", {50, 250}), ("is_null", None, set()), ("is_not_null", None, {50, 100, 250, 300})],
)
def test_filter(sales, operator, value, expected):
    assert {r["sold"] for r in apply(sales, [s("filter", column="sold", operator=operator, value=value)]).collect()} == expected


def test_filter_dates_and_text(sales, spark):
    assert apply(sales, [s("filter", column="day", operator="between", value=["2024-01-15", "2024-03-01"])]).count() == 2
    refused(sales, s("filter", column="day", value="15/01/2024"), match="ISO")
    words = spark.createDataFrame([("a.b",), ("axb",)], "w string")
    assert rows(apply(words, [s("filter", column="w", operator="contains", value="a.b")])) == [("a.b",)]
    assert apply(words, [s("filter", column="w", operator="contains", value="a.b", regex=True)]).count() == 2
    assert {r[0] for r in apply(spark.createDataFrame([("alfa",), ("beta",), ("zeta",)], "w string"), [s("filter", column="w", operator="between", value=["a", "c"])]).collect()} == {"alfa", "beta"}
    refused(sales, s("filter", column="sold", operator="like", value=1), match="unknown operator")
    refused(sales, s("filter", column="sold"), match="missing")


def test_null_rules(spark):
    v = spark.createDataFrame([(1,), (None,), (3,)], "v long")
    assert rows(apply(v, [s("filter", column="v", operator="ne", value=1)])) == [(3,)]
    assert rows(apply(v, [s("filter", column="v", operator="not_in", value=[1])])) == [(3,)]
    assert apply(v, [s("drop_nulls")]).count() == 2
    assert [r[0] for r in apply(v, [s("sort", by="v", descending=True)]).collect()] == [3, 1, None]
    assert [r[0] for r in apply(v, [s("sort", by="v")]).collect()] == [1, 3, None]
    two = spark.createDataFrame([(1, "a"), (None, None)], "v long, s string")
    assert rows(apply(two, [s("fill_null", columns={"v": 0, "s": "-"})])) == [(0, "-"), (1, "a")]
    assert rows(apply(two, [s("fill_null", value=7)])) == [(1, "a"), (7, None)]
    empty = v.filter("v > 10")
    assert apply(empty, [s("fill_null", value=1), s("sort", by="v"), s("unique"), s("group_by", by="v", aggregations=[{"column": "v"}])]).count() == 0


def test_columns(sales):
    assert apply(sales, [s("rename", mapping={"sold": "n"}), s("select", columns=["n", "country"])]).columns == ["n", "country"]
    out = apply(sales, [s("compute", columns=[{"name": "a", "expr": "sold * 2"}, {"name": "b", "expr": "a + 1"}, {"name": "sold", "expr": "upper(country)"}])])
    assert ("FR", "FR", 100, 101) in {(r["country"], r["sold"], r["a"], r["b"]) for r in out.collect()}
    assert out.columns == ["country", "sold", "day", "a", "b"]
    for bad in (s("drop", columns=["x"]), s("select", columns=["x"]), s("rename", mapping={"x": "y"}), s("select", columns=[]), s("rename", mapping={"sold": "day"})):
        refused(sales, bad)
    for expr in ("(select 1)", "reflect('java.lang.System','getenv','A')", "", "1; 2", "java_method('a','b')"):
        refused(sales, s("compute", columns=[{"name": "z", "expr": expr}]))
    assert apply(sales, [s("compute", columns=[{"name": "z", "expr": "case when country = 'from select' then 1 else 0 end"}])]).count() == 4


def test_cast(spark):
    t = spark.createDataFrame([("1", "x"), ("abc", "2024-02-30")], "a string, b string")
    assert rows(apply(t, [s("cast", columns={"a": "int", "b": "date"})])) == [(1, None), (None, None)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        apply(t, [s("cast", columns={"a": "INT64"}, on_error="raise")]).collect()
    refused(t, s("cast", columns={"a": "blob"}), match="unknown type")


def test_unique(sales, spark):
    assert apply(sales, [s("unique", subset=["country"])]).count() == 3
    pick = lambda keep: {r["country"]: r["sold"] for r in apply(sales, [s("unique", subset=["country"], keep=keep, order_by="sold")]).collect()}
    assert pick("first")["IT"] == 100 and pick("last")["IT"] == 300
    assert apply(sales, [s("unique", subset="country", keep="none")]).count() == 2
    refused(sales, s("unique", subset=["country"], keep="first"), match="order_by")


def test_group_by(sales):
    out = apply(sales, [s("group_by", by="country", aggregations=[{"column": "sold"}, {"column": "sold", "func": "mean", "alias": "m"}, {"column": "day", "func": "n_unique"}])])
    assert ("IT", 400, 200.0, 2) in rows(out) and out.columns == ["country", "sold_sum", "m", "day_n_unique"]
    refused(sales, s("group_by", by="country", aggregations=[{"column": "sold", "func": "mode"}]), match="unknown function")
    refused(sales, s("group_by", by=[], aggregations=[{"column": "sold"}]))


def test_pivot_and_unpivot(spark):
    t = spark.createDataFrame([("IT", "2023", 10), ("IT", "2024", 20), ("FR", "2023", 5), ("FR", "2024", 7), ("IT", "2023", 3), ("DE", None, 1)], "c string, y string, n long")
    out = apply(t, [s("pivot", index="c", on="y", values="n")])
    assert out.columns == ["c", "2023", "2024"] and rows(out) == [("DE", None, None), ("FR", 5, 7), ("IT", 13, 20)]
    assert ("DE", 0, 0) in rows(apply(t, [s("pivot", index="c", on="y", values="n", func="count")]))
    assert apply(t, [s("pivot", index="c", on=["y", "n"], values="n")]).columns[1:] == ["2023_10", "2023_3", "2023_5", "2024_20", "2024_7"]
    refused(t, s("pivot", index="c", on="n", values="n"), match="more than 3", context=Context(spark, pivot_limit=3))
    wide = spark.createDataFrame([(1, 10, None), (2, 20, 40)], "id long, jan long, feb long")
    assert rows(apply(wide, [s("unpivot", index="id")])) == [(1, "feb", None), (1, "jan", 10), (2, "feb", 40), (2, "jan", 20)]
    mixed = spark.createDataFrame([(1, 10, "x")], "id long, a long, b string")
    assert rows(apply(mixed, [s("unpivot", index=["id"], variable_name="k", value_name="v")])) == [(1, "a", "10"), (1, "b", "x")]


def test_joins(sales, spark):
    names = spark.createDataFrame([("IT", "Italia", 9), ("FR", "Francia", 8), ("ES", "Spagna", 7), (None, "x", 6)], "country string, name string, sold long")
    ctx = Context(spark, {"names": names})
    count = lambda how: apply(sales, [s("join", right="names", on="country", how=how)], ctx).count()
    assert [count(h) for h in ("inner", "left", "right", "full", "semi", "anti")] == [3, 4, 5, 6, 3, 1]
    full = apply(sales, [s("join", right="names", on=["country"], how="full")], ctx)
    assert full.columns == ["country", "sold", "day", "name", "sold_right"] and "ES" in {r["country"] for r in full.collect()}
    assert apply(sales, [s("join", right="names", left_on="country", right_on="country")], ctx).columns == ["country", "sold", "day", "name", "sold_right"]
    sub = {"source": "names", "operations": [s("filter", column="name", operator="starts_with", value="I")]}
    assert apply(sales, [s("join", right=sub, on="country", how="semi")], ctx).count() == 2
    refused(sales, s("join", right="names", how="cross"), match="cross join", context=Context(spark, {"names": names}, cross_join_limit=15))
    assert apply(sales, [s("join", right="names", how="cross")], ctx).count() == 16
    refused(sales, s("join", right="names", on="country", how="theta"), context=ctx)
    refused(sales, s("join", right="none", on="country"), match="unknown source", context=ctx)
    refused(sales, s("join", right="names", left_on=["country", "sold"], right_on=["country"]), match="length", context=ctx)


def test_unions(sales, spark):
    other = spark.createDataFrame([("ES", 75.5, "web")], "country string, sold double, channel string")
    out = apply(sales, [s("union", right="o")], Context(spark, {"o": other}))
    assert out.count() == 5 and dict(out.dtypes)["sold"] == "double" and out.filter("country = 'ES' AND day IS NULL").count() == 1
    refused(sales, s("union", right="o", strategy="strict"), match="strict", context=Context(spark, {"o": other}))
    refused(sales, s("union", right="o", strategy="loose"), match="unknown strategy", context=Context(spark, {"o": other}))
    assert common_type(T.LongType(), T.StringType()) == T.StringType() and common_type(T.DateType(), T.TimestampNTZType()) == T.TimestampNTZType()
    with pytest.raises(OperationError):
        common_type(T.BooleanType(), T.LongType())


@pytest.mark.parametrize(
    "query",
    ["", "DROP TABLE x", "SELECT 1", "SELECT * FROM self; SELECT 1", "SELECT 1 FROM self) UNION ALL (SELECT 2", "SELECT * FROM parquet.`/tmp/x`, self", "SELECT reflect('java.lang.System','getenv','A') FROM self",
     "SELECT * FROM global_temp.x, self", "INSERT INTO self VALUES (1)", "SELECT * FROM self -- x", "SELECT * FROM elsewhere, self", "SELECT nope FROM self"],
)
def test_sql_refuses(sales, query):
    refused(sales, s("sql", query=query))


def test_sql_and_windows(sales):
    assert rows(apply(sales, [s("sql", query="SELECT country, sum(sold) AS n FROM self GROUP BY country"), s("filter", column="n", operator="gt", value=100)])) == [("DE", 250), ("IT", 400)]
    out = apply(sales, [s("compute", columns=[{"name": "t", "expr": "sum(sold) over (partition by country)"}])])
    assert {(r["country"], r["t"]) for r in out.collect()} == {("IT", 400), ("FR", 50), ("DE", 250)}


def test_loops(sales, spark):
    gt = s("filter", column="sold", operator="gt", value="{{ limit }}")
    loop = lambda **p: s("foreach", **p)
    assert apply(sales, [loop(items=[{"limit": 100}, {"limit": 250}], body=[gt])]).count() == 3
    keyed = apply(sales, [loop(items=[{"limit": 40}, {"limit": 250}], body=[gt], add_keys_as_columns=True)])
    assert keyed.columns == ["country", "sold", "day", "limit"] and keyed.filter("limit = 250").count() == 1
    driver = spark.createDataFrame([(100,), (300,)], "limit long")
    joined = apply(sales, [loop(driver="d", body=[gt])], Context(spark, {"d": driver}))
    assert joined.count() == 2
    branch = apply(sales, [loop(driver="d", body=[gt, s("sort", by="sold"), s("limit", n=1)])], Context(spark, {"d": driver}))
    assert rows(branch.select("sold")) == [(250,)]
    grouped = s("group_by", by="country", aggregations=[{"column": "sold", "alias": "n"}])
    assert apply(sales, [loop(items=[{"limit": 0}, {"limit": 60}], body=[gt, grouped])]).count() == 5
    assert apply(sales, [loop(items=[{"c": "IT"}], body=[s("compute", columns=[{"name": "x", "expr": "'{{c}}!'"}])])]).first()["x"] == "IT!"
    refused(sales, loop(items=[], body=[gt]), match="items")
    refused(sales, loop(items=[{"limit": 1}], body=[]), match="body")
    refused(sales, loop(items=[{"other": 1}], body=[gt]), match="unknown placeholder")
    refused(sales, loop(items=[{"n": i} for i in range(4)], body=[s("limit", n="{{n}}")]), match="more than 3", context=Context(spark, loop_limit=3))
    refused(sales, loop(items=[{"n": "x"}], body=[s("limit", n="{{n}}")]), match="iteration 1/1")


def test_errors_name_the_step(sales, spark):
    with pytest.raises(OperationError, match=r"step 2 \(drop\)"):
        apply(sales, [s("limit", n=1), s("drop", columns=["x"])])
    refused(sales, s("explode"), match="unknown operation")
    with pytest.raises(SourceNotFound):
        Context(spark).source({"path": "/nowhere/x.parquet"})
