"""Loops over ranges of values against plain Python; what their plans hold."""

import datetime as dt
import random

import pytest
from millrace.functions.errors import OperationError
from millrace.operators import Context, apply
from millrace.operators.loops import _nested

RNG = random.Random(4)
INF, NAN = float("inf"), float("nan")
DAY = dt.date(2024, 1, 1)
VALUES = {
    "long": lambda: RNG.choice([7, RNG.randrange(-50, 200)]),
    "double": lambda: RNG.choice([7.5, -0.0, 0.0, INF, -INF, NAN, RNG.uniform(-9, 99)]),
    "date": lambda: DAY + dt.timedelta(days=RNG.randrange(300)),
    "string": lambda: RNG.choice(["", "é", "aa", "".join(RNG.choices("abc", k=3))]),
    "timestamp": lambda: dt.datetime(2024, 10, 27, 0, 0) + dt.timedelta(minutes=RNG.randrange(300)),
    "decimal(9,2)": lambda: __import__("decimal").Decimal(RNG.randrange(-500, 5000)) / 100,
}


def body(**bounds):
    return [{"type": "filter", "params": {"column": "v", "operator": op, "value": "{{" + key + "}}"}} for op, key in bounds.items()]


def looped(df, items, steps, **limits):
    step = {"type": "foreach", "params": {"driver": "d", "body": steps, "add_keys_as_columns": True}}
    return apply(df, [step], Context(df.sparkSession, {"d": items}, **limits))


def order(x):
    return (1, 0) if x != x else (0, x)


@pytest.mark.parametrize("kind", VALUES)
def test_ranges_of_every_type(spark, kind):
    rows = [(i, None if i % 11 == 0 else VALUES[kind]()) for i in range(150)]
    items = [(None if i == 5 else VALUES[kind](), None if i == 6 else VALUES[kind]()) for i in range(40)]
    df, ranges = spark.createDataFrame(rows, f"id long, v {kind}"), spark.createDataFrame(items, f"lo {kind}, hi {kind}")
    tests = {
        ("ge", "lt"): lambda v, lo, hi: order(lo) <= order(v) < order(hi), ("gt", "le"): lambda v, lo, hi: order(lo) < order(v) <= order(hi),
        ("gt",): lambda v, lo, hi: order(v) > order(lo), ("lt",): lambda v, lo, hi: order(v) < order(lo),
    }
    for ops, holds in tests.items():
        out = looped(df, ranges, body(**dict(zip(ops, ("lo", "hi")))))
        assert not _nested(out)
        used = lambda lo, hi: None not in ((lo, hi) if len(ops) == 2 else (lo,))  # noqa: B023, E731
        expected = sorted((i, j) for i, v in rows for j, (lo, hi) in enumerate(items) if v is not None and used(lo, hi) and holds(v, lo, hi))
        number = {}
        for j, r in enumerate(ranges.collect()):
            number.setdefault(repr(tuple(r)), []).append(j)
        found = sorted((r["id"], repr((r["lo"], r["hi"]))) for r in out.select("id", "lo", "hi").collect())
        names = {j: n for n, js in number.items() for j in js}
        assert found == sorted((i, names[j]) for i, j in expected)


def test_bands_bounds_and_limits(spark):
    """A third of all rows share a value; items repeat; ranges the wrong way round and empty tables give nothing."""
    df = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 500, id) AS v", "'x' AS _band", "1 AS _low")
    items = spark.createDataFrame([(i * 10, i * 10 + 3.0) for i in range(300)] + [(500, 501.0)] * 2 + [(9, 2.0)], "lo int, hi double")
    steps = [*body(ge="lo", lt="hi"), {"type": "group_by", "params": {"by": ["_band"], "aggregations": [{"column": "id", "func": "count", "alias": "n"}]}}]
    out = looped(df, items, steps)
    assert not _nested(out) and sorted(out.columns) == ["_band", "hi", "lo", "n"]
    values = [500 if i % 3 == 0 else i for i in range(3000)]
    expected = sorted((lo, hi, n) for lo, hi in [(i * 10, i * 10.0 + 3) for i in range(300)] + [(500, 501.0)] * 2 if (n := sum(lo <= v < hi for v in values)))
    assert sorted((r["lo"], r["hi"], r["n"]) for r in out.collect()) == expected
    with pytest.raises(OperationError, match="times, more than 100"):
        looped(df, items, steps, cross_join_limit=100)
    assert looped(df, items, steps, cross_join_limit=20_000).count() == len(expected)  # 909 000 pairs in a nested loop
    assert looped(df.limit(0), items, steps).count() == looped(df, items.limit(0), steps).count() == 0


def test_many_items_are_merged_and_equal_ones_done_once(spark):
    df = spark.range(400).selectExpr("id", "id % 40 AS v", "id % 2 AS k")
    made = [(i, -0.0 if i % 200 == 3 else float(i % 40), i % 40 + 3.0) for i in range(2000)] + [(9000, None, 3.0)]
    items = spark.createDataFrame(made, "i int, lo double, hi double")
    steps = [*body(ge="lo", lt="hi"), {"type": "group_by", "params": {"by": ["k"], "aggregations": [{"column": "id", "func": "count", "alias": "n"}]}}]
    out = looped(df, items, steps)
    assert out.columns == ["k", "i", "lo", "hi", "n"] and out.schema["lo"].dataType.simpleString() == "double"
    want = sorted((k, i, str(lo), hi, n) for i, lo, hi in made if lo is not None for k in (0, 1) if (n := sum(lo <= x % 40 < hi and x % 2 == k for x in range(400))))
    assert sorted((r["k"], r["i"], str(r["lo"]), r["hi"], r["n"]) for r in out.collect()) == want
    assert "SortMergeJoin [_pass" in out._jdf.queryExecution().sparkPlan().toString()
    bands = spark.range(3000).selectExpr("id AS i", "cast(id AS double) AS lo", "cast(id + 200 AS double) AS hi")  # some 600 000 when repeated
    wide = looped(df, bands, body(ge="lo", lt="hi"))
    assert "BroadcastHashJoin" not in wide._jdf.queryExecution().sparkPlan().toString() and not _nested(wide)
    assert wide.count() == sum(sum(i <= x % 40 < i + 200 for x in range(400)) for i in range(40))


def test_few_passes_over_many_rows_are_no_cross_join(spark):
    df = spark.range(17_000_000).withColumnRenamed("id", "v")
    items = [{"q": 16_999_990}, {"q": 16_999_995}, {"q": 20_000_000}]
    late = [{"type": "rename", "params": {"mapping": {"v": "w"}}}, {"type": "filter", "params": {"column": "w", "operator": "ge", "value": "{{q}}"}}]
    for steps in (body(ge="q"), late, [*body(ge="q"), {"type": "filter", "params": {"column": "v", "operator": "lt", "value": 16_999_999}}]):
        got = apply(df, [{"type": "foreach", "params": {"items": items, "body": steps}}], Context(spark)).count()
        assert got == (13 if len(steps) == 2 and steps is not late else 15)
    whole = apply(df.withColumn("w", df["v"] + 1), [{"type": "foreach", "params": {"items": items, "body": body(gt="q")}}], Context(spark))
    whole.write.format("noop").mode("overwrite").save()  # both columns read
    assert whole.agg({"w": "max"}).first()[0] == 17_000_000
    with pytest.raises(OperationError, match="cross join"):
        looped(df, spark.range(1001).withColumnRenamed("id", "q"), body(ge="q"))


def test_a_list_of_items_goes_to_the_rows(spark):
    df = spark.range(100).selectExpr("id", "id % 2 AS k", "id AS v")
    steps = [*body(lt="q"), {"type": "filter", "params": {"column": "k", "value": "{{f}}"}}, {"type": "group_by", "params": {"by": ["k"], "aggregations": [{"column": "id", "func": "count", "alias": "n"}]}}]
    out = apply(df, [{"type": "foreach", "params": {"items": [{"q": 10, "f": 0}, {"q": 20, "f": 1}], "body": steps, "add_keys_as_columns": True}}], Context(spark))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r["k"], r["n"], r["q"], r["f"]) for r in out.collect()) == [(0, 5, 10, 0), (1, 10, 20, 1)]
