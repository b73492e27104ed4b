"""Medians by ranks against Spark's own, and graphs by doubled pointers against plain rounds."""

import random

import pytest
from millrace.functions import storage
from millrace.operators import Context, apply
from millrace.plans import graph
from pyspark.sql import functions as F

BY_MEDIAN = [{"type": "group_by", "params": {"by": ["k.1"], "aggregations": [
    {"column": "v", "func": "median", "alias": "m"}, {"column": "v", "func": "count", "alias": "k"}, {"column": "w", "func": "median"}, {"column": "v", "func": "median", "approximate": True, "alias": "near"}]}}]


def test_medians_of_any_group(spark):
    rnd = random.Random(7)
    rows = [("hot", rnd.choice([1.5, rnd.gauss(0, 1e6), None]), rnd.randrange(5)) for _ in range(9001)]
    rows += [(None, float(i), -i) for i in range(10)] + [("one", 0.25, 3), ("none", None, None), ("nan", 1.0, 1), ("nan", float("nan"), 1), ("nan", float("nan"), 1), ("inf", float("inf"), 1), ("zero", -0.0, 1), ("zero", 0.0, 1)]
    df = spark.createDataFrame(rows, "`k.1` string, v double, w long")
    plain = apply(df, BY_MEDIAN, Context(spark))
    ranked = apply(df, BY_MEDIAN, Context(spark, median_rows=100))
    assert ranked.columns == plain.columns == ["k.1", "m", "k", "w_median", "near"] and ranked.schema.simpleString() == plain.schema.simpleString()
    told = lambda t: sorted(repr([x + 0.0 if isinstance(x, float) else x for x in r]) for r in t.collect())  # noqa: E731  (-0 is 0)
    assert told(ranked) == told(plain)
    assert apply(df.limit(0), BY_MEDIAN, Context(spark, median_rows=0)).count() == 0


def test_medians_of_decimals_and_whole_groups_of_one_value(spark):
    df = spark.range(3001).select(F.lit(1).alias("k"), F.col("id").cast("decimal(20,3)").alias("d"), F.lit(7).alias("c"))
    steps = [{"type": "group_by", "params": {"by": ["k"], "aggregations": [{"column": "d", "func": "median"}, {"column": "c", "func": "median"}]}}]
    assert [tuple(r) for r in apply(df, steps, Context(spark, median_rows=10)).collect()] == [(1, 1500.0, 7.0)]


def brute_reach(edges, seeds):
    depth, newest = {s: 0 for s in seeds}, set(seeds)
    while newest:
        newest = {b for a, b in edges if a in newest and b not in depth} - set(depth)
        depth |= {n: max(depth.values()) + 1 for n in newest}
    return depth


@pytest.mark.parametrize("seed", range(2))
def test_reach_and_layers_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    chain = [(i, i + 1) for i in range(100, 140)]
    links = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(34)] + chain + [(5, 100), (120, 7), (140, 5), (200, 201), (201, 200), (None, 3), (3, None)]
    edges, seeds = spark.createDataFrame(links, "source long, target long"), [0, 5]
    found = graph.reach(edges, spark.createDataFrame([(s,) for s in [*seeds, 0]], "id long"), hops=1)
    assert {r["id"]: r["depth"] for r in found.collect()} == brute_reach([x for x in links if None not in x], seeds) and found.count() == found.select("id").distinct().count()
    forward = [(min(x), max(x)) for x in links if None not in x and x[0] != x[1] and x[0] < 200]
    nodes = [(i,) for i in range(150)]
    layer = {i: 0 for (i,) in nodes}
    for b in sorted(layer):
        layer[b] = max((layer[a] + 1 for a, t in forward if t == b), default=0)
    got = graph.layers(spark.createDataFrame(forward, "source long, target long"), spark.createDataFrame(nodes, "id long")).collect()
    assert {r["id"]: r["layer"] for r in got} == layer and len(got) == 150


def test_trees_of_any_depth(spark, monkeypatch):
    n, rounds = 1500, []
    parents = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    plain = storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, folder=None: rounds.append(folder) or plain(df, folder))
    down = graph.tree_closure(parents, spark.createDataFrame([(10,)], "id long"))
    assert {r["id"]: r["depth"] for r in down.collect()} == {i: i - 10 for i in range(10, n)} and len(rounds) < 40
    up = graph.tree_closure(parents, spark.createDataFrame([(1200,), (40,)], "id long"), up=True)
    assert {r["id"]: r["depth"] for r in up.collect()} == {i: 40 - i if i <= 40 else 1200 - i for i in range(1201)} and len(rounds) < 80
    assert rounds and not any(spark._jvm.java.io.File(f.removeprefix("file:")).exists() for f in rounds)
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent_id long")
    assert {r["id"]: r["depth"] for r in graph.tree_closure(circle, spark.createDataFrame([(1,)], "id long"), up=True).collect()} == {1: 0, 2: 1, 3: 2}


def test_layers_with_a_cycle_take_plain_rounds(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 5)], "source long, target long")
    got = {r["id"]: r["layer"] for r in graph.layers(edges, spark.range(1, 7)).collect()}
    assert got[1] == 0 and got[5] == 1 and got[6] == 0 and got[2] > 1


def test_medians_in_pivots_and_loops(spark):
    df = spark.range(900).selectExpr("id % 2 AS k", "CASE WHEN id % 3 < 2 THEN concat('c', id % 3) END AS h", "cast(id * 7 % 101 AS double) AS v", "id AS o")
    pivot = [{"type": "pivot", "params": {"index": ["k"], "on": ["h"], "values": "v", "func": "median"}}]
    plain, ranked = (apply(df, pivot, Context(spark, median_rows=n)) for n in (10**6, 50))
    assert plain.columns == ranked.columns == ["k", "c0", "c1"] and sorted(plain.collect()) == sorted(ranked.collect()) and plain.count() == 2
    picked = [{"column": "v", "func": "median", "alias": "m"}, {"column": "v", "func": "last", "alias": "l", "order_by": "o"}]
    body = [{"type": "filter", "params": {"column": "k", "operator": "eq", "value": "{{x}}"}}, {"type": "group_by", "params": {"by": ["h"], "aggregations": picked}}]
    loop = [{"type": "foreach", "params": {"items": [{"x": 0}, {"x": 1}], "body": body, "add_keys_as_columns": True}}]
    want = df.groupBy("h", "k").agg(F.median("v").alias("m"), F.max_by("v", "o").alias("l")).select("h", "m", "l", "k").collect()
    for n in (10**6, 50):
        got = apply(df, loop, Context(spark, median_rows=n)).select("h", "m", "l", "x").collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_rows_of_a_hot_group_stay_where_they_are(spark):
    df = spark.range(5000).selectExpr("IF(id % 3 > 0, 'hot', 'cold') AS k", "id AS v")
    out = apply(df, [{"type": "group_by", "params": {"by": ["k"], "aggregations": [{"column": "v", "func": "median", "alias": "m"}]}}], Context(spark, median_rows=10))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin [coalesce(k0" not in plan and sorted(map(tuple, out.collect())) == [("cold", 2499.0), ("hot", 2500.0)]


def test_layers_of_a_path_with_many_links_beside_it(spark, monkeypatch):
    n, rounds, plain = 1200, [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, folder=None: rounds.append(folder) or plain(df, folder))
    links = [(i, i + 1) for i in range(n)] + [(i, i + 7) for i in range(0, n - 7, 20)]
    got = graph.layers(spark.createDataFrame(links, "source long, target long"), spark.range(n + 1)).collect()
    assert {r["id"]: r["layer"] for r in got} == {i: i for i in range(n + 1)} and len(rounds) < 50  # 60 nodes one after the other have two links


def test_many_nodes_are_merged(spark):
    merged, few = graph._merged(spark.range(200), most=100), graph._merged(spark.range(50), most=100)
    plans = [spark.range(300).join(t, "id")._jdf.queryExecution().sparkPlan().toString() for t in (merged, few)]
    assert "SortMergeJoin" in plans[0] and "Broadcast" in plans[1]
