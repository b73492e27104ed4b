"""Flows of the named operations."""

from __future__ import annotations

from . import flow, step

REVENUE = "cast(round(l_extendedprice * (1 - l_discount), 4) as decimal(18, 4))"
SQL_REVENUE = "CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18, 4))"
ORDER = ["o_orderkey", "o_orderpriority"]

FLAGSHIP = [
    step("filter", column="l_shipdate", operator="between", value=["1995-01-01", "1996-12-31"]),
    step("compute", columns=[{"name": "revenue", "expr": REVENUE}]),
    step("join", right={"source": "orders", "operations": [step("select", columns=ORDER)]}, left_on=["l_orderkey"], right_on=["o_orderkey"]),
    step("group_by", by=["o_orderpriority"], aggregations=[{"column": "revenue", "func": "sum"}, {"column": "l_orderkey", "func": "count", "alias": "lines"}]),
    step("cast", columns={"revenue_sum": "float"}),
    step("sort", by="revenue_sum", descending=True),
]
flow("flagship", "lineitem", FLAGSHIP, f"""
SELECT o_orderpriority, CAST(sum({SQL_REVENUE}) AS DOUBLE) AS revenue_sum, count(l_orderkey) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate BETWEEN '1995-01-01' AND '1996-12-31' GROUP BY 1""")

# columns
flow("select_cols", "lineitem",
    [
        step("select", columns=["l_shipdate", "l_orderkey", "l_quantity"]),
        step("cast", columns={"l_shipdate": "str"}),
    ],
    "SELECT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate, l_orderkey, l_quantity FROM lineitem",
)
flow("drop_cols", "part", [step("drop", columns=["p_name", "p_type"])], "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
flow("rename_cols", "part",
    [
        step("rename", mapping={"p_partkey": "id", "p_name": "name"}),
        step("select", columns=["name", "id", "p_size"]),
    ],
    "SELECT p_name AS name, p_partkey AS id, p_size FROM part",
)
flow("cast_try", "part", [
    step("compute", columns=[{"name": "t", "expr": "case when p_size % 3 = 0 then 'abc' else cast(p_size as string) end"}, {"name": "d", "expr": "case when p_size % 2 = 0 then '2024-02-30' else '2024-02-28' end"}]),
    step("cast", columns={"t": "int", "d": "date", "p_size": "str", "p_retailprice": "int"}), step("cast", columns={"d": "str"}), step("select", columns=["p_partkey", "t", "d", "p_size", "p_retailprice"]),
], """SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 3 = 0 THEN 'abc' ELSE CAST(p_size AS VARCHAR) END AS BIGINT) AS t,
CAST(TRY_CAST(CASE WHEN p_size % 2 = 0 THEN '2024-02-30' ELSE '2024-02-28' END AS DATE) AS VARCHAR) AS d, CAST(p_size AS VARCHAR) AS p_size, CAST(trunc(p_retailprice) AS BIGINT) AS p_retailprice FROM part""")
flow("compute_seq", "part", [step("compute", columns=[
    {"name": "twice", "expr": "p_size * 2"}, {"name": "more", "expr": "twice + 1"}, {"name": "p_name", "expr": "upper(p_name)"},
    {"name": "class", "expr": "case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end"}, {"name": "head", "expr": "substring(p_brand, 1, 5) || '-' || length(p_name)"},
]), step("select", columns=["p_partkey", "twice", "more", "p_name", "class", "head"])], """
SELECT p_partkey, p_size * 2 AS twice, p_size * 2 + 1 AS more, upper(p_name) AS p_name,
CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, substring(p_brand, 1, 5) || '-' || length(p_name) AS head FROM part""")

# filters
for _name, _op in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    flow(f"filter_{_name}", "lineitem",
        [
            step("filter", column="l_quantity", operator=_name, value=25),
            step("select", columns=["l_orderkey", "l_partkey", "l_quantity"]),
        ],
        f"SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity {_op} 25",
    )
flow("filter_in", "orders",
    [
        step("filter", column="o_orderstatus", operator="in", value=["F", "P"]),
        step("filter", column="o_orderkey", operator="not_in", value=[1, 2, 3]),
        step("select", columns=["o_orderkey", "o_orderstatus"]),
    ],
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey NOT IN (1, 2, 3)",
)
flow("filter_between_date", "orders",
    [
        step("filter", column="o_orderdate", operator="between", value=["1995-03-01", "1995-06-30T00:00:00"]),
        step("select", columns=["o_orderkey", "o_totalprice"]),
    ],
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-06-30'",
)
flow("filter_text", "part",
    [
        step("filter", column="p_name", operator="contains", value="a"),
        step("filter", column="p_brand", operator="starts_with", value="Brand"),
        step("filter", column="p_brand", operator="ends_with", value="3"),
        step("filter", column="p_size", operator="contains", value="1"),
    ],
    "SELECT * FROM part "
    "WHERE contains(p_name, 'a') AND starts_with(p_brand, 'Brand') AND ends_with(p_brand, '3') AND contains(CAST(p_size AS VARCHAR), '1')",
)
flow("filter_regex", "part",
    [
        step("filter", column="p_brand", operator="contains", value="[12]$", regex=True),
        step("select", columns=["p_partkey", "p_brand"]),
    ],
    "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '[12]$')",
)
_NULLS = step("compute", columns=[{"name": "s", "expr": "case when p_size % 4 = 0 then null else p_size end"}, {"name": "b", "expr": "case when p_size % 3 = 0 then null else p_brand end"}])
_SQL_NULLS = "(SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS s, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS b FROM part)"
_SHORT = step("select", columns=["p_partkey", "s", "b"])
flow("filter_null", "part",
    [
        _NULLS,
        step("filter", column="s", operator="is_null"),
        step("filter", column="b", operator="is_not_null"),
        _SHORT,
    ],
    f"SELECT * FROM {_SQL_NULLS} WHERE s IS NULL AND b IS NOT NULL",
)
flow("filter_null_compare", "part",
    [
        _NULLS,
        step("filter", column="s", operator="ne", value=7),
        step("filter", column="b", operator="not_in", value=["Brand#1"]),
        _SHORT,
    ],
    f"SELECT * FROM {_SQL_NULLS} WHERE s <> 7 AND b NOT IN ('Brand#1')",
)

# rows
flow("sort_nulls_last", "part",
    [
        _NULLS,
        _SHORT,
        step("sort", by=["s", "p_partkey"], descending=[True, False]),
        step("limit", n=1900),
    ],
    f"SELECT * FROM {_SQL_NULLS} ORDER BY s DESC NULLS LAST, p_partkey LIMIT 1900",
)
flow("topk_sort", "orders",
    [
        step("select", columns=["o_orderkey", "o_totalprice"]),
        step("sort", by=["o_totalprice", "o_orderkey"], descending=True),
        step("limit", n=50),
    ],
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50",
)
flow("distinct_all", "orders", [step("select", columns=["o_orderstatus", "o_orderpriority"]), step("unique")], "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
flow("dedup_any", "orders", [step("unique", subset=["o_custkey"]), step("select", columns=["o_custkey"])], "SELECT DISTINCT o_custkey FROM orders")
flow("dedup_first", "orders",
    [
        step("select", columns=["o_custkey", "o_orderkey", "o_totalprice"]),
        step("unique", subset=["o_custkey"], keep="first", order_by=["o_totalprice"]),
    ],
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey "
    "ORDER BY o_totalprice, o_custkey, o_orderkey) = 1",
)
flow("dedup_last", "orders",
    [
        step("select", columns=["o_custkey", "o_orderkey", "o_totalprice"]),
        step("unique", subset="o_custkey", keep="last", order_by="o_totalprice"),
    ],
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey "
    "ORDER BY o_totalprice DESC, o_custkey, o_orderkey) = 1",
)
flow("dedup_none", "orders", [step("select", columns=["o_custkey", "o_orderpriority"]), step("unique", keep="none")], "SELECT o_custkey, o_orderpriority FROM orders GROUP BY 1, 2 HAVING count(*) = 1")
flow("fill_cols", "part", [_NULLS, _SHORT, step("fill_null", columns={"s": -1, "b": "none"})], f"SELECT p_partkey, COALESCE(s, -1) AS s, COALESCE(b, 'none') AS b FROM {_SQL_NULLS}")
flow("fill_value", "part", [_NULLS, _SHORT, step("fill_null", value=0)], f"SELECT p_partkey, COALESCE(s, 0) AS s, b FROM {_SQL_NULLS}")
flow("drop_null_rows", "part", [_NULLS, _SHORT, step("drop_nulls")], f"SELECT * FROM {_SQL_NULLS} WHERE s IS NOT NULL AND b IS NOT NULL")
flow("drop_null_subset", "part", [_NULLS, _SHORT, step("drop_nulls", subset=["s"])], f"SELECT * FROM {_SQL_NULLS} WHERE s IS NOT NULL")

# aggregates
_agg = lambda c, f, a=None, **o: {"column": c, "func": f, **({"alias": a} if a else {}), **o}
flow("agg_basic", "lineitem", [
    step("group_by", by=["l_returnflag", "l_linestatus"], aggregations=[_agg("l_quantity", "sum"), _agg("l_quantity", "min"), _agg("l_quantity", "max"), _agg("l_orderkey", "count"), _agg("l_discount", "mean", "avg_discount")]),
    step("compute", columns=[{"name": "avg_discount", "expr": "round(avg_discount, 6)"}]),
], "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sum, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, count(l_orderkey) AS l_orderkey_count, round(avg(l_discount), 6) AS avg_discount FROM lineitem GROUP BY 1, 2")
flow("agg_stats", "orders", [
    step("group_by", by=["o_orderstatus"], aggregations=[_agg("o_totalprice", "median", "m"), _agg("o_totalprice", "std", "s"), _agg("o_totalprice", "var", "v"), _agg("o_totalprice", "avg", "a")]),
    step("compute", columns=[{"name": "m", "expr": "round(m, 3)"}, {"name": "s", "expr": "round(s, 3)"}, {"name": "v", "expr": "round(v / 1000000, 3)"}, {"name": "a", "expr": "round(a, 3)"}]),
], "SELECT o_orderstatus, round(median(o_totalprice), 3) AS m, round(stddev_samp(o_totalprice), 3) AS s, round(var_samp(o_totalprice) / 1000000, 3) AS v, round(avg(o_totalprice), 3) AS a FROM orders GROUP BY 1")
flow("agg_distinct", "part",
    [
        _NULLS,
        step("group_by", by=["p_type"], aggregations=[_agg("b", "n_unique", "n"), _agg("b", "n_unique", "n_with_null", count_nulls=True), _agg("s", "count", "c"), _agg("s", "sum", "t")]),
    ],
    f"SELECT p_type, count(DISTINCT b) AS n, count(DISTINCT b) + max(CASE WHEN b IS NULL THEN 1 ELSE 0 END) AS n_with_null, count(s) AS c, CAST(sum(s) AS BIGINT) AS t FROM (SELECT x.*, p_type FROM {_SQL_NULLS} x JOIN part p ON p.p_partkey = x.p_partkey) GROUP BY 1",
)
flow("agg_first_last", "orders",
    [
        step("group_by", by=["o_custkey"], aggregations=[_agg("o_totalprice", "first", "first_price", order_by="o_orderkey"), _agg("o_totalprice", "last", "last_price", order_by="o_orderkey")]),
    ],
    "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price "
    "FROM orders GROUP BY 1",
)

# reshape
flow("pivot_one", "part", [step("pivot", index="p_type", on="p_brand", values="p_size")], 
    "SELECT p_type, " + ", ".join(f"CAST(sum(p_size) FILTER (p_brand = 'Brand#{i}') AS BIGINT) AS \"Brand#{i}\"" for i in range(1, 26)) + " FROM part GROUP BY p_type")
flow("pivot_count", "orders", [step("pivot", index=["o_orderpriority"], on=["o_orderstatus"], values="o_orderkey", func="count")], 
    "SELECT o_orderpriority, " + ", ".join(f"count(o_orderkey) FILTER (o_orderstatus = '{x}') AS \"{x}\"" for x in "FOP") + " FROM orders GROUP BY 1")
flow("pivot_two", "orders", [step("compute", columns=[{"name": "y", "expr": "year(o_orderdate) % 2"}]), step("pivot", index="o_orderpriority", on=["o_orderstatus", "y"], values="o_totalprice", func="max")], 
    "SELECT o_orderpriority, " + ", ".join(f"max(o_totalprice) FILTER (o_orderstatus = '{x}' AND year(o_orderdate) % 2 = {y}) AS \"{x}_{y}\"" for x in "FOP" for y in (0, 1)) + " FROM orders GROUP BY 1")
flow("unpivot_cols", "part",
    [
        _NULLS,
        _SHORT,
        step("unpivot", index=["p_partkey"], on=["s", "b"]),
    ],
    f"SELECT p_partkey, 's' AS variable, CAST(s AS VARCHAR) AS value FROM {_SQL_NULLS} UNION ALL SELECT p_partkey, 'b', b FROM {_SQL_NULLS}",
)
flow("unpivot_rest", "orders",
    [
        step("select", columns=["o_orderkey", "o_custkey", "o_totalprice"]),
        step("unpivot", index="o_orderkey", variable_name="name", value_name="v"),
    ],
    "SELECT o_orderkey, 'o_custkey' AS name, CAST(o_custkey AS DOUBLE) AS v FROM orders UNION ALL "
    "SELECT o_orderkey, 'o_totalprice', o_totalprice FROM orders",
)
flow("pivot_roundtrip", "orders", [
    step("group_by", by=["o_orderpriority", "o_orderstatus"], aggregations=[_agg("o_orderkey", "count", "n")]), step("pivot", index="o_orderpriority", on="o_orderstatus", values="n"), step("unpivot", index="o_orderpriority", variable_name="o_orderstatus", value_name="n"), step("drop_nulls"),
], "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")

# joins
_CUST = {"source": "customer", "operations": [step("filter", column="c_acctbal", operator="gt", value=2000), step("select", columns=["c_custkey", "c_name", "c_nationkey"])]}
_ORD = step("select", columns=["o_orderkey", "o_custkey"])
_SQL_C = "(SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_acctbal > 2000) c"
for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    flow(f"join_{_how}", "orders",
        [
            _ORD,
            step("filter", column="o_orderkey", operator="gt", value=100),
            step("join", right=_CUST, left_on="o_custkey", right_on="c_custkey", how=_how),
        ],
        f"SELECT o_orderkey, o_custkey, c.* FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100) o {_sql} {_SQL_C} ON o_custkey = c_custkey",
    )
flow("join_semi", "orders",
    [
        _ORD,
        step("join", right=_CUST, left_on="o_custkey", right_on="c_custkey", how="semi"),
    ],
    f"SELECT o_orderkey, o_custkey FROM orders SEMI JOIN {_SQL_C} ON o_custkey = c_custkey",
)
flow("join_anti", "orders",
    [
        _ORD,
        step("join", right=_CUST, left_on="o_custkey", right_on="c_custkey", how="anti"),
    ],
    f"SELECT o_orderkey, o_custkey FROM orders ANTI JOIN {_SQL_C} ON o_custkey = c_custkey",
)
flow("join_cross", "nation", [step("select", columns=["n_nationkey", "n_name"]), step("join", right="region", how="cross")], "SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation, region")
flow("join_same_key", "nation",
    [
        step("rename", mapping={"n_regionkey": "k"}),
        step("join", right={"source": "region", "operations": [step("rename", mapping={"r_regionkey": "k"}), step("filter", column="k", operator="gt", value=1)]}, on="k", how="full"),
    ],
    "SELECT COALESCE(n.n_regionkey, r.r_regionkey) AS k, n_nationkey, n_name, r_name FROM nation n FULL JOIN (SELECT * "
    "FROM region WHERE r_regionkey > 1) r ON n_regionkey = r_regionkey",
)
flow("join_overlap", "customer",
    [
        step("select", columns=["c_custkey", "c_name"]),
        step("rename", mapping={"c_custkey": "id", "c_name": "name"}),
        step("join", right={"source": "supplier", "operations": [step("select", columns=["s_suppkey", "s_name"]), step("rename", mapping={"s_suppkey": "id", "s_name": "name"})]}, on=["id"], how="left"),
    ],
    "SELECT c_custkey AS id, c_name AS name, s_name AS name_right FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey",
)
flow("join_subflow", "customer", [
    step("join", right={"source": "nation", "operations": [step("join", right="region", left_on="n_regionkey", right_on="r_regionkey"), step("select", columns=["n_nationkey", "r_name"])]}, left_on="c_nationkey", right_on="n_nationkey"),
    step("group_by", by="r_name", aggregations=[_agg("c_custkey", "count", "n")]),
], "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")

# unions
_AS = lambda p: {"source": p, "operations": [step("select", columns=[f"{p[0]}_name", f"{p[0]}_acctbal"]), step("rename", mapping={f"{p[0]}_name": "name", f"{p[0]}_acctbal": "balance"})]}
flow("union_strict", "customer",
    [
        *_AS("customer")["operations"],
        step("union", right=_AS("supplier"), strategy="strict"),
    ],
    "SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier",
)
flow("union_relaxed", "customer",
    [
        step("select", columns=["c_name", "c_mktsegment"]),
        step("rename", mapping={"c_name": "name"}),
        step("union", right=_AS("supplier")),
    ],
    "SELECT c_name AS name, c_mktsegment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL "
    "SELECT s_name, NULL, s_acctbal FROM supplier",
)
flow("union_types", "customer",
    [
        step("select", columns=["c_custkey"]),
        step("rename", mapping={"c_custkey": "v"}),
        step("union", right={"source": "part", "operations": [step("select", columns=["p_brand"]), step("rename", mapping={"p_brand": "v"})]}),
    ],
    "SELECT CAST(c_custkey AS VARCHAR) AS v FROM customer UNION ALL SELECT p_brand FROM part",
)
flow("union_many", "nation",
    [
        step("select", columns=["n_name"]),
        step("rename", mapping={"n_name": "name"}),
        step("union", right=[{"source": "region", "operations": [step("select", columns=["r_name"]), step("rename", mapping={"r_name": "name"})]}, _AS("supplier")]),
    ],
    "SELECT n_name AS name, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT r_name, NULL FROM region UNION ALL "
    "SELECT s_name, s_acctbal FROM supplier",
)

# sql, windows
flow("sql_node", "orders",
    [
        step("sql", query="WITH s AS (SELECT o_custkey, count(*) AS n FROM self GROUP BY o_custkey) SELECT n, count(*) AS customers FROM s GROUP BY n"),
    ],
    "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1",
)
flow("sql_rollup", "orders",
    [
        step("sql", query="SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM input GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    ],
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
)
flow("sql_except", "orders",
    [
        step("sql", query="SELECT o_custkey FROM self WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM self WHERE o_orderstatus = 'O'"),
    ],
    "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
)
flow("win_total", "orders",
    [
        step("select", columns=["o_orderkey", "o_custkey"]),
        step("compute", columns=[{"name": "n", "expr": "count(*) over (partition by o_custkey)"}, {"name": "top", "expr": "max(o_orderkey) over (partition by o_custkey)"}]),
    ],
    "SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_orderkey) OVER (PARTITION BY o_custkey) AS top "
    "FROM orders",
)
flow("win_running", "orders",
    [
        step("select", columns=["o_orderkey", "o_custkey"]),
        step("compute", columns=[{"name": "r", "expr": "sum(o_orderkey) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row)"}]),
    ],
    "SELECT o_orderkey, o_custkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS r "
    "FROM orders",
)
flow("win_rank", "orders",
    [
        step("compute", columns=[{"name": "r", "expr": "row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)"}]),
        step("filter", column="r", operator="le", value=3),
        step("select", columns=["o_orderkey", "o_custkey", "r"]),
    ],
    "SELECT o_orderkey, o_custkey, CAST(r AS INTEGER) AS r "
    "FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey "
    "ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3",
)

# loops
_LINES = step("select", columns=["l_orderkey", "l_quantity", "l_returnflag"])
flow("loop_items", "lineitem",
    [
        _LINES,
        step("foreach", items=[{"q": 10}, {"q": 20}, {"q": 45}], body=[step("filter", column="l_quantity", operator="gt", value="{{q}}")]),
    ],
    "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem, (VALUES (10), (20), (45)) v(q) WHERE l_quantity > q",
)
flow("loop_keys", "lineitem",
    [
        _LINES,
        step("foreach", items=[{"q": 10, "f": "R"}, {"q": 20, "f": "A"}], add_keys_as_columns=True, body=[step("filter", column="l_quantity", operator="lt", value="{{ q }}"), step("filter", column="l_returnflag", value="{{f}}"), step("group_by", by="l_returnflag", aggregations=[_agg("l_orderkey", "count", "n")])]),
    ],
    "SELECT l_returnflag, count(*) AS n, CAST(q AS BIGINT) AS q, f FROM lineitem, (VALUES (10, 'R'), (20, 'A')) v(q, f) "
    "WHERE l_quantity < q AND l_returnflag = f GROUP BY ALL",
)
flow("loop_driver", "customer",
    [
        step("select", columns=["c_custkey", "c_nationkey"]),
        step("foreach", driver={"source": "nation", "operations": [step("filter", column="n_regionkey", value=1), step("select", columns=["n_nationkey", "n_name"])]}, add_keys_as_columns=True, body=[step("filter", column="c_nationkey", value="{{n_nationkey}}")]),
    ],
    "SELECT c_custkey, c_nationkey, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "WHERE n_regionkey = 1",
)
flow("loop_branch", "part",
    [
        step("foreach", items=[{"c": "p_brand", "n": 3}, {"c": "p_type", "n": 2}], body=[step("group_by", by=["{{c}}"], aggregations=[_agg("p_partkey", "count", "n")]), step("sort", by="{{c}}"), step("rename", mapping={"{{c}}": "v"}), step("limit", n="{{n}}")]),
    ],
    "(SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY 1 LIMIT 3) UNION ALL (SELECT p_type, count(*) "
    "FROM part GROUP BY 1 ORDER BY 1 LIMIT 2)",
)
flow("loop_nested", "orders",
    [
        step("select", columns=["o_orderkey", "o_orderstatus", "o_orderpriority"]),
        step("foreach", items=[{"s": "F"}, {"s": "P"}], body=[step("filter", column="o_orderstatus", value="{{s}}"), step("foreach", items=[{"p": "1"}, {"p": "5"}], body=[step("filter", column="o_orderpriority", operator="starts_with", value="{{p}}")])]),
    ],
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders "
    "WHERE o_orderstatus IN ('F', 'P') AND left(o_orderpriority, 1) IN ('1', '5')",
)
