"""A sample of the registered queries against their SQL in DuckDB, on the smallest tables if they are there."""

import math
import os

import pytest
from millrace.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
NAMES = ["flagship", "cast_try", "dedup_last", "dedup_none", "agg_distinct", "pivot_two", "unpivot_cols", "join_full", "union_types", "loop_keys", "chart_series", "hourly_access", "schedule_grid", "neighbourhood", "price_asof_next", "reuse_prefix"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(x):
    return float(f"{float(x):.9g}") if isinstance(x, float) and not math.isnan(x) or type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    expected = sorted((tuple(plain(v) for v in r) for r in cursor.fetchall()), key=repr)
    found = QUERIES[name](spark, DATA)
    assert sorted(found.columns) == sorted(names)
    assert sorted((tuple(plain(r[c]) for c in names) for r in found.collect()), key=repr) == expected
