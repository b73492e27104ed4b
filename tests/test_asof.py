"""As-of merges against a search in each key's ranges, with hot keys cut into slices, ties, nulls and odd names."""

import random

from millrace.plans.business import as_of, valid_at


def test_as_of(spark):
    rng = random.Random(6)
    ranges = [(k, t, f"{k}-{t}-{i}", t + rng.randrange(6)) for i, (k, t) in enumerate((rng.choice(["hot"] * 8 + ["a", "b"]), rng.randrange(300)) for _ in range(200))] + [(None, 3, "x", 9), ("a", None, "y", 9)]
    facts = [(i, rng.choice(["hot"] * 8 + ["a", "b", "none"]), rng.randrange(-5, 320)) for i in range(1500)] + [(9000, None, 5), (9001, "hot", None), (9002, "a", 10), (9002, "a", 10)]
    left, right = spark.createDataFrame(facts, "id long, `k.1` string, time long"), spark.createDataFrame(ranges, "`k.1` string, since int, row string, until int")

    def want(end):
        out = []
        for i, k, t in facts:
            held = [(s, r, u) for q, s, r, u in ranges if q == k and k is not None and s is not None and t is not None and s <= t]
            best = max(held, default=None)
            out.append((i, best[1] if best and (not end or best[2] >= t) else None))
        return sorted(out, key=repr)

    for end in (None, "until"):
        for rows in (10**6, 700, 40):
            out = as_of(left, right, "k.1", "time", "since", end, slice_rows=rows)
            assert out.columns == ["id", "k.1", "time", "since", "row", "until"]
            assert sorted(((r["id"], r["row"]) for r in out.collect()), key=repr) == want(end)
    assert as_of(left.limit(0), right, "k.1", "time", "since").count() == 0 and as_of(left, right.limit(0), "k.1", "time", "since").filter("row IS NULL").count() == len(facts)
    one = valid_at(left.withColumnRenamed("k.1", "k"), right.withColumnRenamed("k.1", "k"), "k", "time", "since", None)
    assert sorted(((r["id"], r["row"]) for r in one.collect()), key=repr) == want(None)


def test_columns_nobody_reads_are_not_shuffled_and_null_keys_are_spread(spark):
    facts = spark.range(600).selectExpr("id", "IF(id % 2 = 0, NULL, 'a') AS k", "id AS time", "concat('unread', id) AS more")
    ranges = spark.range(0, 600, 10).selectExpr("'a' AS k", "id AS since", "id AS row")
    for rows in (10**6, 50):
        out = as_of(facts, ranges, "k", "time", "since", slice_rows=rows).select("id", "row")
        if rows == 10**6:  # slices of null keys are found by a hash of all columns, before the shuffle
            assert "unread" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, out.collect())) == [(i, i // 10 * 10 if i % 2 else None) for i in range(600)]
