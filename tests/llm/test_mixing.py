import random
from collections import defaultdict

from millrace.llm.mixing import mix, mixed_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies string, size string"


def water(sizes, weights, share, cap):
    """Clamp and reshare by hand until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        given = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if given[s] > cap * sizes[s]]
        if not over:
            return fixed | given
        fixed |= {s: cap * sizes[s] for s in over}


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], SCHEMA)


def test_targets_and_taken(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(["b", "a", None, "c", "é", "hot", "hot", "hot", "hot"])) for i in range(3000)]
    rows += [(10_000, None, "a"), (10_001, "", "empty"), (10_002, "x y", "a"), (10_002, "x y", "a")]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    expected = water(dict(sizes), (3, 1, 2), 1.5, 2.0)
    found = mix(made(spark, rows)).collect()
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - expected[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 30 for s in sizes)
    assert sorted(found, key=str) == sorted(mix(made(spark, rows)).collect(), key=str)


def test_documents_are_repeated_with_all_columns(spark):
    docs = made(spark, [(1, "a b c", "s"), (2, "d e f", "s"), (3, None, None)])
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mix(docs).collect()}
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in copies.items() if v}


def test_empty(spark):
    assert mix(made(spark, [])).count() == 0 and mixed_documents(made(spark, [])).count() == 0
