"""Ranked lexical search: against a plain version, bounds, batches and odd inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
from millrace.llm import lexical

from .brute import frame, sample

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = {}
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i))
        out[item] = [(r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def ranked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return {i: sorted(x) for i, x in out.items()}


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, term string, weight int")


def questions(rows, seed=5):
    rng = random.Random(seed)
    long = [t for _, t in rows if t and len(t.split()) > 20]
    out = [(i, " ".join(rng.sample(rng.choice(long).split(), 8)).upper()) for i in range(20)]
    return [*out, (50, "same SAME same"), (51, ""), (52, None), (53, "nowhere_at-all zzzz"), (54, " ".join(t for t in long[:5]))]


def test_ranking_is_exact(spark):
    rows = [(i, t) for i, t in sample(7, 60)]
    asked = questions(rows)
    want = {i: x for i, x in plain(rows, asked).items() if x}
    found = lexical.rank(frame(spark, rows), items_of(spark, asked))
    assert found.columns == ["item", "item_id", "rank", "doc_id", "score"] and ranked(found) == want
    # batches of queries, few documents at a time and a floor from half of all rows change nothing
    assert ranked(lexical.rank(frame(spark, rows).repartition(5), items_of(spark, asked), batch_terms=40, first=2, at_once=7)) == want


def test_ties_repeats_and_nulls(spark):
    rows = [(i, "a b c") for i in range(30, 0, -1)] + [(5, "a b c"), (None, "a b c"), (100, None), (101, "...")]
    found = ranked(lexical.rank(frame(spark, rows).repartition(3), items_of(spark, [(1, "a c"), (2, "b b")]), k=6))
    assert [d for _, d, _ in found[1]] == [1, 2, 3, 4, 5, 5] and len({s for _, _, s in found[1]}) == 1
    few = lexical.rank(frame(spark, [(None, "a z"), (3, "b z"), (2, "a z")]), items_of(spark, [(7, "a"), (7, "b")]))
    assert sorted((r["item_id"], r["rank"], r["doc_id"]) for r in few.collect() if r["doc_id"] is not None) == [(7, 1, 2), (7, 1, 3)] and few.filter("doc_id IS NULL").first()["rank"] == 2


def test_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b")]), items_of(spark, [(1, "a")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (frame(spark, [(1, None)]), items)):
        found = lexical.rank(d, i)
        assert found.columns == ["item", "item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_bounds_hold_and_prune():
    """No bound is below a score, and most pairs are never scored."""
    rng = random.Random(1)
    texts = [[f"c{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.choice([40, 120, 400]))] for _ in range(2000)]
    passages = [[f"r{q}x{j}" for j in range(6)] + ["c1", "c2"] for q in range(10)]
    for q, words in enumerate(passages):
        for _ in range(12):
            texts[rng.randrange(2000)] += words
    pages = [lexical.Page(i, Counter(w.encode() for w in t), len(t)) for i, t in enumerate(texts)]
    total = sum(p.n for p in pages)
    queries = lexical.Queries([(q, w.encode(), 1, 7000 if w[0] == "r" else 500) for q, words in enumerate(passages) for w in words])
    best = lexical.Best([0] * 10, 10)
    pairs = [lexical.search(pages[s : s + 500], queries, best, 2000, total) for s in range(0, 2000, 500)]
    assert sum(x for x, _ in pairs) == 20_000 and sum(x for _, x in pairs) < 20_000 // 3
    for p in pages[:50]:
        width = 64
        sketch = np.zeros((width, 1))
        values = lexical.impacts(np.array(list(p.tf.values())), p.n, 2000, total)
        at = (lexical.hashes_of(p.tf, len(p.tf)) & np.uint64(width - 1)).astype(int)
        np.maximum.at(sketch[:, 0], at, values)
        assert all(b >= lexical.exact_score(p, queries, q, 2000, total) for q, b in enumerate(queries.bounds(sketch)[:, 0]))


def test_terms_split_as_the_pattern(spark):
    for text in ("Ab-c_d é̂́x ÀÉ 1²3 a b \x7f\x80 naïve", "", None, "İstanbul I"):
        assert [t.decode() for t in lexical.terms_of(text)] == terms(text)
    marked = lexical._marked(lexical.query_terms(items_of(spark, [(1, "a b c d")])))
    assert np.unpackbits(marked).sum() == 4
