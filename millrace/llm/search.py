"""Exact top-k search by inner product with multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table


def haar(width: int) -> np.ndarray:
    """The orthogonal Haar basis of a power of two: the first ``s`` rows span what is constant on ``s`` equal parts."""
    rows = np.ones((1, 1))
    while len(rows) < width:
        rows = np.vstack([np.kron(rows, [1, 1]), np.kron(np.eye(len(rows)), [1, -1])]) / np.sqrt(2)
    return rows


def rotation(sample: np.ndarray) -> np.ndarray:
    """An orthogonal map after which the means of ``s`` segments hold the ``s`` strongest directions of ``sample``, for every level.

    Inner products stay the same, so the bounds stay bounds whatever the sample; only their tightness depends on it.
    """
    width = sample.shape[1]
    _, directions = np.linalg.eigh(sample.T @ sample)
    return directions[:, ::-1] @ haar(width)


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of ``segments`` equal parts of each row, scaled by the root of a part's length.

    Then ``|<x, y> - <means>| <= <deviations>`` part by part (Cauchy-Schwarz on what the means leave), so the inner
    product of two rows of statistics bounds the inner product of the vectors from above, more tightly with more parts. For
    vectors of given lengths that is a lower bound of their distance.
    """
    parts = x.reshape(len(x), segments, -1)
    root = np.sqrt(parts.shape[2])
    return np.hstack([parts.mean(2) * root, parts.std(2) * root])


def padded(x: np.ndarray) -> np.ndarray:
    """Rows as floats, filled with zeros up to a power of two."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    return np.pad(x.astype(np.float64), ((0, 0), (0, width - x.shape[1])))


def search_block(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, c_ids: np.ndarray, c: np.ndarray, turn: np.ndarray, k: int, at_once: int = 64) -> tuple[list[np.ndarray], list[int]]:
    """The ``k`` best ``(query, row, score)`` in a block for each query, ties to smaller row ids, and how many pairs were left
    before the first level and after each.

    Coarse to fine, for some queries at once: a pair is out if its bound at one resolution is below the query's floor, the k-th
    best score known so far (``floors``, or the exact scores of the k rows with the highest bound here). Survivors of the
    finest level are scored exactly, in integers.
    """
    qs, cs = padded(q) @ turn, padded(c) @ turn
    width = cs.shape[1]
    levels = [1 << i for i in range(width.bit_length() - 1)] or [1]
    of_rows = [segment_statistics(cs, s).T for s in levels]
    out, alive_after = [], [0] * (len(levels) + 1)
    size = np.linalg.norm(qs, axis=1)[:, None] * np.linalg.norm(cs, axis=1)[None, :].max(initial=0)
    for start in range(0, len(q), at_once):
        part = slice(start, start + at_once)
        alive = q_ids[part, None] != c_ids[None, :]
        floor = floors[part].copy()
        alive_after[0] += int(alive.sum())
        for level, (s, right) in enumerate(zip(levels, of_rows, strict=True)):
            bound = segment_statistics(qs[part], s) @ right
            bound += 1e-9 * size[part] + 1e-6  # rounding can't put a bound below its score
            if s == levels[-1] or level == 0:
                best = np.argpartition(-np.where(alive, bound, -np.inf), min(k, len(c)) - 1, axis=1)[:, :k]
                for i, rows in enumerate(best):
                    rows = rows[alive[i, rows]]
                    if len(rows) >= k:
                        floor[i] = max(floor[i], int((c[rows] @ q[start + i]).min()))
            alive &= bound >= floor[:, None]
            alive_after[level + 1] += int(alive.sum())
        for i in range(len(alive)):
            rows = np.flatnonzero(alive[i])
            scores = c[rows] @ q[start + i]
            if len(rows) > 4 * k:  # all that tie with the k-th stay
                keep = scores >= np.partition(scores, -k)[-k]
                rows, scores = rows[keep], scores[keep]
            order = np.lexsort((c_ids[rows], -scores))[:k]
            out.append(np.stack([np.full(len(order), q_ids[start + i]), c_ids[rows[order]], scores[order]]))
    return out, alive_after


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, query_block: int = 2048, row_block: int = 8192, first: int = 16, sample: int = 4096) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows with the highest inner product for each query row.

    Components become ``floor(scale * x)``. Queries and rows are cut into blocks by a hash of their ids (so equal vectors
    spread), and each block of queries meets each block of rows once: exact whatever the data, and no task
    holds more than two blocks. A first round searches one row in ``first``; the k-th best score found there is each
    query's floor in the second round, over all other rows, so that every block knows what the others' rows reach. Both
    rounds' best are then ranked per query.

    The rotation before the segments are cut is fitted on at most ``sample`` vectors, by hash of the id, and sent along
    with the code; it decides how tight bounds are, never what is found.

    Vectors that are null or hold null or non-finite components take no part. A query meets only rows of its own length
    (others have no inner product). Fewer than ``k`` rows: all. A null id takes no part. Repeated ids: a row is skipped
    for a query of the same id. Empty tables give an empty result. Columns besides ``vec_id, embedding`` are ignored.
    """
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select(F.col("vec_id").cast("long"), "embedding").filter(whole).select(
        "vec_id", F.size("embedding").alias("width"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    ).filter("width > 0")
    turns: dict[int, np.ndarray] = {}
    drawn: dict[int, list] = {}
    for r in good.orderBy(F.xxhash64("vec_id", F.lit(3))).limit(sample).select("width", "v").collect():
        drawn.setdefault(r["width"], []).append(r["v"])
    for width, rows in drawn.items():
        turns[width] = rotation(padded(np.array(rows)))
    sizes = good.groupBy("width").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("n_q"))
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1))
    cut = good.join(sizes, "width").withColumn("n_c", blocks("n", row_block)).withColumn("n_qb", blocks("n_q", query_block)).withColumn("is_query", is_query)
    cut = cut.withColumn("early", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(first)) == 0)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    key = ["width", "c", "q"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            flat = t.columns[4].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return t.columns[3].to_numpy(), flat.reshape(t.num_rows, -1)

        found = np.zeros((3, 0), np.int64)
        if left.num_rows and right.num_rows:
            q_ids, q = arrays(left)
            parts, _ = search_block(q_ids, q, left.columns[5].to_numpy(), *arrays(right), turns.get(q.shape[1], np.eye(padded(q[:1]).shape[1])), k)
            found = np.hstack(parts)
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    def meet(rows: DataFrame, n_rows: Column, floors: DataFrame | None) -> DataFrame:
        asked = cut.filter("is_query")
        asked = asked.withColumn("floor", F.lit(-(2**62)).cast("long")) if floors is None else asked.join(floors, "vec_id", "left").fillna(-(2**62), ["floor"])
        asked = asked.withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit(1)), "n_qb")).withColumn("n_c", n_rows).withColumn("c", upto("n_c"))
        asked = asked.select(*(F.col(x).alias(f"q_{x}") for x in (*key, "vec_id", "v", "floor")))
        met = rows.filter("n_q > 0").withColumn("c", F.pmod(F.xxhash64("vec_id"), n_rows)).withColumn("q", upto("n_qb")).select(*key, "vec_id", "v")
        return asked.groupBy(*(f"q_{x}" for x in key)).cogroup(met.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score long")

    early = stored(meet(cut.filter("early"), F.ceil(F.col("n_c") / first), None), "search-first")
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best_early = early.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    floors = best_early.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor")).dropDuplicates(["vec_id"])
    late = meet(cut.filter("NOT early"), F.col("n_c"), floors)
    both = best_early.select("query_id", "vec_id", "score").union(late)
    return both.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the rows of ``embeddings`` whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
