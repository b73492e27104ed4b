"""Mixing sources to target weights by capped water-filling, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[float], total_share: float, max_epochs: float) -> DataFrame:
    """``(source, source_size, target)`` from one row ``(source, source_size)`` per source.

    Sources are taken by code point, null last, and weigh ``weights`` in turn. Together they ask for
    ``total_share`` of all sizes. A source gets ``min(cap, level * weight)`` with ``cap = max_epochs * size``;
    sorted by ``cap / weight`` the capped ones come first, so running sums give the level without a loop:
    it's where clamping and resharing by weight ends. The windows run over one row per source.
    """
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    listed = F.array(*(F.lit(float(w)) for w in weights))
    return (
        sizes.withColumn("weight", F.get(listed, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
        .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("asked", F.lit(float(total_share)) * F.sum("source_size").over(everything))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("asked") - F.col("capped_before")) / F.col("weight_left"))
        # sources from the first uncapped one on are below the levels they'd set, and these fall from there: the first is the highest
        .withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))))
        .select("source", "source_size", "target")
    )


def _placed(docs: DataFrame, seed: int) -> tuple[Column, Column]:
    """The size of a document and its place in its source: a seeded 48-bit hash of its id, or of its text without one."""
    known = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return word_count(F.col("text")), F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), known)), 1, 12), 16, 10).cast("long")


def cuts(sized: DataFrame, weights: Sequence[float], total_share: float, max_epochs: float, buckets: int) -> DataFrame:
    """One row per source: ``target``, whole repetitions, and ``last``, the last place that is taken once more.

    Words are summed by ``buckets`` ranges of the place (before the shuffle, so that a source with a third of all rows is no
    hot key), and only the range in which the wanted sum is reached is sorted.
    """
    width = 2**48 // buckets
    sized = sized.withColumn("bucket", F.floor(F.col("place") / width))
    sums = stored(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    wanted = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total_share, max_epochs)
    wanted = wanted.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long")))
    wanted = stored(wanted.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # one row for each source and range: small beside the documents, but joined by key, for it grows with the sources
    reached = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))).join(wanted.select(F.col("source").alias("s"), "part"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    below = reached.filter("before + words <= part").select("source", F.struct(((F.col("bucket") + 1) * width - 1).alias("place"), F.lit(2**63 - 1).alias("doc_id")).alias("last"))
    inside = reached.filter("before < part AND before + words > part").select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "part")
    within = W.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    edge = sized.join(inside, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    edge = edge.filter(F.col("at") + F.col("size") / 2 <= F.col("part")).select("source", F.struct("place", "doc_id").alias("last"))
    last = below.unionByName(edge).groupBy(F.col("source").alias("s")).agg(F.max("last").alias("last"))
    return stored(wanted.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-cuts")


def _copies(sized: DataFrame, cut: DataFrame) -> DataFrame:
    """``copies`` of each row. Spark broadcasts the cuts if they're below its limit of size, else joins by source."""
    joined = sized.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    more = (F.col("part") > 0) & F.col("last").isNotNull() & (F.struct("place", "doc_id") <= F.col("last"))
    return joined.withColumn("copies", F.col("whole") + F.when(more, 1).otherwise(0))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total_share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, buckets: int = 4096) -> DataFrame:
    """How often each document is taken: ``docs``' ``doc_id`` with ``source, size, source_size, target, copies, taken``.

    A source with target / size = 1.37 takes all its documents once and documents with 37 % of its words once
    more. These are the first in the order of a seeded hash, up to the document that brings the sum nearest to
    the target: whole documents, so a source misses its target by half a document at most.

    Nulls: a null text has size 0, a null source is a source of its own (the last), a null ``doc_id`` is placed by its text.
    Empty tables give an empty result. Rows with the same ``doc_id`` are taken together. Columns besides ``doc_id, text,
    source`` are ignored. Very long texts are counted in place. No text is shuffled.
    """
    size, place = _placed(docs, seed)
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), place.alias("place")), "mix-sizes")
    out = _copies(sized, cuts(sized, weights, total_share, max_epochs, buckets))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total_share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, buckets: int = 4096) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; all columns stay. The texts are read twice and not shuffled."""
    size, place = _placed(docs, seed)
    key = F.col("doc_id").cast("long").alias("doc_id")
    sized = stored(docs.select(key, "source", size.alias("size"), place.alias("place")), "mix-sizes")
    cut = cuts(sized, weights, total_share, max_epochs, buckets)
    taken = _copies(docs.select(key, "source", place.alias("place"), F.struct(*docs.columns).alias("_row")), cut).filter("copies > 0")
    return taken.select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all ``documents``."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17:' || doc_id), 1, 12))::BIGINT AS ord
  FROM documents),
sources AS (SELECT source, sum(size)::DOUBLE AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sources),
ratios AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / weight AS ratio, 1.5 * sum(source_size) OVER () AS asked FROM weighed),
levels AS (
  SELECT *, (asked - COALESCE(sum(cap) OVER before, 0)) / (sum(weight) OVER () - COALESCE(sum(weight) OVER before, 0)) AS here
  FROM ratios WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wanted AS (
  SELECT source, source_size, COALESCE(least(cap, weight * max(CASE WHEN ratio >= here THEN here END) OVER ()), cap) AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS part FROM wanted),
placed AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.part,
         COALESCE(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN words_before + size / 2.0 <= part AND part > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
