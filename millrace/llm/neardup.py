"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, mixed, rows_of, stored, table, window_hashes, word_hashes
from .graph import components

#: Bins of the one-permutation hash (a power of two) and bins in a band.
BINS, ROWS = 128, 4
#: Sets up to SMALL shingles are paired by exact prefixes; prefixes are kept up to SMALL / 0.8.
SMALL = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: For each bin, the bins that an empty one borrows from, in turn: a fixed random draw for each bin and attempt.
_DONORS = np.random.default_rng(20240601).integers(0, BINS, (BINS, 16 * BINS))
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``k``-word shingles; a shorter text is one shingle; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return mixed(window_hashes(word_hashes(words), len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(word_hashes(words), k))


def densified(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash in each bin; an empty bin takes that of the first filled one in its own random order."""
    at = np.searchsorted(shingles, _EDGES)
    ends = np.append(at[1:], len(shingles))
    filled = ends > at
    values = shingles[np.minimum(at, len(shingles) - 1)].copy()
    if not filled.all():
        empty = np.flatnonzero(~filled)
        hits = filled[_DONORS[empty]]
        donor = np.where(hits.any(1), _DONORS[empty, hits.argmax(1)], np.flatnonzero(filled)[0])
        values[empty] = values[donor]
    return values


def sketch(shingles: np.ndarray, percent: int) -> tuple[bytes, list[int], list[int]]:
    """Digest of the set, bucket keys, and 4 bits of each bin packed into longs.

    Keys are the hashes of the bands and, for small sets, of the prefix: two sets of similarity ``percent`` share one of
    the ``n - ceil(percent * n) + 1`` smallest hashes of each, whatever the order, so that no small pair is missed.
    """
    values = densified(shingles)
    keys = mixed(values.reshape(-1, ROWS)[:, 0] + np.arange(BINS // ROWS, dtype=np.uint64))
    for j in range(1, ROWS):
        keys = mixed(keys ^ values.reshape(-1, ROWS)[:, j])
    n = len(shingles)
    if n * percent <= SMALL * 100:
        prefix = shingles[: n + (-percent * n) // 100 + 1]
        keys = np.concatenate([keys, mixed(prefix + np.uint64(0x5BD1E995))])
    nibbles = ((values >> np.uint64(20)) & np.uint64(15)).reshape(-1, 16)
    packed = (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64)
    return xxhash.xxh3_128_digest(shingles.tobytes()), np.unique(keys).astype(np.int64).tolist(), packed.astype(np.int64).tolist()


_SKETCHES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
_SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches):
                shingles = shingle_set(text, k)
                yield (doc_id, len(shingles), *(sketch(shingles, percent) if len(shingles) else (b"", [], [])))

        yield from in_batches(rows(), _SKETCHES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, digest binary, keys array<long>, bits array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(((i, shingle_set(t, k).astype(np.int64)) for i, t in rows_of(batches)), _SETS, 256)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, shingles array<long>")


def _marked(docs: DataFrame, ids: DataFrame, bits: int) -> DataFrame:
    """``docs`` with ``_hit``: false if ``doc_id`` surely isn't in ``ids``.

    A bitmap of the ids' hashes, of a fixed size (1 MB at 2**23 bits, in pieces of 4 KB), goes to every executor. Where ids
    outnumber the bits it only stops helping.
    """
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    maps = ids.select(hashed.alias("h")).groupBy(F.floor(F.col("h") / 32768).alias("_piece")).agg(F.bitmap_construct_agg(F.col("h") % 32768).alias("_map"))
    near = docs.withColumn("_h", hashed).withColumn("_piece", F.floor(F.col("_h") / 32768)).join(F.broadcast(maps), "_piece", "left")
    bit = "shiftright(cast(conv(hex(substring(_map, cast(_h % 32768 div 8 + 1 as int), 1)), 16, 10) as int), cast(_h % 8 as int)) % 2 = 1"
    return near.withColumn("_hit", F.coalesce(F.expr(bit), F.lit(False))).drop("_piece", "_h", "_map")


def among(docs: DataFrame, ids: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is in ``ids``; few others are shuffled."""
    return _marked(docs, ids, bits).filter("_hit").drop("_hit").join(ids.hint("merge"), "doc_id", "left_semi")


def without(docs: DataFrame, ids: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is null or not in ``ids``; most of them aren't shuffled."""
    marked = _marked(docs.select("doc_id", F.struct(*docs.columns).alias("_row")), ids, bits)  # whatever the table's columns are called
    unsure = marked.filter("_hit").join(ids.hint("merge"), "doc_id", "left_anti")
    return marked.filter("NOT _hit").unionByName(unsure).select("_row.*")


def _possible(a: str, b: str, in_common: str, percent: int, slack: int = 44) -> str:
    """SQL: may two sets with at most ``in_common`` shared shingles be similar? Sketches that differ in more than
    ``slack`` of 128 bins (4.5 deviations from what similarity 0.8 gives) rule it out for all but small sets."""
    differ = " + ".join(f"bit_count((({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & 1229782938247303441))" for x in (f"({a}.bits[{j}] ^ {b}.bits[{j}])" for j in range(BINS // 16)))
    return f"100 * {in_common} >= {percent} * ({a}.n + {b}.n - {in_common}) AND (least({a}.n, {b}.n) <= {SMALL} OR {differ} <= {slack})"


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose full sets are similar."""
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
    return stored(both.filter(F.col("i") * 100 >= percent * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b"), "links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every document.

    Documents are linked if their sets of lower-cased ``k``-word shingles have a Jaccard similarity of ``percent`` or
    more. ``component_id`` is the smallest ``doc_id`` reachable over links, and that document is kept.

    1. A sketch of each document. Documents with equal sets are one class, represented by the smallest id.
    2. In each bucket the smallest id is the hub of a star: a bucket gives as many pairs as it has members. Pairs that
       their sketches allow are compared on full sets, fetched for the documents concerned only.
    3. A star misses links between two documents that aren't linked to the hub. So buckets with several components are
       looked at again, and an exact bound decides who is compared: shingles that occur in no other such document, or
       in no document of the other component, can't be shared. Few pairs remain even in large groups.
    4. Links make components.

    Bands of 4 bins, 32 of them, miss a pair of similarity 0.8 with probability 5e-8; sets up to 64 shingles are paired
    by prefixes, exactly. Nulls: a null text is empty, and empty sets link with nothing; a document with a null id
    gets a null component and is kept. Very long texts take 8 bytes a word. Rows that repeat an id are one node.
    Empty tables give an empty result. Columns besides ``doc_id, text`` are ignored.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = stored(sketches(read, k, percent), "sketches")
    real = sig.filter("n > 0 AND doc_id IS NOT NULL")
    # stored, so that both sides of the join are plain exchanges and Spark can split a digest with very many copies
    classes = stored(real.groupBy("digest").agg(F.min("doc_id").alias("rep")), "digests")
    member_of = stored(real.select("doc_id", "digest").join(classes, "digest").select("doc_id", "rep"), "classes")
    reps = stored(real.join(member_of.filter("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n", "keys", "bits"), "representatives")

    keyed = reps.select("doc_id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("doc_id").alias("hub")).filter("c > 1").drop("c")
    members = stored(keyed.join(shared, "key"), "members")

    light = reps.select("doc_id", "n", "bits")
    stars = members.filter("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    sided = stars.join(light.select(F.col("doc_id").alias("a"), F.struct("n", "bits").alias("p")), "a").join(light.select(F.col("doc_id").alias("b"), F.struct("n", "bits").alias("q")), "b")
    stars = stored(sided.filter(F.expr(_possible("p", "q", "least(p.n, q.n)", percent))).select("a", "b"), "stars")

    def labelled(found: DataFrame) -> DataFrame:
        """Members with their component and, for buckets with several components, the most frequent one."""
        own = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("label"))
        own = stored(own, "labelled")
        per = own.groupBy("key", "label").agg(F.count("*").alias("c"))
        main = per.groupBy("key").agg(F.max_by("label", F.struct(F.col("c"), -F.col("label"))).alias("main"), F.count("*").alias("labels")).filter("labels > 1").drop("labels")
        return own.join(main, "key")

    # full sets: of pairs to compare, and of buckets that would hold several components even if all of them were links
    split = labelled(components(stars)).select("doc_id")
    needed = stored(stars.select(F.explode(F.array("a", "b")).alias("doc_id")).union(split).distinct(), "needed")
    sets = stored(shingle_sets(among(read, needed), k), "sets")
    links = verified(stars, sets, percent)

    mixed_buckets = stored(labelled(components(links)), "mixed")
    again = stored(mixed_buckets.select("doc_id", "label").distinct(), "again")
    spread = sets.join(again, "doc_id").select("doc_id", "label", F.explode("shingles").alias("shingle"))
    alone = spread.groupBy("shingle").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id")).filter("c = 1").groupBy("doc_id").agg(F.count("*").alias("alone"))
    able = light.join(again, "doc_id").join(alone, "doc_id", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
    able = stored(able.filter(f"100 * common >= {percent} * n").select("doc_id", "label", "n", "bits", "common"), "able")

    minor = stored(mixed_buckets.filter("label <> main").select("key", "doc_id", "main").join(able, "doc_id"), "minor")
    # against the main component of a bucket: shingles that occur in it bound what can be shared with any of its documents
    asked = stored(minor.select("doc_id", "main").distinct(), "asked")
    held = sets.join(able.select("doc_id", "label"), "doc_id").join(asked.select(F.col("main").alias("label")).distinct(), "label", "left_semi")
    held = held.select("label", F.explode("shingles").alias("shingle")).distinct()
    mine = sets.join(asked, "doc_id").select("doc_id", F.col("main").alias("label"), F.explode("shingles").alias("shingle"))
    bound = mine.join(held, ["label", "shingle"]).groupBy("doc_id", "label").agg(F.count("*").alias("in_main"))
    x = able.select("doc_id", "n", "bits", "common").join(bound, "doc_id").filter(f"100 * least(in_main, common) >= {percent} * n")
    first = x.alias("p").join(able.alias("q"), F.expr("p.label = q.label AND " + _possible("p", "q", "least(p.in_main, p.common, q.common)", percent)))
    second = minor.alias("p").join(minor.alias("q"), F.expr("p.key = q.key AND p.doc_id < q.doc_id AND p.label <> q.label AND " + _possible("p", "q", "least(p.common, q.common)", percent)))
    pairs = first.select(F.col("p.doc_id").alias("a"), F.col("q.doc_id").alias("b")).union(second.select("p.doc_id", "q.doc_id")).distinct()
    links = links.union(verified(stored(pairs, "pairs"), sets, percent))

    found = components(links).withColumnsRenamed({"node": "rep", "component": "c"})
    named = member_of.join(found, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("c", "rep")).alias("component"))
    out = sig.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of four words over all ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
frequent AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM frequent JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r),
named AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, COALESCE(s.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN named ON named.doc_id = d.doc_id
"""
