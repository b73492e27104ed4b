"""Repeated passages: windows of words as edges of a De Bruijn graph, singletons dropped, unbranched paths compacted by joins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import covered, in_batches, rows_of, table, window_checks, window_hashes, word_hashes, words_of


def anchors(hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k``-word edges, and the runs of windows with the same anchor (the smallest edge in a window): starts and anchors.

    Equal windows have equal anchors, so a window can only be repeated if its anchor is.
    """
    edges = smallest = window_hashes(hashes, k)
    span, reach = window - k + 1, 1
    if len(edges) < span:
        return edges, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    while reach < span:  # minima of ever longer stretches, by overlapping two
        step = min(reach, span - reach)
        smallest = np.minimum(smallest[: len(smallest) - step], smallest[step:])
        reach += step
    starts = np.concatenate([[0], np.flatnonzero(smallest[1:] != smallest[:-1]) + 1])
    return edges, starts, smallest[starts]


def repeated_here(edges: np.ndarray, starts: np.ndarray, found: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of a text, and whether each stands at two places of it.

    It does if it has two runs, or stands twice in the edges that a run covers (always, if a run is longer than one place can
    serve).
    """
    lengths = np.diff(np.append(starts, len(edges) - span + 1))
    distinct, back, runs = np.unique(found, return_inverse=True, return_counts=True)
    places = starts[:, None] + np.arange(2 * span - 1)
    here = (edges[np.minimum(places, len(edges) - 1)] == found[:, None]) & (places < (starts + lengths + span - 1)[:, None])
    twice = runs > 1
    twice[back[(lengths > span) | (here.sum(1) > 1)]] = True
    return distinct, twice


def first_places(starts: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct edge of a text stands first, in order, and where the edge one word before it stands, if that too is a
    first place (-1 else)."""
    at = np.sort(np.unique(edges, return_index=True)[1])
    is_first = np.zeros(len(edges), bool)
    is_first[at] = True
    before = at - 1
    fits = (at > 0) & is_first[before] & (starts[before] == starts[at] - 1)
    return at, np.where(fits, before, -1)


def first_here(starts: np.ndarray, edges: np.ndarray, heads: list | None, tails: list | None) -> np.ndarray:
    """Which of a text's edges lie on a path, from a head to the next tail, that stands here before anywhere else."""
    at, _ = first_places(starts, edges)
    of = lambda ends: np.isin(edges[at], np.asarray(ends if ends is not None else [], np.int64)).astype(np.int64)
    begun, ended = np.cumsum(of(heads)), np.cumsum(of(tails))
    here = np.zeros(len(edges), bool)
    here[at] = begun > ended - of(tails)
    return here


def _longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def repeated_spans(docs: DataFrame, window: int = 20, k: int = 8) -> DataFrame:
    """``(doc_id, n_words, n_removed, spans, kept_text, kept_sha256)`` for every document.

    A word is removed if a window of ``window`` words covers it whose word sequence also starts earlier: in a document with a
    smaller id, or earlier in the same one. ``spans`` holds the removed stretches as ``start, end`` in words.

    The windows are the edges of a De Bruijn graph; what matters are edges that occur twice. Only places
    are shuffled, never passages, and always summed first, so that an edge that a third of all documents share is
    one row of each task:

    1. Each document names its anchors (one short edge for every stretch of windows, about one in seven words). Anchors that
       occur once are returned to their only document, which thereby knows all windows that can be repeated.
    2. Those windows, hashed whole, are the edges: each document gives every distinct one with the edge before it. Summed per
       edge, this tells its first document, in how many documents it is, and whether the edge before is the same in all of them.
    3. A join of every edge with the one before it compacts paths: two edges are one path where the second always follows the
       first (the only edge before, equal counts, the same first document), for then both stand in the same documents side by side. All links of a
       path go; the edges where paths begin and end remain (one in fifty), and are told to the path's first document.
    4. A document so knows the stretches (source coordinates) that stand here first. Its windows that may be repeated and are in
       none of them are repeats; so are second occurrences inside it. Consecutive ones are compacted into spans.

    Exact copies of a text take part in 4 only (all their windows occur in the copy with the smallest id). The texts are shuffled
    once, by ``doc_id``; Spark reuses that exchange. The messages to a document are bounded by its own length.

    Edges are told apart by 96 bits, two hashes by different multipliers; with n windows the odds of any false repeat are about
    n * n / 2**97, some 1e-10 for 5e9 windows (30 GB).
    Nulls: a null text has no words; a row with a null id is left as it is. Rows that repeat an id are one
    document for the order between documents: each is judged by itself, and neither removes from the other. Very long
    texts take about 60 bytes a word. Empty tables give an empty result. Other columns are ignored.
    """
    # no cast where none is needed: an alias would make exchanges differ that are otherwise the same and used again
    read = docs.select("doc_id" if docs.schema["doc_id"].dataType.simpleString() == "bigint" else F.col("doc_id").cast("long").alias("doc_id"), "text")
    named, nameless = read.filter("doc_id IS NOT NULL"), read.filter("doc_id IS NULL")
    firsts = named.filter("text IS NOT NULL").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"))
    firsts = firsts.select("doc_id", F.lit(True).alias("first")).distinct()
    placed = named.join(firsts.hint("merge"), "doc_id", "left")

    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text in rows_of(batches):
            edges, starts, found = anchors(word_hashes(words_of(text)), window, k)
            if len(found):
                found, twice = repeated_here(edges, starts, found, window - k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(_longs(found)), pa.array(np.full(len(found), doc_id)), pa.array(1 + twice.astype(np.int64))], names=["anchor", "doc_id", "n"])

    once = placed.filter("first").select("doc_id", "text").mapInArrow(name, "anchor long, doc_id long, n long")
    once = once.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1")
    once = once.groupBy("doc_id").agg(F.collect_list("anchor").alias("once"))
    known = placed.join(once.hint("merge"), "doc_id", "left")

    def repeatable(hashes: np.ndarray, once: list | None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows whose anchor isn't known to occur once."""
        edges, at, found = anchors(hashes, window, k)
        often = ~np.isin(_longs(found), np.asarray(once if once is not None else [], np.int64))
        if not often.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.flatnonzero(np.repeat(often, np.diff(np.append(at, len(edges) - (window - k)))))
        return starts, _longs(window_hashes(hashes, window)[starts])

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text, once in rows_of(batches):
            hashes = word_hashes(words_of(text))
            starts, edges = repeatable(hashes, once)
            if len(edges):
                checks = window_checks(hashes, window)[starts].view(np.int32)
                at, before = first_places(starts, edges)
                columns = [pa.array(edges[at]), pa.array(checks[at]), pa.array(np.full(len(at), doc_id)), pa.array(edges[before], mask=before < 0)]
                yield pa.RecordBatch.from_arrays(columns, names=["edge", "check", "doc_id", "before"])

    placed_edges = known.filter("first").select("doc_id", "text", "once").mapInArrow(send, "edge long, check int, doc_id long, before long")
    same = (F.min("before") == F.max("before")) & (F.count("before") == F.count(F.lit(1)))
    edges = placed_edges.groupBy("edge", "check").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.when(same, F.min("before")).alias("before"))
    # the last condition always holds (what comes before stands at a smaller place); it keeps both sides' columns, and so their
    # exchanges, the same, so that Spark counts the edges once
    linked = F.expr("v.edge = w.before AND v.n = w.n AND v.doc_id = w.doc_id AND coalesce(v.before <> w.edge, true)")
    ends = edges.alias("v").join(edges.alias("w"), linked, "full").filter("v.edge IS NULL OR w.edge IS NULL")
    told = ends.select(F.coalesce("v.doc_id", "w.doc_id").alias("doc_id"), F.col("w.edge").alias("head"), F.col("v.edge").alias("tail"))
    told = told.groupBy("doc_id").agg(F.collect_list("head").alias("heads"), F.collect_list("tail").alias("tails"))
    final = known.join(told.hint("merge"), "doc_id", "left").select("doc_id", "text", "first", "once", "heads", "tails")
    final = final.unionByName(nameless, allowMissingColumns=True)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept_text", pa.string()), ("kept_sha256", pa.string())])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text, first, once, heads, tails in rows_of(batches):
                words = words_of(text)
                n, gone = len(words), None
                if doc_id is not None and n >= window:
                    if not first:
                        gone = np.ones(n, bool)
                    else:
                        starts, found = repeatable(word_hashes(words), once)
                        gone = covered(starts[~first_here(starts, found, heads, tails)], window, n)
                spans: list[int] = []
                if gone is not None and gone.any():
                    spans = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                yield doc_id, n, n - len(words), spans, kept.decode("utf-8", "surrogatepass"), sha256(kept).hexdigest()

        yield from in_batches(rows(), schema, 256)

    return final.mapInArrow(judge, "doc_id long, n_words long, n_removed long, spans array<long>, kept_text string, kept_sha256 string")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all ``documents``."""
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = r"""
WITH split AS (SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s + 1:s + 20], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS s FROM split WHERE len(w) >= 20)),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM ranked WHERE r > 1),
words AS (SELECT doc_id, unnest(range(0, len(w))) AS p, unnest(w) AS word FROM split),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT s.doc_id, len(w)::BIGINT AS n_words, (len(w) - COALESCE(k.n, 0))::BIGINT AS n_removed, sha256(COALESCE(k.t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""
