"""Ranked lexical search: per document a hashed sketch of its largest impacts bounds every query's score from above; exact
scores follow in the order of these bounds, until no bound reaches the best found."""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_batches, rows_of, stored, table

#: Term characters are ASCII letters and digits and all that isn't ASCII; A-Z count as a-z. All else separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
#: Bits of the map that tells which terms some query may hold (1 MB, whatever the queries).
_MAP_BITS = 23


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def hashes_of(terms: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), dtype=np.uint64, count=n)


def impacts(tf: np.ndarray, n: int, docs: int, terms: int) -> np.ndarray:
    """What a term's weight is multiplied by; grows with ``tf``, falls with the document's length ``n``."""
    m = 25 + 75 * n * docs // terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Queries:
    """A batch of queries: their terms, weights, and where each looks into a sketch."""

    def __init__(self, entries: Sequence[tuple[int, bytes, int, int]]) -> None:
        """Of ``(item, term, repeats, weight)``."""
        entries = sorted(entries)
        self.items = sorted({e[0] for e in entries})
        place = {item: i for i, item in enumerate(self.items)}
        self.number = {t: i for i, t in enumerate(sorted({e[1] for e in entries}))}
        self.hashes = hashes_of((e[1] for e in entries), len(entries))
        self.weights = np.array([e[2] * e[3] for e in entries], np.float64)
        self.starts = np.flatnonzero(np.diff([-1, *(place[e[0]] for e in entries)]))
        self.exact: list[list[tuple[int, int]]] = [[] for _ in self.items]
        for item, term, repeats, weight in entries:
            self.exact[place[item]].append((self.number[term], repeats * weight))

    def bounds(self, sketches: np.ndarray) -> np.ndarray:
        """No score of a document is above these: a query's terms looked up in the sketches, for all queries at once.

        ``sketches`` has a row for each coordinate and a column for each document; the result a row for each query.
        """
        found = sketches[(self.hashes & np.uint64(len(sketches) - 1)).astype(np.int64)]
        found *= self.weights[:, None]
        return np.add.reduceat(found, self.starts, axis=0) * (1 + 1e-9)


class Best:
    """The ``k`` best documents of each query: highest score first, ties to smaller ids, a null id last."""

    def __init__(self, floors: Sequence[int], k: int) -> None:
        self.floors, self.k = floors, k
        self.held: list[list[tuple[int, bool, int]]] = [[] for _ in floors]

    def reach(self, q: int) -> int:
        """What a score must be at least to matter: the k-th best held, or one known from elsewhere, and above 0."""
        held = self.held[q]
        return max(1, self.floors[q], -held[-1][0] if len(held) >= self.k else 0)

    def add(self, q: int, doc_id: int | None, score: int) -> None:
        insort(self.held[q], (-score, doc_id is None, doc_id or 0))
        del self.held[q][self.k :]


class Page:
    """A document while its neighbours are searched: its terms, and its impacts on terms of queries once they're asked for."""

    __slots__ = ("doc_id", "tf", "n", "hits")

    def __init__(self, doc_id: int | None, tf: Counter, n: int) -> None:
        self.doc_id, self.tf, self.n, self.hits = doc_id, tf, n, None


def search(pages: list[Page], queries: Queries, best: Best, docs: int, terms: int, load: int = 16, cells: int = 1 << 21) -> tuple[int, int]:
    """Put what ``pages`` hold for the queries into ``best``; gives how many pairs there were and how many were scored exactly.

    A sketch has ``load`` to ``2 * load`` coordinates for each distinct term of its document; a coordinate holds the largest impact
    of the terms hashed to it. Pages with sketches of the same size are looked up together, at most ``cells`` values at once.
    """
    by_width: dict[int, list[Page]] = {}
    for p in pages:
        by_width.setdefault(1 << (load * len(p.tf) - 1).bit_length(), []).append(p)
    scored = 0
    for width, group in by_width.items():
        at_once = max(1, cells // max(width, len(queries.weights)))
        for start in range(0, len(group), at_once):
            part = group[start : start + at_once]
            sketches = np.zeros((width, len(part)))
            for column, p in enumerate(part):
                values = impacts(np.fromiter(p.tf.values(), np.int64, len(p.tf)), p.n, docs, terms)
                order = np.argsort(values, kind="stable")  # where terms meet, the largest is written last
                at = (hashes_of(p.tf, len(p.tf)) & np.uint64(width - 1)).astype(np.int64)
                sketches[at[order], column] = values[order]
            bounds = queries.bounds(sketches)
            for q, row in enumerate(bounds):
                near = np.flatnonzero(row >= best.reach(q))
                for c in near[np.argsort(-row[near], kind="stable")]:
                    if row[c] < best.reach(q):
                        break
                    scored += 1
                    if (score := exact_score(part[c], queries, q, docs, terms)) >= best.reach(q):
                        best.add(q, part[c].doc_id, score)
    return len(pages) * len(queries.items), scored


def exact_score(p: Page, queries: Queries, q: int, docs: int, terms: int) -> int:
    if p.hits is None:
        held = [(queries.number[t], tf) for t, tf in p.tf.items() if t in queries.number]
        values = impacts(np.array([x[1] for x in held], np.int64), p.n, docs, terms) if held else ()
        p.hits = {number: int(v) for (number, _), v in zip(held, values, strict=True)}
    return sum(w * p.hits[t] for t, w in queries.exact[q] if t in p.hits)


def query_terms(items: DataFrame) -> DataFrame:
    """``(item, item_id, term, repeats, place)``, stored; ``item`` numbers the rows of ``items``, ``place`` is the term's in the map of terms."""
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("term", pa.binary()), ("repeats", pa.int64()), ("place", pa.int64())])

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for item, item_id, text in rows_of(batches):
                own = Counter(terms_of(text))
                yield from ((item, item_id, t, k, int(place)) for (t, k), place in zip(own.items(), _places(hashes_of(own, len(own))), strict=True))

        yield from in_batches(rows(), schema)

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), "text")
    return stored(rows.mapInArrow(split, "item long, item_id long, term binary, repeats long, place long"), "query-terms")


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _MAP_BITS)).astype(np.int64)


def _marked(entries: DataFrame) -> np.ndarray:
    """A map of fixed size with a bit for the hash of each query term, packed; its 256 blocks of 4 kB come from one aggregation."""
    bits = np.zeros((256, (1 << _MAP_BITS) // 8 // 256), np.uint8)
    block = (F.col("place") / F.lit(1 << (_MAP_BITS - 8))).cast("int")
    for r in entries.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(F.col("place") % (1 << (_MAP_BITS - 8))).alias("bits")).collect():
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(-1)


def statistics(docs: DataFrame, entries: DataFrame) -> tuple[int, int, DataFrame]:
    """How many documents hold a term, how many terms they hold together, and ``(term, df)`` for terms of queries.

    One pass; each task sends its sums: a row for each term that some query may hold.
    """
    schema = pa.schema([("term", pa.binary()), ("docs", pa.int64()), ("terms", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(_marked(entries))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value, bitorder="little").astype(bool)
        df: Counter = Counter()
        n_docs = n_terms = 0
        for (text,) in rows_of(batches):
            if not (found := terms_of(text)):
                continue
            n_docs, n_terms, own = n_docs + 1, n_terms + len(found), list(set(found))
            hit = wanted[_places(hashes_of(own, len(own)))]
            df.update([own[i] for i in np.flatnonzero(hit)])
            if len(df) > 200_000:
                yield from in_batches(((t, k, 0) for t, k in df.items()), schema, 8192)
                df.clear()
        yield from in_batches(((t, k, 0) for t, k in df.items()), schema, 8192)
        if n_docs:
            yield from in_batches([(None, n_docs, n_terms)], schema)

    sums = stored(docs.select("text").mapInArrow(count, "term binary, docs long, terms long").groupBy("term").agg(F.sum("docs").alias("df"), F.sum("terms").alias("terms")), "term-counts")
    whole = sums.filter("term IS NULL").first()
    return (whole["df"], whole["terms"], sums.filter("term IS NOT NULL").select("term", "df")) if whole else (0, 0, sums.select("term", "df"))


def rank(docs: DataFrame, items: DataFrame, k: int = 10, load: int = 16, batch_terms: int = 400_000, first: int = 16, at_once: int = 1024, batch_chars: int = 8_000_000) -> DataFrame:
    """``(item, item_id, rank, doc_id, score)``: the ``k`` highest-scoring documents for each row of ``items``, ties to smaller ids.

    1. One pass over the texts counts documents, terms, and the document frequency of every term that a query holds.
    2. Queries are taken in batches of about ``batch_terms`` different terms of items (one batch below that), which go to all tasks.
       Each batch passes over the texts once, some ``at_once`` documents of at most ``batch_chars`` characters at a time: their
       impacts are folded into sketches, all queries look their terms up there, and documents are scored exactly in the order of
       these bounds, until the next bound is below the query's threshold, its k-th best score so far.
    3. One document in ``first`` (by hash) is searched beforehand; the k-th best of it is each query's first threshold, so that a
       task need not begin without one, and sends few rows. It decides what is scored, never what is found.

    Only each task's ``k`` best per query are shuffled. Nothing of a document's size is kept beyond its turn.

    A null text has no terms; documents without terms aren't found. A query without terms, or whose terms no document holds, gives
    no row. A null ``doc_id`` is ranked like others, last among ties. Repeated documents are ranked each, repeated items
    answered each (``item`` tells them apart). Empty tables give an empty result. Other columns are ignored.
    """
    entries = query_terms(items)
    read = docs.select(F.col("doc_id").cast("long"), "text")
    n_docs, n_terms, df = statistics(read, entries)
    # an item whose terms no document holds can have no score; terms of df 0 add nothing
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = stored(entries.join(df, "term").select("item", "item_id", "term", "repeats", weight.alias("weight")), "weights")
    batches = -(-weighed.count() // batch_terms)
    weighed = weighed.withColumn("batch", F.pmod(F.xxhash64("item"), F.lit(max(1, batches))))
    out_schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    best_first = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    context = docs.sparkSession.sparkContext

    def found(rows: DataFrame, shared, floors: Sequence[int]) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, best, held, chars = shared.value, Best(floors, k), [], 0
            for doc_id, text in rows_of(batches):
                if own := terms_of(text):
                    held.append(Page(doc_id, Counter(own), len(own)))
                    chars += len(text)
                    if len(held) >= at_once or chars >= batch_chars:
                        search(held, queries, best, n_docs, n_terms, load)
                        held, chars = [], 0
            search(held, queries, best, n_docs, n_terms, load)
            yield from in_batches(((queries.items[q], None if none else doc_id, -score) for q, rows in enumerate(best.held) for score, none, doc_id in rows), out_schema)

        local = rows.mapInArrow(run, "item long, doc_id long, score long")
        return local.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)

    parts = []
    for b in range(batches):
        rows = [(r["item"], bytes(r["term"]), r["repeats"], r["weight"]) for r in weighed.filter(F.col("batch") == b).collect()]
        queries = Queries(rows)
        shared = context.broadcast(queries)
        early = found(read.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(first)) == 0), shared, [0] * len(queries.items))
        reached = {r["item"]: r["score"] for r in early.filter(F.col("rank") == k).collect()}
        parts.append(stored(found(read, shared, [reached.get(i, 0) for i in queries.items]), "ranked"))
    if not parts:
        return weighed.select("item", "item_id", F.lit(1).alias("rank"), F.col("item").alias("doc_id"), F.col("weight").alias("score")).limit(0)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.join(entries.select("item", "item_id").distinct(), "item").select("item", "item_id", "rank", "doc_id", "score")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` for each ``benchmark`` item."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


_TERMS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
OP13_SQL = f"""
WITH doc_terms AS (SELECT doc_id, {_TERMS} AS term FROM documents),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM doc_terms GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (SELECT item_id, term, count(*)::BIGINT AS repeats FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, totals GROUP BY term, docs),
impacts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)) AS f
  FROM tf JOIN sizes USING (doc_id), totals),
scores AS (
  SELECT item_id, doc_id, sum(repeats * w * f)::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL HAVING score > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scores QUALIFY rank <= 10
"""
