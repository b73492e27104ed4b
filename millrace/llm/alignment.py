"""Cross-tokenizer alignment: which tokens of two tokenizers share bytes, and in how many documents each pair of ids does."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, rows_of, stored, table
from .packing import encoder

def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """What each id spells: all entries' bytes in one array, and where each begins."""

    def __init__(self, entries: list[bytes]) -> None:
        self.size = np.array(list(map(len, entries)), np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def spelt(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids one after the other, and where each id ends."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.bytes[np.repeat(self.begin[ids] - ends + size, size) + np.arange(size.sum())], ends


class Aligner:
    """Encodes texts by two tokenizers: A byte-level with a space put before the text, B of pieces, which adds that space itself."""

    def __init__(self, vocabulary: str, ranks: str | None, pieces: str) -> None:
        import public_tokenizers
        import sentencepiece

        self.of_a = encoder(vocabulary, ranks, special=False)
        with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
            entries = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
        chars = byte_chars()
        self.a = Vocabulary([bytes(chars.get(c, 0) for c in entries.get(i, "")) for i in range(max(entries) + 1)])
        self.of_b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces))
        spelt = [self.of_b.id_to_piece(i) for i in range(self.of_b.get_piece_size())]
        self.b = Vocabulary([bytes([int(p[3:5], 16)]) if self.of_b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(spelt)])

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text by A and by B; none for texts without tokens: empty ones and those that ids don't spell."""
        out, none = [], np.zeros(0, np.int64)
        for text, b in zip(texts, self.of_b.encode(texts, num_threads=1), strict=True):
            ids = np.array(self.of_a(" " + text), np.int64), np.array(b, np.int64)
            own = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass"), np.uint8)
            good = text and all(np.array_equal(v.spelt(x)[0], own) for v, x in zip((self.a, self.b), ids, strict=True))
            out.append(ids if good else (none, none))
        return out


@lru_cache(maxsize=1)
def aligner(vocabulary: str, ranks: str | None, pieces: str) -> Aligner:
    return Aligner(vocabulary, ranks, pieces)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; two sorted halves only need merging."""
    x = np.sort(x, kind="stable")
    return x[np.diff(x, prepend=-1) > 0]


@lru_cache(maxsize=2)
def _decimals(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below ``2**bits`` as digits and a place for a separator, and which of these are shown."""
    numbers, powers = np.arange(1 << bits)[:, None], 10 ** np.arange(len(str((1 << bits) - 1)) - 1, -1, -1)
    text, shown = (np.pad(x, ((0, 0), (0, 1)), constant_values=1) for x in ((numbers // powers % 10 + ord("0")).astype(np.uint8), (numbers >= powers) | (powers == 1)))
    return text, shown


class Links:
    """Tokens of some texts linked by the bytes they share, all texts at once.

    Ends of tokens, as places in all texts' bytes, cut these into parts; each part lies in one A and one B token, and every pair that
    overlaps shares exactly one part. ``a``, ``b``: the ids of each part's tokens; ``of``: its text; the groups as text.
    """

    def __init__(self, ids: list[tuple[np.ndarray, np.ndarray]], a_size: np.ndarray, b_size: np.ndarray) -> None:
        a, b = (np.concatenate([x[k] for x in ids]) for k in (0, 1))
        self.n_a, self.n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
        a_ends, b_ends = np.cumsum(a_size[a]), np.cumsum(b_size[b])
        parts = distinct(np.concatenate([a_ends, b_ends]))
        at_a, at_b = np.searchsorted(a_ends, parts), np.searchsorted(b_ends, parts)
        self.a, self.b, self.of = a[at_a], b[at_b], np.repeat(np.arange(len(ids)), self.n_a)[at_a]
        self.n_links = np.bincount(self.of, minlength=len(ids))
        common = (a_ends[at_a] == parts) & (b_ends[at_b] == parts)
        last_a, last_b = at_a[common], at_b[common]  # the last tokens of each group
        self.n_groups = np.bincount(self.of[common], minlength=len(ids))
        self.groups = self._spelt(a, b, last_a, last_b)

    def _spelt(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each text, from digits and separators put in their places at once."""
        per_a, per_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        # an A token comes after the B tokens of earlier groups, a B token also after its own group's A tokens
        place_a = np.arange(len(a)) + np.repeat(np.cumsum(per_b) - per_b, per_a)
        place_b = np.arange(len(b)) + np.repeat(np.cumsum(per_a), per_b)
        ids = np.empty(len(a) + len(b), np.int64)
        ids[place_a], ids[place_b] = a, b
        text, shown = (x[ids] for x in _decimals(int(ids.max(initial=0)).bit_length()))
        text[:, -1] = ord(",")
        text[place_a[last_a], -1] = ord("|")
        text[place_b[last_b], -1] = ord(";")
        whole, sizes = text[shown].tobytes(), np.append(0, np.cumsum(shown.sum(1)))
        ends = sizes[np.cumsum(self.n_a + self.n_b)].tolist()
        return [whole[x : max(x, y - 1)] for x, y in zip([0, *ends], ends, strict=False)]


# Bitmaps: the documents of a chunk (at most 65,536, by their number in it) as a sorted array of 16-bit numbers, or as a bit for
# each document where that is shorter. A pair's bitmap comes as planes: plane k has the documents whose number of
# links of this pair has bit k, so all planes together, merged by OR, are the documents that hold the pair.


def compressed(numbers: np.ndarray, size: int) -> bytes:
    """A bitmap of sorted numbers below ``size``: one byte for its form, then its content."""
    if 16 * len(numbers) <= size:
        return b"\0" + numbers.astype("<u2").tobytes()
    bits = np.zeros(size, bool)
    bits[numbers] = True
    return b"\1" + np.packbits(bits).tobytes()


def bits_of(bitmap: bytes, size: int) -> np.ndarray:
    """A bitmap as one truth value for each document."""
    if bitmap[0]:
        return np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1), count=size).astype(bool)
    bits = np.zeros(size, bool)
    bits[np.frombuffer(bitmap, "<u2", offset=1)] = True
    return bits


def numbers_of(bitmap: bytes, size: int) -> np.ndarray:
    return np.flatnonzero(bits_of(bitmap, size)) if bitmap[0] else np.frombuffer(bitmap, "<u2", offset=1).astype(np.int64)


def planes_of(numbers: np.ndarray, links: np.ndarray, size: int) -> list[bytes]:
    """One bitmap for each bit of the numbers of links."""
    return [compressed(numbers[(links >> k) & 1 == 1], size) for k in range(int(links.max()).bit_length())]


def merged(planes: list[bytes], size: int) -> np.ndarray:
    """The documents of all planes: their OR."""
    if len(planes) == 1:
        return numbers_of(planes[0], size)
    bits = bits_of(planes[0], size)
    for p in planes[1:]:
        bits |= bits_of(p, size)
    return np.flatnonzero(bits)


_INDEX = pa.schema([
    ("chunk", pa.int64()), ("pair", pa.int64()), ("planes", pa.list_(pa.binary())), ("docs", pa.int64()), ("links", pa.int64()), ("size", pa.int32()), ("local", pa.int32()), ("doc_id", pa.int64()),
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()),
])
_INDEX_DDL = (
    "chunk long, pair long, planes array<binary>, docs long, links long, size int, local int, doc_id long,"
    " n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"
)


class Chunk:
    """Documents numbered from 0, and how often each holds each pair of ids linked; becomes rows of the index."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_ids: list[int | None], links: Links, ids_b: int, with_groups: bool) -> None:
        keys = np.sort((links.a * ids_b + links.b) << 16 | (links.of + len(self.rows)))
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, times = keys[first], np.diff(np.append(first, len(keys)))
        self.keys.append(keys)
        self.times.append(times)
        self.postings += len(keys)
        numbers = zip(doc_ids, links.n_a.tolist(), links.n_b.tolist(), links.n_groups.tolist(), links.n_links.tolist(), links.groups, strict=True)
        self.rows += [(*row, hashlib.sha256(groups).hexdigest() if groups else "", groups.decode() if with_groups else None) for *row, groups in numbers]

    def index(self, chunk: int) -> Iterator[tuple]:
        size = len(self.rows)
        for local, row in enumerate(self.rows):
            yield (chunk, None, None, None, None, size, local, *row)
        keys, links = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(keys, kind="stable")
        keys, links = keys[order], links[order]
        pairs, local = keys >> 16, keys & 0xFFFF
        bounds = np.append(np.flatnonzero(np.diff(pairs, prepend=-1)), len(pairs))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            planes = planes_of(local[a:b], links[a:b], size)
            yield (chunk, int(pairs[a]), planes, len(merged(planes, size)), int(links[a:b].sum()), size, *(None,) * 8)


def some(rows: Iterable[tuple], most: int, chars: int = 2_000_000) -> Iterator[list[tuple]]:
    """Rows a few at a time: ``most``, or fewer if their texts are long."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[1] or "")
        if len(held) >= most or n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def align(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken",
    pieces: str = "piece_bpe_32k.model",
    chunk_docs: int = 65_536,
    chunk_postings: int = 3_000_000,
    with_groups: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(documents, pairs)``: the alignment of every document, ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256, groups)``, and ``(a, b, docs, links, best)``, how many documents hold a pair of ids linked and how often in all.

    1. One pass encodes texts with both tokenizers and links tokens whose byte ranges overlap. A task numbers its documents in chunks
       (of at most ``chunk_docs``, and about ``chunk_postings`` pairs of a document and a pair of ids, which bounds its memory) and
       writes, for each chunk and pair, the pair's documents as bitmaps, one plane for each bit of the number of links.
    2. Planes are merged by OR and counted; sums over the chunks give a pair's documents, the highest of an A id its best.
    3. Counts go to the postings: each chunk gets back the rows of its pairs, and each document of a plane the pair's
       count as often as the plane says. What a chunk gets is of the size that its task wrote.

    No row of a document and a pair is ever shuffled, only bitmaps. ``groups`` is null unless ``with_groups``.

    Null or empty texts and those whose tokens don't spell a space and the text have no tokens: zeros and an empty digest. A null
    ``doc_id`` stays null. Very long texts are encoded whole. Repeated rows are documents each and count each. Empty tables
    give empty results. Other columns are ignored.
    """
    if not 64 <= chunk_docs <= 65_536:
        raise ValueError("a chunk has from 64 to 65536 documents")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(vocabulary, ranks, pieces)
        number, chunk = TaskContext.get().partitionId() << 32, Chunk()
        for held in some(rows_of(batches), 64):
            texts = [text or "" for _, text in held]
            chunk.add([i for i, _ in held], Links(by.encoded(texts), by.a.size, by.b.size), len(by.b.size), with_groups)
            if len(chunk.rows) > chunk_docs - 64 or chunk.postings >= chunk_postings:
                yield from in_batches(chunk.index(number), _INDEX, 4096)
                number, chunk = number + 1, Chunk()
        if chunk.rows:
            yield from in_batches(chunk.index(number), _INDEX, 4096)

    index = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, _INDEX_DDL), "pair-bitmaps")
    postings = index.filter("pair IS NOT NULL").select("chunk", "pair", "planes", "size")
    ids_b = len(aligner(vocabulary, ranks, pieces).b.size)
    a_id = F.floor(F.col("pair") / F.lit(ids_b)).cast("long")
    counts = index.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")).withColumn("a", a_id)
    # the highest of an A id: by partial maxima, so that no task holds all partners of a frequent id
    top = counts.groupBy("a").agg(F.max("docs").alias("top"))
    pairs = stored(counts.join(top, "a").select("pair", "a", (F.col("pair") - F.col("a") * ids_b).alias("b"), "docs", "links", (F.col("docs") == F.col("top")).alias("best")), "pair-counts")
    told = postings.join(pairs.select("pair", F.col("docs").alias("count"), "best"), "pair").select("chunk", "planes", "size", "count", "best")

    out_schema = pa.schema([("chunk", pa.int64()), ("local", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def give(group: pa.Table) -> pa.Table:
        size = group["size"][0].as_py()
        sums, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in group.to_batches(1024):
            for planes, count, is_best in zip(batch["planes"].to_pylist(), batch["count"].to_pylist(), batch["best"].to_pylist(), strict=True):
                for k, plane in enumerate(planes):
                    local = numbers_of(plane, size)
                    sums[local] += count << k
                    if is_best:
                        best[local] += 1 << k
        return pa.table([pa.array([group["chunk"][0].as_py()] * size, pa.int64()), pa.array(range(size), pa.int32()), best, sums], schema=out_schema)

    scores = told.groupBy("chunk").applyInArrow(give, "chunk long, local int, n_best long, count_sum long")
    rows = index.filter("pair IS NULL").select("chunk", "local", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")
    joined = rows.join(scores, ["chunk", "local"], "left").fillna(0, ["n_best", "count_sum"])
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"), pairs.select("a", "b", "docs", "links", "best")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all ``documents``."""
    return align(table(spark, sf_dir, "documents"))[0].drop("groups")

