"""Bounded-space online packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, table

#: Texts of these characters only (ASCII, Latin-1 letters and signs, Latin Extended) are encoded by the faster library.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*")


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None, special: bool = True):
    """A function from text to ids. Without ``special`` the strings of special tokens are plain text.

    ``vocabulary`` names a ``tokenizers`` file, ``ranks`` the same vocabulary for ``tiktoken``, which gives the same
    ids about five times as fast (a test compares them over every character it's used for). Other texts, and those
    with the string of a special token, go to ``tokenizers``.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    slow.encode_special_tokens = not special
    if ranks is None:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as lines:
        ranked = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranked, special_tokens={})
    return lambda text: fast.encode_ordinary(text) if "<|endoftext|>" not in text and _PLAIN.fullmatch(text) else slow.encode(text, add_special_tokens=False).ids


class Windows:
    """The open windows of one partition: best fit, and the fullest is emitted when none fits."""

    def __init__(self, length: int, count: int, min_cut: int) -> None:
        self.length, self.count, self.min_cut = length, count, min_cut
        self.open: list[tuple[int, list]] = []  # free places, pieces

    def place(self, piece: tuple) -> Iterator[list]:
        """Put a piece ``(.., .., ids, ..)`` shorter than a window somewhere; gives the windows that are closed by this.

        If it fits nowhere and all windows are open, the fullest is emitted. When its gap is at least ``min_cut``,
        the gap is filled with the piece's head first, for documents may be cut anywhere.
        """
        doc_id, start, ids, total = piece
        fits = [(free, k) for k, (free, _) in enumerate(self.open) if free >= len(ids)]
        if fits:
            free, k = min(fits)
            self.open[k] = (free - len(ids), [*self.open[k][1], piece])
            if free == len(ids):
                yield self.open.pop(k)[1]
        elif len(self.open) < self.count:
            self.open.append((self.length - len(ids), [piece]))
        else:
            k = min(range(len(self.open)), key=lambda k: self.open[k][0])
            free, held = self.open.pop(k)
            if free >= self.min_cut:
                held.append((doc_id, start, ids[:free], total))
                piece = (doc_id, start + free, ids[free:], total)
            yield held
            yield from self.place(piece)

    def rest(self) -> Iterator[list]:
        """Merge the leftovers: join the open windows' pieces, cut at the length, and the remainder at powers of two."""
        left = [p for _, held in sorted(self.open, key=lambda x: x[0]) for p in held]
        self.open = []
        words = sum(len(p[2]) for p in left)
        size, held, room = self.length, [], self.length
        while words:
            if not held:
                while size > words:
                    size //= 2
                room = size
            doc_id, start, ids, total = left.pop(0)
            held.append((doc_id, start, ids[:room], total))
            if len(ids) > room:
                left.insert(0, (doc_id, start + room, ids[room:], total))
            words -= (taken := min(room, len(ids)))
            room -= taken
            if not room:
                yield held
                held = []


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(
    docs: DataFrame,
    length: int = 1024,
    open_windows: int = 64,
    min_cut: int = 8,
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken",
    end_id: int = 0,
) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``; ``ids`` are little-endian 32-bit.

    A document's ids end with ``end_id``. Whole stretches of ``length`` ids become sequences of their own; the tail goes
    to one of ``open_windows`` windows of the partition. At a partition's end the leftovers are merged, the last of
    them into sequences whose lengths are powers of two (``length`` should be one), so that nothing is padded there. No
    shuffle, and memory for the open windows only. ``sequence_id`` holds the partition in its upper bits.

    Nulls: a null text is empty and gives one piece with ``end_id``; a null ``doc_id`` stays null. Very long texts
    are encoded whole. Repeated rows are packed each. Empty tables give no piece. Other columns are ignored.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        windows, number = Windows(length, open_windows, min_cut), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def sequence(pieces: list) -> None:
            nonlocal number
            at = 0
            for doc_id, start, ids, total in pieces:
                rows.append((doc_id, start, len(ids), ids.tobytes(), total, number, at))
                at += len(ids)
            number += 1

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            rows.clear()
            return out

        for doc_id, text in rows_of(batches):
            ids = np.array([*encode(text or ""), end_id], dtype="<u4")
            whole = len(ids) - len(ids) % length
            for start in range(0, whole, length):
                sequence([(doc_id, start, ids[start : start + length], len(ids))])
            if whole < len(ids):
                for held in windows.place((doc_id, whole, ids[whole:], len(ids))):
                    sequence(held)
            if len(rows) >= 2000:
                yield batch()
        for held in windows.rest():
            sequence(held)
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all ``documents``; the digest is of the operator's ids."""
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
