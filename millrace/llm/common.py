"""What the training-data operators share: table access, stored intermediates and word hashing.

Word rule used throughout: a word is a maximal run of characters other than space, tab, line feed,
vertical tab, form feed and carriage return. ``bytes.split()`` without arguments splits on exactly these.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Multipliers of the window hash and of its check; odd, so that they have inverses modulo 2**64.
_MULTIPLIER, _CHECK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local
    if _local is None:
        _local = tempfile.mkdtemp(prefix="millrace-")
    return f"file://{_local}"


_local: str | None = None


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the multiplier and of its inverse, grown when a longer text comes."""

    def __init__(self, multiplier: int) -> None:
        self.multiplier, self.inverse = multiplier, pow(multiplier, -1, 1 << 64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def ensure(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1024)
            self.up, self.down = np.full(n, self.multiplier, np.uint64), np.full(n, self.inverse, np.uint64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)


_powers, _check_powers = Powers(_MULTIPLIER), Powers(_CHECK)


def window_checks(hashes: np.ndarray, k: int) -> np.ndarray:
    """32 further bits for each window, from another multiplier."""
    return (window_hashes(hashes, k, _check_powers) >> np.uint64(32)).astype(np.uint32)


def window_hashes(hashes: np.ndarray, k: int, _powers: Powers = _powers) -> np.ndarray:
    """A 64-bit hash for each window of ``k`` consecutive words, in a few passes whatever ``k`` is."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    _powers.ensure(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers.up[:n], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * _powers.down[: n - k + 1])


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a window of length ``k`` that begins at one of ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + k, -1)
    return np.cumsum(steps[:n]) > 0


def rows_of(batches: Iterable[pa.RecordBatch], at_once: int = 256) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a few hundred at a time so that long texts don't pile up in Python."""
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            part = batch.slice(start, at_once)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def in_batches(rows: Iterable[tuple], schema: pa.Schema, at_once: int = 2048) -> Iterator[pa.RecordBatch]:
    """Arrow batches of row tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
