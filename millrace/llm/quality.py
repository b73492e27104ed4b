"""Line-first cleaning: judge every line, remove the failures, then reject documents that lost too much text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import covered, in_batches, rows_of, table, window_hashes, word_hashes

#: Characters that count as symbols, and white space between words.
SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\v\f\r"
_SEPARATOR = re.compile(r"[|»›·•→]")
_SENTENCE = re.compile(r"[.!?…:;。！？]")
_SHOUT = re.compile(r"!!+(?=\s|$)")
_SYMBOL_WORD = re.compile(r"[#*$%&<>]{2,}")
_BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie(?:s| policy)|enable javascript|lorem ipsum|"
    r"click here|sign (?:in|up) (?:to|for)|subscribe (?:to|now)|share (?:this|on) |skip to (?:main )?content|read more",
    re.IGNORECASE,
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the verdict on a document.

    min_words_punctuated: a line of so many words must hold sentence punctuation somewhere.
    max_symbol_words, max_shouts: shares of words that carry runs of symbols or end in several exclamation marks.
    nav_separators, nav_share: a navigation line has so many separators, and one for so large a share of its words.
    boilerplate_words: a line up to this length that holds a boilerplate phrase is boilerplate.
    max_lost: a document that loses more than this share of its non-space characters is rejected.
    """

    min_words_punctuated: int = 6
    max_symbol_words: float = 0.3
    max_shouts: float = 0.3
    nav_separators: int = 3
    nav_share: float = 0.2
    boilerplate_words: int = 25
    max_lost: float = 0.5

    def fails(self, line: str) -> str | None:
        """Which rule a line fails, if any; blank lines pass."""
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            return None
        separators = len(_SEPARATOR.findall(line))
        if separators >= self.nav_separators and separators >= self.nav_share * n:
            return "navigation"
        if len(_SYMBOL_WORD.findall(line)) > self.max_symbol_words * n or len(_SHOUT.findall(line)) > self.max_shouts * n and n > 3:
            return "punctuation"
        if n >= self.min_words_punctuated and not _SENTENCE.search(line):
            return "punctuation"
        if n <= self.boilerplate_words and _BOILERPLATE.search(line):
            return "boilerplate"
        return None


def _chars(text: bytes) -> int:
    """Code points besides white space."""
    return len(text.translate(None, SPACE).translate(None, bytes(range(0x80, 0xC0))))


def judged(doc_id: int | None, text: str | None, rules: LineRules) -> tuple:
    """One document: statistics of its words, the cleaned text and the verdict."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, chars = len(words), _chars(raw)
    lines = raw.split(b"\n")
    worded = [x for x in lines if x.strip(SPACE)]
    repeated = 0
    if n >= 5:
        _, back, counts = np.unique(window_hashes(word_hashes(words), 5), return_inverse=True, return_counts=True)
        if (twice := counts[back] > 1).any():
            repeated = int(covered(np.flatnonzero(twice), 5, n).sum())
    verdict = {x: rules.fails(x.decode("utf-8", "surrogatepass")) for x in set(worded)}
    left = [x for x in lines if not verdict.get(x)]
    lost = chars - sum(map(_chars, left)) if len(left) < len(lines) else 0
    base_failed = n < 10 or 100 * repeated > 20 * n
    kept = not base_failed and lost <= rules.max_lost * chars
    cleaned = text or "" if len(left) == len(lines) else b"\n".join(left).decode("utf-8", "surrogatepass")
    return doc_id, n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(worded) - len(verdict), repeated, base_failed, len(lines) - len(left), lost, cleaned, kept


_SCHEMA = pa.schema(
    [
        *((c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ("base_failed", pa.bool_()), ("lines_removed", pa.int64()), ("chars_lost", pa.int64()), ("clean_text", pa.string()), ("kept", pa.bool_()),
    ]
)
_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lines_removed long, chars_lost long, clean_text string, kept boolean"


def clean(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """Statistics, ``clean_text`` (the text without its failing lines) and the verdict ``kept`` for each document.

    One pass over the texts, no shuffle: documents are judged by themselves. Nulls: a null text is an empty one
    (no words, so not kept), a null ``doc_id`` passes through. Very long texts are handled line by line and with
    arrays of a few bytes a word. Repeated rows are judged alike. Empty tables give an empty result. Columns besides
    ``doc_id`` and ``text`` are ignored. Without ``with_text``, ``clean_text`` is null and isn't moved out of Python.
    """

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (judged(i, t, rules) for i, t in rows_of(batches))
        yield from in_batches(found if with_text else ((*x[:9], None, x[10]) for x in found), _SCHEMA, 512)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, _DDL)


def keep_clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` without the rejected documents and without failing lines; all columns stay, ``n_chars`` follows the text."""
    names = docs.columns
    at = names.index("text")

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [judged(None, t, rules) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array([x[9] for x in found], part.schema.field(at).type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    columns[k] = pa.array([len(x[9]) if x[7] else n for x, n in zip(found, part.column(k).to_pylist(), strict=True)], part.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array([x[10] for x in found], pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all ``documents``."""
    return clean(table(spark, sf_dir, "documents"), with_text=False).drop("clean_text")
