"""Toxicity by multiple-instance learning: sentences are scored, a noisy-or gives the document, documents give the labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, rows_of, stored, table

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
#: Lengths of the word beginnings that are features besides whole words: they find inflected forms.
_PREFIXES = (4, 5, 6)


def features_of(word: str) -> list[str]:
    """The whole word and its beginnings; the latter end in ``*``."""
    return [word, *(word[:n] + "*" for n in _PREFIXES if len(word) >= n)]


def sentences_of(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and text of each sentence: up to a run of ``. ! ?`` or a line feed."""
    for m in _SENTENCE.finditer(text):
        if not m[0].isspace():
            yield m.start(), m.end(), m[0]


@dataclass
class NoisyOr:
    """``1 - (1 - leak) * prod(1 - p)`` over sentences with features; ``p = sigmoid(bias + sum of weights)``."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    leak: float = 0.0

    def sentence(self, features: Iterable[str]) -> float:
        return 1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[f] for f in features), -30, 30)))

    def document(self, text: str, at_least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and start, end and score of its offending sentences."""
        weights = self.weights
        lowered = text.lower()
        if len(lowered) != len(text):  # a few letters grow when lowered; places must stay those of the text
            lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        known = {w: fs for w in set(_WORD.findall(lowered)) if (fs := [f for f in features_of(w) if f in weights])}
        if not known:
            return self.leak, []
        none, found = 1 - self.leak, []
        for start, end, sentence in sentences_of(lowered):
            if held := {f for w in _WORD.findall(sentence) for f in known.get(w, ())}:
                none *= 1 - (p := float(self.sentence(held)))
                if p >= at_least:
                    found.append((start, end, p))
        return 1 - none, found


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the hash of its id; those without id too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12000, vocabulary: int = 4096, rounds: int = 300) -> NoisyOr:
    """Train on documents that aren't held out: at most ``sample`` labelled toxic and ``sample`` others, by hash of the id.

    The sample's ids are a table of bounded size and are broadcast, so the texts aren't shuffled. Features' document
    counts are summed in Spark; the ``vocabulary`` of features most typical of toxic documents, and the sentences
    of the sample that hold any, are all that reaches the driver, where weights are fitted by gradient descent on the
    likelihood of the documents' labels. Classes are weighted by their true numbers.
    """
    train = labels.filter(~held_out(F.col("doc_id"))).filter("toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    numbers = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(numbers) < 2:
        return NoisyOr(leak=float(bool(numbers.get(True))))
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = train.filter("toxic").orderBy(order).limit(sample).unionByName(train.filter("NOT toxic").orderBy(order).limit(sample))
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-sample")

    counted = pa.schema([("feature", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic in rows_of(batches):
                seen[toxic].update({f for w in set(_WORD.findall(text.lower())) for f in features_of(w)})
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield from ((f, seen[1][f], seen[0][f]) for f in seen[0].keys() | seen[1].keys())
                    seen = Counter(), Counter()
            yield from ((f, seen[1][f], seen[0][f]) for f in seen[0].keys() | seen[1].keys())

        yield from in_batches(rows(), counted, 8192)

    weight = {t: numbers[t] / min(numbers[t], sample) for t in (True, False)}
    pos, neg = F.sum("pos"), F.sum("neg")
    odds = F.log((pos + 0.5) / (min(numbers[True], sample) + 1.0)) - F.log((neg + 0.5) / (min(numbers[False], sample) + 1.0))
    typical = texts.mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(pos.alias("pos"), odds.alias("odds")).filter("pos >= 5 AND odds > 1.5")
    names = [r["feature"] for r in typical.orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "feature").limit(vocabulary).select("feature").collect()]
    index = {f: i for i, f in enumerate(names)}

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("toxic", pa.bool_()), ("sentences", pa.list_(pa.list_(pa.int32())))])

        def rows() -> Iterator[tuple]:
            for text, toxic in rows_of(batches):
                bags = ({index[f] for w in _WORD.findall(s) for f in features_of(w) if f in index} for _, _, s in sentences_of(text.lower()))
                yield toxic, [sorted(b) for b in bags if b]

        yield from in_batches(rows(), schema)

    bags = texts.mapInArrow(encode, "toxic boolean, sentences array<array<int>>").collect()
    return _descend(bags, names, weight, rounds)


def _descend(bags: list, names: list[str], weight: dict[bool, float], rounds: int) -> NoisyOr:
    """Adam on the weighted log-likelihood, with a small penalty on the weights."""
    label = np.array([float(r["toxic"]) for r in bags])
    importance = np.where(label > 0, weight[True], weight[False])
    importance /= importance.sum()
    doc = np.repeat(np.arange(len(bags)), [len(r["sentences"]) for r in bags])
    sentences = [s for r in bags for s in r["sentences"]]
    of = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    feature = np.array([f for s in sentences for f in s], dtype=np.int64)
    size, n = len(names) + 2, len(bags)
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    x[: len(names)], x[-2], x[-1] = 2.0, -2.0, -3.0
    for t in range(1, rounds + 1):
        z = np.clip(x[-2] + np.bincount(of, x[feature], len(sentences)), -30, 30)
        p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
        leak = 1 / (1 + np.exp(-x[-1]))
        none = np.log1p(-leak) + np.bincount(doc, np.log1p(-p), n)  # log of the chance that nothing is toxic
        total = np.clip(-np.expm1(none), 1e-9, None)
        slope = importance * np.where(label > 0, -np.exp(none) / total, 1.0)  # of the loss by -none
        by_z = slope[doc] * p
        g = np.zeros(size)
        g[: len(names)] = np.bincount(feature, by_z[of], len(names))
        g[-2], g[-1] = by_z.sum(), (slope * leak).sum()
        g[:-2] += 2e-7 * x[:-2]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
    return NoisyOr(dict(zip(names, x[: len(names)].tolist(), strict=True)), float(x[-2]), float(1 / (1 + np.exp(-x[-1]))))


def score(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """``(doc_id, held_out, score, predicted, sentences)`` for every document; ``sentences`` are those found offending.

    One pass, no shuffle. Nulls: a null text is empty and scores the model's leak; a null ``doc_id`` counts as held
    out. Very long texts are read sentence by sentence. Repeated rows score alike. Empty tables give an empty
    result. Columns besides ``doc_id, text`` are ignored: no label, language, source or id reaches a score.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("sentences", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches):
                value, found = model.document(text or "")
                yield doc_id, value, [{"start": a, "end": b, "score": p} for a, b, p in found]

        yield from in_batches(rows(), schema)

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, sentences array<struct<start: long, end: long, score: double>>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on ``labels``, score all ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("sentences")
