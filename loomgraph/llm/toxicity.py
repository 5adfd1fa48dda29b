"""Operator 3: toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from a logistic model over its
character n-grams; the document's score is their noisy-or, 1 - prod(1 - p), so a document label alone
says that at least one sentence is at fault. Gradients of the noisy-or find which. The trained
sentence scores then locate the offending sentences.

The model is fitted on a bounded, documented sample of labelled ids (MAX_TOXIC and MAX_CLEAN of them,
those with the least hash; of the texts of one id that with the least hash; texts of over MAX_TEXT_BYTES are left
out, and so is what exceeds SAMPLE_BYTES of either kind): it is the size of its table of weights whatever the data.
Scoring covers whole texts and all rows, without shuffling them.

Defined results: null or empty text has no sentence and score 0; equal texts have equal scores; rows
labelled twice count as toxic if any label says so; null labels teach nothing; without labelled rows
of both kinds every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import CHUNK_BYTES, chunks, table, text_buffer, texts_of
from loomgraph.session import durable

#: The labelled rows that the model is fitted on, at most.
MAX_TOXIC = 2000
MAX_CLEAN = 4000
MAX_TEXT_BYTES = 1 << 18
SAMPLE_BYTES = 16 << 20
#: Lengths of the n-grams in bytes, and their hash space.
NGRAMS = (4, 6)
HASH_BITS = 19
THRESHOLD = 0.3
#: Training: a feature is used from this many labelled documents on, and if its log odds exceed the cut.
MIN_DOCUMENTS = 5
MIN_LOG_ODDS = 1.0
EPOCHS = 200
LEARNING_RATE = 0.3
L2 = 1e-3
START_BIAS = -6.0
#: Share of the loss that the toxic rows have together.
TOXIC_SHARE = 0.2

#: Byte classes: sentence ends, and everything that separates words (lower-cased otherwise).
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def ngram_buckets(folded: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n bytes that start at each place (fewer places at the end are left out)."""
    size = len(folded) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    value = np.zeros(size, np.uint64)
    for k in range(n):
        value = (value << np.uint64(8)) | folded[k : k + size]
    value = value * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return (value >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def sentence_borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all sentences, and the index of the first sentence of each row (n + 1 entries)."""
    starts = np.concatenate([np.flatnonzero(_ENDS[data]) + 1, offsets[:-1]])
    starts = np.unique(starts[starts < len(data)])
    return starts, np.searchsorted(starts, offsets)


def present(starts: np.ndarray, ends: np.ndarray, buckets: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (sentence, bucket) pairs of the n-grams at places ``at`` that lie inside one sentence.

    A feature is present or not: a word said a thousand times in one sentence counts once.
    """
    inside = np.searchsorted(starts, at, side="right") - 1
    ok = at + n <= ends[inside]
    pairs = np.unique(inside[ok] << HASH_BITS | buckets[at[ok]])
    return pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1)


def sentence_logits(data: np.ndarray, starts: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The sentences' logits: bias plus the weights of the distinct n-grams inside."""
    if not len(starts):
        return np.zeros(0)
    folded = _FOLD[data]
    ends = np.append(starts[1:], len(data))
    total = np.full(len(starts), bias, np.float64)
    for n in NGRAMS:
        buckets = ngram_buckets(folded, n)
        sentence, bucket = present(starts, ends, buckets, np.flatnonzero(weights[buckets]), n)
        total += np.bincount(sentence, weights[bucket], len(starts))
    return total


def noisy_or(logits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row 1 - prod(1 - sigmoid(logit)) over its sentences."""
    clean = -np.logaddexp(0.0, logits)  # log(1 - p)
    summed = np.concatenate([[0.0], np.cumsum(clean)])
    return -np.expm1(np.minimum(summed[first[1:]] - summed[first[:-1]], 0.0))


def fit(texts: list[bytes], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by hash bucket, and the bias, from document labels."""
    weights = np.zeros(1 << HASH_BITS, np.float32)
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    if not n_toxic or not n_clean:
        return weights, -np.inf
    seen = np.zeros((2, 1 << HASH_BITS), np.int64)
    for text, label in zip(texts, toxic):
        folded = _FOLD[np.frombuffer(text, np.uint8)]
        found = np.unique(np.concatenate([ngram_buckets(folded, n) for n in NGRAMS]))
        seen[int(label), found] += 1
    odds = np.log((seen[1] + 0.5) / (n_toxic + 1)) - np.log((seen[0] + 0.5) / (n_clean + 1))
    used = (seen.sum(axis=0) >= MIN_DOCUMENTS) & (np.abs(odds) >= MIN_LOG_ODDS)
    column = np.full(1 << HASH_BITS, -1, np.int64)
    column[used] = np.arange(used.sum())
    sentence, feature, rows = [], [], [0]
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        starts, _ = sentence_borders(data, np.array([0, len(data)]))
        folded = _FOLD[data]
        ends = np.append(starts[1:], len(data))
        for n in NGRAMS:
            buckets = ngram_buckets(folded, n)
            inside, bucket = present(starts, ends, buckets, np.flatnonzero(used[buckets]), n)
            sentence.append(rows[-1] + inside)
            feature.append(column[bucket])
        rows.append(rows[-1] + len(starts))
    sentence, feature, first = np.concatenate(sentence), np.concatenate(feature), np.array(rows)
    n_sentences, n_features = rows[-1], int(used.sum())
    document = np.repeat(np.arange(len(texts)), np.diff(first))
    w, bias = np.zeros(n_features), START_BIAS
    moments = [np.zeros(n_features + 1), np.zeros(n_features + 1)]
    balance = np.where(toxic, TOXIC_SHARE / n_toxic, (1 - TOXIC_SHARE) / n_clean)
    for epoch in range(1, EPOCHS + 1):
        logits = np.bincount(sentence, w[feature], n_sentences) + bias
        p = 1 / (1 + np.exp(np.minimum(-logits, 700.0)))
        score = np.clip(noisy_or(logits, first), 1e-9, 1 - 1e-9)
        # d loss / d logit of a sentence: p for a clean document, -p (1 - score) / score for a toxic one
        slope = np.where(toxic, -(1 - score) / score, 1.0) * balance
        g = slope[document] * p
        gradient = np.append(np.bincount(feature, g[sentence], n_features) + L2 * w / len(texts), g.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        step = LEARNING_RATE * (moments[0] / (1 - 0.9**epoch)) / (np.sqrt(moments[1] / (1 - 0.99**epoch)) + 1e-8)
        w -= step[:-1]
        bias = min(bias - step[-1], -3.0)
    weights[used] = w
    return weights, float(bias)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and label of the bounded sample: the labelled rows of each kind with the least hash of their id."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = (
        known.filter("__toxic = 1").orderBy(*order).limit(MAX_TOXIC).union(known.filter("__toxic = 0").orderBy(*order).limit(MAX_CLEAN))
    )
    few = F.broadcast(chosen.select(F.col("doc_id").alias("__id"), "__toxic"))  # MAX_TOXIC + MAX_CLEAN rows at most
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = given.filter(F.octet_length("text") <= MAX_TEXT_BYTES).join(few, F.col("doc_id") == F.col("__id"))
    one = found.groupBy("doc_id", "__toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    running = Window.partitionBy("__toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return one.withColumn("__bytes", F.sum(F.octet_length("text")).over(running)).filter(F.col("__bytes") <= SAMPLE_BYTES).drop("__bytes")


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fits in one task on the bounded sample; the table of weights comes back to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), batch.column("__toxic").to_pylist())
        rows.sort()
        weights, bias = fit([r[1] for r in rows], np.array([r[2] == 1 for r in rows], bool))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], names=["weights", "bias"])

    sample = durable(training_rows(docs, labels), "toxic-sample")
    model = sample.coalesce(1).mapInArrow(run, "weights binary, bias double").collect()
    if not model:
        return np.zeros(1 << HASH_BITS, np.float32), -np.inf
    return np.frombuffer(model[0].weights, np.float32), model[0].bias


@lru_cache(maxsize=8)
def _score_column(model):
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        weights, bias = model.value
        parts = [np.zeros(0)]
        for batch in chunks([pa.RecordBatch.from_arrays([text.cast(pa.string())], names=["text"])], "text", CHUNK_BYTES // 4):
            data, offsets = text_buffer(batch.column("text"))
            starts, first = sentence_borders(data, offsets)
            parts.append(noisy_or(sentence_logits(data, starts, weights, bias), first))
        return pa.array(np.concatenate(parts), pa.float64())

    return score


def score_documents(docs: DataFrame, labels: DataFrame, column: str = "score") -> DataFrame:
    """``docs`` with the toxicity of every row's whole text."""
    return docs.withColumn(column, toxicity_of(docs, labels))


def toxicity_of(docs: DataFrame, labels: DataFrame) -> Column:
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # one table of 2**HASH_BITS weights
    return _score_column(model)(F.col("text").cast("string"))


def offending_sentences(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, byte span, text and score of the sentences that reach the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in chunks(batches, "text"):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                data = np.frombuffer(text, np.uint8)
                starts, _ = sentence_borders(data, np.array([0, len(data)]))
                p = 1 / (1 + np.exp(-sentence_logits(data, starts, weights, bias)))
                ends = np.append(starts[1:], len(data))
                for k in np.flatnonzero(p >= threshold):
                    out.append((doc_id, int(starts[k]), int(ends[k]), text[starts[k] : ends[k]].decode("utf-8", "replace"), float(p[k])))
            names = ["doc_id", "start", "end", "sentence", "score"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(locate, "doc_id long, start long, end long, sentence string, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score stays under the threshold."""
    return docs.filter(toxicity_of(docs, labels) < threshold)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
