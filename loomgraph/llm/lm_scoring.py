"""Operator 10: cross-entropy difference of two n-gram models.

A target model (documents labelled as good) and a background model (all other documents) share one
vocabulary: every word of the whole corpus. Both are interpolated bigram models with Dirichlet smoothing over
exact counts; background counts are scaled to the target's number of tokens, so both smooth alike. Texts begin
and end with a mark, so that every token is predicted once and stands before one. A document's score
is its mean loss per predicted token under the target model minus that under the background model: below zero reads
more like the target.

Counts are kept where they are used and grow with the corpus. All occurrences of a pair of words meet in one task, which
counts the pair, works out its two losses and sends each row the sum of what it has there (once a task at most,
packed by block of rows, so never more than one sum a token). The loss also needs
the count of the pair's second word: pairs are dealt by that word, so that it is counted on the
spot; only words with more than one in HOT_WORDS of all tokens, of which there are at most HOT_WORDS, are counted first
and broadcast, and their pairs are dealt by both words. Which words are hot changes no result.

    -log p(b|a) = log(c(a) + S) - log(c(a,b) + S p(b)),    p(b) = (c(b) + 1) / (N + V)

The first term of a pair depends on its first word only, which is the second word of the pair before it; so
each pair adds that term for its second word (the end mark stands in for the start mark: both occur once a text).

Tasks pack the pairs of a block of rows by bucket, sort what they get by bucket, and hold one bucket at a time.
Losses are summed as whole millionths of a nat, so sums do not depend on their order.

Defined results: null or empty text has no tokens, losses and score 0; without target or background
tokens every score is 0; a document labelled twice is target if any label says so; null ids are
background; equal texts score alike; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import blocks, bucket_bits, runs, slices, table, text_buffer
from loomgraph.llm.passages import SEEDS, STEP, find_words, mix, word_hashes
from loomgraph.session import durable

#: A word with at least one in HOT_WORDS of all tokens is hot, so there are HOT_WORDS at most.
HOT_WORDS = 1 << 18
#: Dirichlet weight of the unigram model in a bigram's probability.
SMOOTHING = 50.0
#: Text bytes and rows of a block; a row's number leaves one bit of 16 for the model it belongs to.
BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 1 << 15
TARGET_BIT = np.uint16(BLOCK_ROWS)
#: Sums of rows that wait in a task before equal rows are joined and sent.
WAITING_SUMS = 1 << 20
UNIT = 1e6
END = np.uint64(2)
START = np.uint64(1)
#: Marks the hash of a word that is not hot; hot words go by their number.
RARE = np.uint64(1 << 63)


def predicted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all predicted tokens of a block in order: the word before, the word, its row; and the rows' numbers of tokens."""
    data, offsets = text_buffer(batch.column("text"))
    starts, ends = find_words(data, offsets)
    row = np.searchsorted(offsets, starts, side="right") - 1
    words = np.maximum(word_hashes(data, starts, ends, SEEDS[0]), np.uint64(3))
    n = np.bincount(row, minlength=batch.num_rows)
    length = np.where(n > 0, n + 1, 0)
    last = np.cumsum(length)
    after = np.full(int(length.sum()), END)
    inside = np.ones(len(after), bool)
    inside[last[n > 0] - 1] = False
    after[inside] = words
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[(last - length)[n > 0]] = START
    return before, after, np.repeat(np.arange(batch.num_rows), length), n


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def planes(values: np.ndarray) -> bytes:
    """The low and the high halves of 64-bit numbers; the halves of small numbers compress to nothing."""
    return values.astype(np.uint32).tobytes() + (values >> np.uint64(32)).astype(np.uint32).tobytes()


def from_planes(raw: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.frombuffer(raw, np.uint32, n, at).astype(np.uint64) | np.frombuffer(raw, np.uint32, n, at + 4 * n).astype(np.uint64) << np.uint64(32)


WORDS = "bucket long, n int, packed binary"
COUNTS = "word long, target long, background long, distinct long"


def send_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The distinct words of a block with their counts in both models, packed by bucket."""
    for batch in blocks(batches, BLOCK_BYTES, BLOCK_ROWS):
        _, words, row, _ = predicted(batch)
        if not len(words):
            continue
        target = batch.column("target").to_numpy(zero_copy_only=False)[row]
        order = np.argsort(words, kind="stable")
        words, target = words[order], target[order]
        first = firsts(words)
        n = np.diff(np.append(first, len(words))).astype(np.uint32)
        good = np.add.reduceat(target.astype(np.int64), first).astype(np.uint32)
        words = words[first]
        rows = []
        for bucket, a, b in slices(words >> np.uint64(64 - bits)):
            rows.append((bucket, b - a, words[a:b].tobytes() + zlib.compress(good[a:b].tobytes() + n[a:b].tobytes(), 1)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "n", "packed"])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket the words that may be hot, and in a row without a word the totals."""
    for _, rows in runs(batches):
        words = np.concatenate([np.frombuffer(p, np.uint64, n) for _, n, p in rows])
        counts = [np.frombuffer(zlib.decompress(p[8 * n :]), np.uint32).reshape(2, n) for _, n, p in rows]
        good, n = np.concatenate(counts, axis=1).astype(np.int64)
        order = np.argsort(words, kind="stable")
        first = firsts(words[order])
        words, good, n = words[order][first], np.add.reduceat(good[order], first), np.add.reduceat(n[order], first)
        # a word that is hot in the whole corpus is hot in its bucket
        hot = (n * HOT_WORDS >= n.sum()) | (words == END)
        columns = (
            pa.concat_arrays([pa.array(words[hot].view(np.int64)), pa.nulls(1, pa.int64())]),
            pa.array(np.append(good[hot], good.sum())),
            pa.array(np.append((n - good)[hot], (n - good).sum())),
            pa.array(np.append(np.zeros(hot.sum(), np.int64), len(words))),
        )
        yield pa.RecordBatch.from_arrays(list(columns), names=["word", "target", "background", "distinct"])


@dataclass
class Corpus:
    """Both models' tokens, the size of the vocabulary, and the hot words (sorted) with their counts."""

    tokens: np.ndarray
    words: int
    hot: np.ndarray
    hot_counts: np.ndarray

    @property
    def scale(self) -> np.ndarray:
        """Counts are taken at the target's size; the models are the target and the background."""
        return self.tokens[0] / self.tokens

    def named(self, words: np.ndarray) -> np.ndarray:
        """Hot words by number, others by their marked hash."""
        place = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        return np.where(self.hot[place] == words, place.astype(np.uint64), words | RARE)

    def losses(self, pair: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Per model what a pair with these counts adds, in millionths of a nat."""
        scale = self.scale[:, None]
        p = (after * scale + 1.0) / (self.tokens[0] + self.words)
        loss = np.log(after * scale + SMOOTHING) - np.log(pair * scale + SMOOTHING * p)
        return np.rint(loss * UNIT).astype(np.int64)


def corpus_counts(marked: DataFrame, bits: int, partitions: int) -> Corpus:
    sent = marked.select("text", "target").mapInArrow(partial(send_words, bits=bits), WORDS)
    counted = durable(sent.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(count_words, COUNTS), "lm-words")
    sums = counted.filter("word is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("target", "background", "distinct"))).first()
    total = sums.target + sums.background
    # at most HOT_WORDS words, and the end mark
    hot = counted.filter("word is not null").filter((F.col("target") + F.col("background")) * HOT_WORDS >= total).union(counted.filter(F.col("word") == int(END)))
    rows = sorted({(r.word % (1 << 64), r.target, r.background) for r in hot.collect()})
    counts = np.array([r[1:] for r in rows], np.float64).reshape(-1, 2).T
    return Corpus(np.array([sums.target, sums.background], np.float64), sums.distinct, np.array([r[0] for r in rows], np.uint64), counts)


PAIRS = "bucket long, block long, n int, packed binary, ids binary"
SUMS = "block long, n int, packed binary, ids binary"
SCORED = "doc_id long, n_tokens long, target long, background long"


def send_pairs(batches: Iterator[pa.RecordBatch], corpus, bits: int) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of words of a block and the rows that hold them, packed by bucket; and a row with the ids and
    numbers of tokens of the block's rows."""
    model = corpus.value
    for batch in blocks(batches, BLOCK_BYTES, BLOCK_ROWS):
        before, after, row, n_tokens = predicted(batch)
        ids = batch.column("doc_id").to_pylist()
        keys = batch.column("row_key").to_numpy()
        # the same rows in the same order make the same block, also in a task that is run again
        block = xxhash.xxh64_intdigest(keys.tobytes()) - (1 << 63)
        known = np.array([d is not None for d in ids], np.uint8)
        table_of_rows = known.tobytes() + np.array([d or 0 for d in ids], np.int64).tobytes() + n_tokens.astype(np.int64).tobytes()
        rows = [(block & ((1 << bits) - 1), block, len(ids), None, table_of_rows)]
        if len(after):
            target = batch.column("target").to_numpy(zero_copy_only=False)
            place = row.astype(np.uint16) | np.where(target[row], TARGET_BIT, np.uint16(0))
            before, after = model.named(before), model.named(after)
            dealt = mix(np.where(after < RARE, before * STEP[0] + after, after))
            order = np.lexsort((place, before, after, dealt >> np.uint64(64 - bits)))
            bucket, before, after, place = (dealt >> np.uint64(64 - bits))[order], before[order], after[order], place[order]
            first = firsts(bucket, after, before)
            count = np.diff(np.append(first, len(place))).astype(np.uint32)
            bucket, before, after = bucket[first], before[first], after[first]
            ends = np.append(first, len(place))
            for k, a, b in slices(bucket):
                packed = planes(after[a:b]) + planes(before[a:b]) + count[a:b].tobytes() + place[ends[a] : ends[b]].tobytes()
                rows.append((k, block, b - a, zlib.compress(packed, 1), None))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in PAIRS.split(", ")])


def joined_sums(parts: list[tuple]) -> tuple:
    """Parts of (block, row, target, background), sorted, with one sum for each row."""
    block, row, *losses = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((row, block))
    block, row = block[order], row[order]
    first = firsts(block, row)
    return block[first], row[first], *(np.add.reduceat(x[order], first) for x in losses)


def packed_sums(block: np.ndarray, row: np.ndarray, target: np.ndarray, background: np.ndarray) -> pa.RecordBatch:
    rows = []
    for k, a, b in slices(block):
        rows.append((k, b - a, zlib.compress(row[a:b].tobytes() + target[a:b].tobytes() + background[a:b].tobytes(), 1), None))
    return _sums(rows)


def _sums(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in SUMS.split(", ")])


def pair_losses(batches: Iterator[pa.RecordBatch], corpus) -> Iterator[pa.RecordBatch]:
    """For the rows of all blocks the sums of the losses of their pairs in this task's buckets."""
    model = corpus.value
    waiting, n_waiting = [], 0
    for _, rows in runs(batches):
        packed = []
        for _, block, n, blob, table_of_rows in rows:
            if blob is not None:
                packed.append((block, n, zlib.decompress(blob)))
            else:
                yield _sums([(block, n, None, table_of_rows)])
        if not packed:
            continue
        after = np.concatenate([from_planes(raw, n) for _, n, raw in packed])
        before = np.concatenate([from_planes(raw, n, 8 * n) for _, n, raw in packed])
        count = np.concatenate([np.frombuffer(raw, np.uint32, n, 16 * n) for _, n, raw in packed]).astype(np.int64)
        place = np.concatenate([np.frombuffer(raw, np.uint16, offset=20 * n) for _, n, raw in packed])
        block = np.repeat(np.array([b for b, _, _ in packed]), [(len(raw) - 20 * n) // 2 for _, n, raw in packed])
        good = np.add.reduceat((place & TARGET_BIT > 0).astype(np.int64), np.cumsum(count) - count)
        both = np.stack([good, count - good])
        order = np.lexsort((before, after))
        after, both = after[order], both[:, order]
        first = firsts(after, before[order])
        pair = np.add.reduceat(both, first, axis=1)
        word = firsts(after[first])
        of_word = np.repeat(np.arange(len(word)), np.diff(np.append(word, len(first))))
        # all pairs of a word that is not hot are here; a hot word's count is known
        single = np.add.reduceat(pair, word, axis=1)[:, of_word].astype(np.float64)
        hot = after[first] < RARE
        single[:, hot] = model.hot_counts[:, after[first][hot].astype(np.int64)]
        found = model.losses(pair, single)
        losses = np.empty((2, len(order)), np.int64)
        losses[:, order] = np.repeat(found, np.diff(np.append(first, len(order))), axis=1)
        at = np.repeat(np.arange(len(count)), count)
        waiting.append((block, place & (TARGET_BIT - np.uint16(1)), losses[0][at], losses[1][at]))
        n_waiting += len(place)
        if n_waiting > WAITING_SUMS:
            waiting = [joined_sums(waiting)]
            n_waiting = len(waiting[0][0])
            if n_waiting > WAITING_SUMS // 2:
                yield packed_sums(*waiting[0])
                waiting, n_waiting = [], 0
    if waiting:
        yield packed_sums(*joined_sums(waiting))


def sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of every block with the sums of all their losses."""
    for _, rows in runs(batches):
        tables = [(n, ids) for _, n, _, ids in rows if ids is not None]
        n, table_of_rows = tables[0]
        sums = np.zeros((2, n), np.int64)
        for _, m, packed, _ in rows:
            if packed is not None:
                raw = zlib.decompress(packed)
                sums[:, np.frombuffer(raw, np.uint16, m)] += np.frombuffer(raw[2 * m :], np.int64).reshape(2, m)
        unknown = np.frombuffer(table_of_rows, np.uint8, n) == 0
        ids, tokens = np.frombuffer(table_of_rows[n:], np.int64).reshape(2, n)
        # blocks with equal rows share their number, and so these sums
        columns = [pa.array(ids, mask=unknown), pa.array(tokens), *(pa.array(x // len(tables)) for x in sums)]
        for _ in tables:
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCORED.split(", ")])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: n_tokens, mean loss under both models, and their difference."""
    spark = docs.sparkSession
    bits, partitions = bucket_bits(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("row_key"))
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("good_id")).distinct().withColumn("target", F.lit(True))
    # labels grow with the documents, so both sides are shuffled at every size; the written table gives both passes equal blocks
    # rows without an id are dealt by their text, as they meet none
    joined = given.join(good.hint("merge"), F.coalesce("doc_id", "row_key") == F.col("good_id"), "left")
    target = F.col("doc_id").isNotNull() & F.coalesce("target", F.lit(False))
    marked = durable(joined.select("doc_id", "row_key", "text", target.alias("target")), "lm-corpus")
    counts = corpus_counts(marked, bits, partitions)
    if not counts.tokens.all():
        n_tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
        return given.select("doc_id", n_tokens.alias("n_tokens"), *(F.lit(0.0).alias(c) for c in ("target_loss", "background_loss", "score")))
    corpus = spark.sparkContext.broadcast(counts)  # HOT_WORDS words at most
    pairs = marked.mapInArrow(partial(send_pairs, corpus=corpus, bits=bits), PAIRS)
    sums = pairs.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(partial(pair_losses, corpus=corpus), SUMS)
    rows = sums.repartition(partitions, "block").sortWithinPartitions("block").mapInArrow(sum_blocks, SCORED)
    per_token = F.greatest(F.col("n_tokens") + 1, F.lit(1)) * UNIT
    scored = rows.withColumns({"target_loss": F.col("target") / per_token, "background_loss": F.col("background") / per_token})
    return scored.select("doc_id", "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))


def op10_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
