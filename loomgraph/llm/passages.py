"""Operator 9: repeated passages by a log-structured fingerprint index.

A word goes if a window of 35 words covering it also starts anywhere else. Of the 10-word grams in a
window the one(s) of least hash are its fingerprints, so equal windows share them. Documents arrive in
batches (``FingerprintIndex.add``; a kept index takes further batches later). Each batch writes one immutable run,
bucketed and sorted by fingerprint; the run is merge-joined with every historical run (equal buckets, no shuffle
of the index) to find what has been seen before, and runs are compacted into one when there are more than MAX_RUNS.
A whole table is fingerprinted in one pass over its texts, and its blocks of rows are the batches. Rows that hold a
repeated fingerprint are then verified: their windows are compared by two independent digests (64 and 32 bits) of
the words themselves.

A block of documents sends a fingerprint or a window once however often it repeats there, so a passage in
a third of all rows costs a row per block. Windows are dealt by their own digest, so windows around one
common gram do not meet in one task. Tasks sort what they get by bucket and hold one bucket at a time.

Defined results: null or empty text has no words; rows are told apart by id and text, so rows without an
id take part and equal rows count as each other's copies; texts of fewer than 35 words keep everything;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bucket_bits, chunks, runs, table, text_buffer
from loomgraph.llm.substrings import BLOCK_BYTES, merged_spans, sliding
from loomgraph.session import durable, shared_path

WINDOW = 35
GRAM = 10
PLACES = WINDOW - GRAM + 1
#: Batches in which a whole table is indexed, and runs kept before they are compacted.
BATCHES = 3
MAX_RUNS = 2
STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
SEEDS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def mix(value: np.ndarray) -> np.ndarray:
    value = value ^ (value >> np.uint64(30))
    value = value * np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(27)
    value *= np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none crosses a row's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    two = padded[:-1].astype(np.uint16) | padded[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    eight = four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)
    length = ends - starts
    out = mix(length.astype(np.uint64) + seed)
    rows = np.arange(len(starts))
    at = 0
    while len(rows):
        rest = np.minimum(length[rows] - at, 8).astype(np.uint64)
        value = eight[starts[rows] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
        out[rows] = mix(out[rows] * STEP[0] + value + seed)
        at += 8
        rows = rows[length[rows] > at]
    return out


def run_hashes(words: np.ndarray, at: np.ndarray, width: int, step: np.uint64) -> np.ndarray:
    """A hash of the ``width`` words from each place in ``at``."""
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = out * step + words[at + k]
    return mix(out)


def find_fingerprints(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the fingerprint grams, the grams' hashes, and every window's least order (-1: window leaves its row)."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = run_hashes(words, np.arange(len(words) - GRAM + 1), GRAM, STEP[0])
    order = (grams >> np.uint64(33)).astype(np.int64)
    least = sliding(order, PLACES, True)
    least = np.where(row[: len(least)] == row[WINDOW - 1 :], least, -1)
    best = sliding(np.pad(least, PLACES - 1, constant_values=-1), PLACES, False)
    return np.flatnonzero(best == order), grams, least


def _rows(batch: pa.RecordBatch) -> tuple:
    data, offsets = text_buffer(batch.column("text"))
    starts, ends = find_words(data, offsets)
    row = np.searchsorted(offsets, starts, side="right") - 1
    return batch.column("row_key").to_numpy(), data, offsets, starts, ends, row


RUN = "h long, row_key long, n int, keys array<long>, block long"


def send_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows: (h, row_key, 1) for a fingerprint met once in the block, (h, null, n) for one met n times,
    and (., row_key, 0, keys) with the fingerprints of a row that the block has already found repeated; and the block."""
    for batch in chunks(batches, "text", BLOCK_BYTES):
        ids, data, offsets, starts, ends, row = _rows(batch)
        words = word_hashes(data, starts, ends, SEEDS[0])
        at, grams, _ = find_fingerprints(words, row)
        keys, of = grams[at].view(np.int64), row[at]
        order = np.argsort(keys, kind="stable")
        keys, of = keys[order], of[order]
        if not len(keys):
            continue
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(first, len(keys)))
        once, more = first[count == 1], first[count > 1]
        repeated = np.repeat(count > 1, count)
        pairs = np.unique(np.stack([of[repeated], keys[repeated]]), axis=1)
        cuts = np.flatnonzero(np.diff(pairs[0], prepend=-1, append=-1)) if pairs.shape[1] else np.zeros(1, np.int64)
        held = ids[pairs[0][cuts[:-1]]]
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(pairs[1]))
        n = len(once) + len(more)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([keys[once], keys[more], held])),
                pa.concat_arrays([pa.array(ids[of[once]]), pa.nulls(len(more), pa.int64()), pa.array(held)]),
                pa.array(np.concatenate([np.ones(len(once)), count[count > 1], np.zeros(len(held))]).astype(np.int32)),
                pa.concat_arrays([pa.nulls(n, lists.type), lists]),
                pa.array(np.full(n + len(held), xxhash.xxh64_intdigest(ids.tobytes()) - (1 << 63))),
            ],
            names=["h", "row_key", "n", "keys", "block"],
        )


class FingerprintIndex:
    """Sorted immutable runs of fingerprints, as tables bucketed by them in the warehouse."""

    def __init__(self, spark: SparkSession, n_buckets: int | None = None):
        self.spark = spark
        self.n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.repeated: list[DataFrame] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        placed = rows.repartition(self.n_buckets, "h").sortWithinPartitions("h")
        writer = placed.write.format("parquet").bucketBy(self.n_buckets, "h").sortBy("h")
        writer.option("path", shared_path(self.spark, "run")).saveAsTable(name)
        return name

    def add(self, docs: DataFrame) -> None:
        """Appends a batch of rows (row_key, text)."""
        self.add_fingerprints(docs.select("row_key", "text").mapInArrow(send_fingerprints, RUN))

    def add_fingerprints(self, rows: DataFrame) -> None:
        """Appends the index rows of a batch: one run, merge-joined with the history."""
        run = self._write(rows.drop("block"))
        fresh = self.spark.table(run).filter("n > 0")
        seen = fresh.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
        for old in self.runs:
            seen = seen.union(fresh.join(self.spark.table(old).filter("n > 0").select("h"), "h", "left_semi").select("h"))
        self.repeated.append(durable(seen.distinct(), "repeated"))
        self.runs.append(run)
        if len(self.runs) > MAX_RUNS:
            self.compact()

    def compact(self) -> None:
        """Merges all runs into one."""
        old, rows = self.runs, self.rows()
        self.runs = [self._write(rows)]
        for name in old:
            self.spark.sql(f"DROP TABLE {name}")

    def rows(self) -> DataFrame:
        rows = self.spark.table(self.runs[0])
        for name in self.runs[1:]:
            rows = rows.union(self.spark.table(name))
        return rows

    def candidates(self) -> DataFrame:
        """row_key and the repeated fingerprints (``keys``, a list of lists) of every row that holds one."""
        repeated = self.repeated[0]
        for more in self.repeated[1:]:
            repeated = repeated.union(more)
        repeated = repeated.distinct()
        found = None
        for name in self.runs:
            run = self.spark.table(name)
            once = run.filter("n = 1").join(repeated, "h").select("row_key", F.array("h").alias("keys"))
            decided = run.filter("n = 0").select("row_key", "keys")
            part = once.union(decided)
            found = part if found is None else found.union(part)
        return found.groupBy("row_key").agg(F.collect_list("keys").alias("keys"))

    def drop(self) -> None:
        for name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = []


WINDOWS = "bucket long, kind int, digests binary, places binary"
REPEATED_HERE = np.uint32(1 << 31)
#: Marked windows that a task holds before it deals them by row.
HELD_PLACES = 1 << 20


def send_windows(batches: Iterator[pa.RecordBatch], bucket_bits: int) -> Iterator[pa.RecordBatch]:
    """Packed rows. Kind 0: digests of windows, the row and place of one that holds each, the place's top bit
    set if the block holds more. Kind 1: rows and places of windows that the block has found repeated."""
    shift = np.uint64(64 - bucket_bits)
    for batch in chunks(batches, "text", BLOCK_BYTES):
        ids, data, offsets, starts, ends, row = _rows(batch)
        words = word_hashes(data, starts, ends, SEEDS[0])
        at, grams, least = find_fingerprints(words, row)
        nested = [sum(map(len, x)) for x in batch.column("keys").to_pylist()]
        flat = pc.list_flatten(pc.list_flatten(batch.column("keys"))).to_numpy(zero_copy_only=False)
        wanted = np.unique(mix(flat.astype(np.int64).view(np.uint64)) ^ np.repeat(np.arange(len(ids), dtype=np.uint64), nested))
        own = mix(grams[at]) ^ row[at].astype(np.uint64)
        if not len(wanted) or not len(own):
            continue
        place = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
        at = at[wanted[place] == own]
        order = (grams[at] >> np.uint64(33)).astype(np.int64)
        chosen = np.zeros(len(least), bool)
        for back in range(PLACES):
            ok = (at >= back) & (at - back < len(least))
            w = at[ok] - back
            chosen[w[(least[w] == order[ok]) & (row[w] == row[at[ok]])]] = True
        w = np.flatnonzero(chosen)
        if not len(w):
            continue
        first = run_hashes(words, w, WINDOW, STEP[0])
        second = (run_hashes(word_hashes(data, starts, ends, SEEDS[1]), w, WINDOW, STEP[1]) >> np.uint64(32)).astype(np.uint32)
        first_word = np.searchsorted(starts, offsets[:-1])
        sort = np.lexsort((second, first))
        w, first, second = w[sort], first[sort], second[sort]
        key, where = ids[row[w]].astype(np.int64), (w - first_word[row[w]]).astype(np.uint32)
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(w)))
        flags = np.where(count > 1, REPEATED_HERE, np.uint32(0))
        rows = []
        buckets = first[begin] >> shift
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]])
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            some = begin[x:y]
            by_row = np.lexsort((where[some], key[some]))  # rows and places compress well in this order
            flag, some = flags[x:y][by_row], some[by_row]
            digests = first[some].tobytes() + second[some].tobytes()
            rows.append((int(buckets[x]), 0, digests, _pack_places(key[some], where[some] | flag)))
        decided = np.repeat(count > 1, count)
        if decided.any():
            rows.append((int(first[0] >> shift), 1, b"", _pack_places(key[decided], where[decided])))
        cols = list(zip(*rows))
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in WINDOWS.split(", ")])


def _pack_places(key: np.ndarray, where: np.ndarray) -> bytes:
    return zlib.compress(key.astype(np.int64).tobytes() + where.astype(np.uint32).tobytes(), 1)


def _unpack_places(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob)
    n = len(raw) // 12
    return np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint32, n, 8 * n)


PLACED = "bucket long, places binary"


def _deal_places(key: np.ndarray, where: np.ndarray, bucket_bits: int) -> Iterator[pa.RecordBatch]:
    """Marked windows, packed and dealt by their row."""
    if not len(key):
        return
    buckets = mix(key.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bucket_bits)
    order = np.lexsort((where, key, buckets))
    # equal rows share a key, so each of their windows is sent once
    order = order[np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (where[order][1:] != where[order][:-1])])]
    buckets, key, where = buckets[order], key[order], where[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]])
    rows = [(int(buckets[a]), _pack_places(key[a:b], where[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    cols = list(zip(*rows))
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], names=["bucket", "places"])


def spans_by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_key, spans in words): one row per row with marked windows, runs that overlap or touch joined."""
    for _, rows in runs(batches):
        yield from _spans([_unpack_places(places) for _, places in rows])


def _spans(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    key, where = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((where, key))
    key, where = key[order], where[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (where[1:] > where[:-1] + WINDOW)]))
    start, end = where[first], where[np.append(first[1:], len(key)) - 1] + WINDOW
    cuts = np.append(np.flatnonzero(np.concatenate([[True], key[first][1:] != key[first][:-1]])), len(first))
    spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans)
    yield pa.RecordBatch.from_arrays([pa.array(key[first][cuts[:-1]]), lists], names=["row_key", "spans"])


def repeated_windows(batches: Iterator[pa.RecordBatch], bucket_bits: int) -> Iterator[pa.RecordBatch]:
    """The windows that are met twice or more over all blocks, dealt by row."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _, rows in runs(batches):
        parts = []
        for _, kind, digests, places in rows:
            key, where = _unpack_places(places)
            if kind:
                held.append((key, where))
            else:
                n = len(key)
                parts.append((np.frombuffer(digests, np.uint64, n), np.frombuffer(digests, np.uint32, n, 8 * n), key, where))
        if parts:
            held.append(_met_twice(parts))
        if sum(len(key) for key, _ in held) > HELD_PLACES:
            yield from _deal_places(*map(np.concatenate, zip(*held)), bucket_bits)
            held = []
    if held:
        yield from _deal_places(*map(np.concatenate, zip(*held)), bucket_bits)


def _met_twice(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    first, second, key, where = map(np.concatenate, zip(*parts))
    order = np.lexsort((second, first))
    first, second, key, where = first[order], second[order], key[order], where[order]
    begin = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
    held = where < REPEATED_HERE  # those with the bit set are decided already
    count = np.add.reduceat(np.where(held, 1, 2), begin)
    mark = np.repeat(count > 1, np.diff(np.append(begin, len(first)))) & held
    return key[mark], where[mark]


def _given(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("row_key"))


def repeated_passages(given: DataFrame, n_batches: int = BATCHES) -> DataFrame:
    """row_key and ``spans`` (array of start, end in words) of what must go."""
    spark = given.sparkSession
    fingerprints = durable(given.select("row_key", "text").mapInArrow(send_fingerprints, RUN), "fingerprints")
    index = FingerprintIndex(spark)
    try:
        for batch in range(n_batches):
            index.add_fingerprints(fingerprints.filter(F.pmod("block", F.lit(n_batches)) == batch))
        candidates = durable(index.candidates(), "passage-candidates")
    finally:
        index.drop()
    bits, partitions = bucket_bits(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # all columns of ``given`` stay, so that this join and the caller's use one shuffle of the texts
    windows = given.join(candidates, "row_key").mapInArrow(partial(send_windows, bucket_bits=bits), WINDOWS)
    met = windows.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    marked = met.mapInArrow(partial(repeated_windows, bucket_bits=bits), PLACED)
    dealt = marked.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(spans_by_row, "row_key long, spans array<struct<start:long,end:long>>")


def kept_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, list[bytes]]:
    words = text.split()
    if not spans:
        return len(words), words
    keep = np.ones(len(words), bool)
    for a, b in spans:
        keep[a:b] = False
    return len(words), list(compress(words, keep))


def passage_digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: n_words, n_removed and the digest of the kept words."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                n, kept = kept_words(text.encode(), merged_spans(spans))
                rows.append((doc_id, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*rows)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    given = _given(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    joined = given.join(repeated_passages(given), "row_key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_digests(table(spark, sf_dir, "documents"))
