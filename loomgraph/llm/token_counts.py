"""Operator 13: token counts by a map-side two-tier lookup.

A text is cut into pre-tokens, and its number of tokens is the sum of theirs. For a BPE model of the
sentencepiece library a cut is safe where no piece of the vocabulary reaches across: before a blank that
follows something else (no piece has a blank after another character) and before a line feed (no piece holds
one). ``PieceModel`` checks that of the model it loads, and that the model changes no characters; others are refused.

First tier: a hash table of the numbers of tokens of the frequent pre-tokens, which every task gets by broadcast. A
pre-token of up to 15 bytes is its own 128-bit key, so the table cannot err. Second tier: pre-tokens that the
table misses are encoded by the library once, and remembered by the Python worker across its tasks. No pre-token is
ever shuffled. To find the frequent ones, every task keeps a summary of at most SUMMARY counters
over all its texts (the counters that fall out are subtracted, so what stays is certain to be frequent), and summaries are
merged, a few at a time, until the driver can take the last ones. The table has TABLE entries at most;
which pre-tokens it holds changes the speed only, never a count.

Defined results: null or empty text has no bytes and no tokens; rows are independent, so repeated rows repeat; other
columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import chunks, table, text_buffer
from loomgraph.llm.passages import STEP, mix
from loomgraph.session import durable

MAX_TOKENS = 4096
#: Bytes of texts cut into pre-tokens at once; longer texts are taken in parts.
PART_BYTES = 2 << 20
#: Bytes of a pre-token that fit its key, beside its length.
KEY_BYTES = 15
#: Counters of a task's summary, and entries of the broadcast table.
SUMMARY = 1 << 14
TABLE = 1 << 16
#: Summaries that the driver takes; more are merged in tasks, MERGED_AT_ONCE to a task.
TO_DRIVER = 64
MERGED_AT_ONCE = 32
#: Pre-tokens that a worker remembers (twice as many at most), and the longest of them.
CACHE = 1 << 18
CACHED_BYTES = 64
BLANK, LINE_FEED = 0x20, 0x0A
#: The character that stands for a blank inside the model.
MARK = "▁"


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Numbers of tokens of pre-tokens, with what this worker has encoded before."""

    _shared: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(self.encoder.serialized_model_proto())
        normal, pieces = proto.normalizer_spec, [p for p in proto.pieces if p.type in (1, 4, 5)]
        unchanged = not normal.precompiled_charsmap and normal.add_dummy_prefix and not normal.remove_extra_whitespaces
        inside = any("\n" in p.piece or MARK in p.piece.lstrip(MARK) for p in pieces)
        if proto.trainer_spec.model_type != 2 or proto.trainer_spec.treat_whitespace_as_suffix or not unchanged or inside or any(p.type == 4 for p in pieces):
            raise ValueError(f"{path}: tokens of this model are not a sum over pre-tokens")
        self.lone_blank = len(self.encoder.encode("a ")) - len(self.encoder.encode("a"))
        self.new: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    @classmethod
    def of(cls, path: str) -> PieceModel:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def encode_lengths(self, pre_tokens: list[bytes]) -> list[int]:
        """The library puts a blank before what it encodes: a pre-token's own first blank is left out, and the blank before a line feed is a token of its own."""
        texts = [p.decode() for p in pre_tokens]
        found = self.encoder.encode([t if t[0] == "\n" else t[1:] for t in texts], num_threads=1)
        return [len(ids) - self.lone_blank if t[0] == "\n" else len(ids) if len(t) > 1 else self.lone_blank for t, ids in zip(texts, found)]

    def lengths(self, pre_tokens: list[bytes]) -> list[int]:
        known = {**dict.fromkeys(pre_tokens)}
        unknown = []
        for p in known:
            n = self.new.get(p)
            if n is None:
                n = self.old.get(p)
                if n is None:
                    unknown.append(p)
                    continue
                self.new[p] = n
            known[p] = n
        for p, n in zip(unknown, self.encode_lengths(unknown) if unknown else ()):
            known[p] = n
            if len(p) <= CACHED_BYTES:
                self.new[p] = n
        if len(self.new) > CACHE:
            self.new, self.old = {}, self.new
        return [known[p] for p in pre_tokens]


def parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts of a column, each behind one blank and end to end, in parts of about PART_BYTES, with the
    pre-tokens' starts in each and the row of each; long texts are cut between pre-tokens."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    data, offsets = text_buffer(spaced)
    first = 0
    while first < len(data):
        last = min(first + PART_BYTES, len(data))
        while last < len(data):  # on to the next blank or line feed where a cut is safe
            ahead = data[last - 1 : last + PART_BYTES]
            safe = np.flatnonzero((ahead[1:] == LINE_FEED) | ((ahead[1:] == BLANK) & (ahead[:-1] < 0x80) & (ahead[:-1] != BLANK)))
            if len(safe):
                last += int(safe[0])
                break
            last = min(last + PART_BYTES, len(data))
        part = data[first:last]
        blank = part == BLANK
        ends = blank.copy()  # places where a blank character ends
        marks = np.flatnonzero(part == 0xE2)
        marks = marks[marks + 2 < len(part)]
        marks = marks[(part[marks + 1] == 0x96) & (part[marks + 2] == 0x81)]
        blank[marks] = True
        ends[marks + 2] = True
        start = blank
        start[1:] &= ~ends[:-1]
        start |= part == LINE_FEED
        start[0] = True
        # a row's first blank starts a pre-token also after a row that ends in one
        start[offsets[(offsets >= first) & (offsets < last)] - first] = True
        at = np.flatnonzero(start)
        yield part, at, np.searchsorted(offsets, at + first, side="right") - 1
        first = last


def keys_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit keys of pre-tokens of up to KEY_BYTES bytes: the bytes, and the length in the last one."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    two = padded[:-1].astype(np.uint16) | padded[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    eight = four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)
    every = np.uint64(0xFFFFFFFFFFFFFFFF)

    def half(at: int) -> np.ndarray:
        unused = np.uint64(64) - np.uint64(8) * np.clip(sizes - at, 0, 8).astype(np.uint64)
        mask = np.where(unused < 64, every >> np.minimum(unused, np.uint64(63)), np.uint64(0))
        return eight[starts + at] & mask

    return half(0), half(8) | sizes.astype(np.uint64) << np.uint64(56)


def key_bytes(low: np.ndarray, high: np.ndarray) -> list[bytes]:
    raw = np.stack([low, high], axis=1).astype("<u8").tobytes()
    return [raw[k : k + raw[k + KEY_BYTES]] for k in range(0, len(raw), 16)]


class Counters:
    """The heaviest pre-tokens, ``size`` at most: what falls out takes its count from all that stay."""

    def __init__(self, size: int):
        self.size = size
        self.low = self.high = np.zeros(0, np.uint64)
        self.count = np.zeros(0, np.int64)

    def add(self, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> None:
        low, high = np.concatenate([self.low, low]), np.concatenate([self.high, high])
        count = np.concatenate([self.count, count])
        order = np.lexsort((low, high))
        low, high, count = low[order], high[order], count[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        first = np.flatnonzero(new)
        low, high, count = low[first], high[first], np.add.reduceat(count, first) if len(first) else count
        if len(count) > self.size:
            count = count - np.partition(count, len(count) - self.size - 1)[len(count) - self.size - 1]
            kept = count > 0
            low, high, count = low[kept], high[kept], count[kept]
        self.low, self.high, self.count = low, high, count

    def packed(self) -> bytes:
        return np.concatenate([self.low, self.high, self.count.astype(np.uint64)]).tobytes()

    def add_packed(self, raw: bytes) -> None:
        low, high, count = np.frombuffer(raw, np.uint64).reshape(3, -1)
        self.add(low, high, count.astype(np.int64))


def summarise(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A task's summary of its pre-tokens."""
    counters = Counters(size)
    for batch in chunks(batches, "text"):
        for data, starts, _ in parts(batch.column("text")):
            sizes = np.diff(np.append(starts, len(data)))
            short = sizes <= KEY_BYTES
            low, high = keys_of(data, starts[short], sizes[short])
            counters.add(low, high, np.ones(len(low), np.int64))
    if len(counters.count):
        yield pa.RecordBatch.from_arrays([pa.array([counters.packed()], pa.binary())], names=["summary"])


def merge_summaries(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    counters = Counters(size)
    for batch in batches:
        for raw in batch.column("summary"):
            counters.add_packed(raw.as_py())
    if len(counters.count):
        yield pa.RecordBatch.from_arrays([pa.array([counters.packed()], pa.binary())], names=["summary"])


def frequent_pre_tokens(docs: DataFrame, size: int = TABLE) -> list[bytes]:
    """The ``size`` heaviest pre-tokens of all texts, as far as the summaries can tell."""
    summaries = durable(docs.select(F.col("text").cast("string")).mapInArrow(partial(summarise, size=SUMMARY), "summary binary"), "pre-tokens")
    n = summaries.count()
    while n > TO_DRIVER:
        n = -(-n // MERGED_AT_ONCE)
        merged = summaries.repartition(n).mapInArrow(partial(merge_summaries, size=size), "summary binary")
        summaries = durable(merged, "pre-tokens")
    counters = Counters(size)
    for row in summaries.collect():
        counters.add_packed(bytes(row.summary))
    return key_bytes(counters.low, counters.high)


class LengthTable:
    """Open addressing over 128-bit keys; an empty place has length 0, which no pre-token has."""

    def __init__(self, low: np.ndarray, high: np.ndarray, lengths: np.ndarray):
        bits = max(4, (2 * len(low)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.length = np.zeros(1 << bits, np.uint8)
        waiting = np.flatnonzero((lengths > 0) & (lengths < 256))
        place = self._place(low, high)
        while len(waiting):
            at, who = np.unique(place[waiting], return_index=True)
            free = self.length[at] == 0
            at, who = at[free], waiting[who[free]]
            self.low[at], self.high[at], self.length[at] = low[who], high[who], lengths[who]
            waiting = np.setdiff1d(waiting, who, assume_unique=True)
            place[waiting] = (place[waiting] + np.uint64(1)) & self.mask

    def _place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix(low * STEP[0] + high) & self.mask

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The length of each key, 0 for one that is not here."""
        out = np.zeros(len(low), np.int64)
        rows = np.arange(len(low))
        place = self._place(low, high)
        while len(rows):
            at = place[rows]
            hit = (self.low[at] == low[rows]) & (self.high[at] == high[rows])
            out[rows[hit]] = self.length[at[hit]]
            rows = rows[~hit & (self.length[at] > 0)]
            place[rows] = (place[rows] + np.uint64(1)) & self.mask
        return out


def length_table(pre_tokens: list[bytes], path: str) -> LengthTable:
    lengths = np.array(PieceModel.of(path).encode_lengths(pre_tokens) if pre_tokens else [], np.int64)
    data = np.frombuffer(b"".join(pre_tokens), np.uint8)
    sizes = np.array([len(p) for p in pre_tokens], np.int64)
    return LengthTable(*keys_of(data, np.cumsum(sizes) - sizes, sizes), lengths)


def token_counts(column: pa.Array, lengths: LengthTable, model: PieceModel) -> np.ndarray:
    """The number of tokens of every text of a column."""
    total = np.zeros(len(column), np.int64)
    for data, starts, row in parts(column):
        sizes = np.diff(np.append(starts, len(data)))
        n = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(sizes <= KEY_BYTES)
        n[short] = lengths.find(*keys_of(data, starts[short], sizes[short]))
        missed = np.flatnonzero(n == 0)
        raw = data.tobytes()
        ends = starts[missed] + sizes[missed]
        n[missed] = model.lengths([raw[a:b] for a, b in zip(starts[missed].tolist(), ends.tolist())])
        total += np.bincount(row, weights=n, minlength=len(column)).astype(np.int64)
    return total


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = MAX_TOKENS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit."""
    path = path or default_model_path()
    found = docs.sparkSession.sparkContext.broadcast(length_table(frequent_pre_tokens(docs), path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(path)
        for batch in chunks(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            sizes = pc.binary_length(texts).cast(pa.int64())
            n = np.where(sizes.to_numpy(zero_copy_only=False) > 0, token_counts(texts, found.value, model), 0)
            columns = [batch.column("doc_id"), sizes, pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
