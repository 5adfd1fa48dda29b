"""Operator 7: packing by vector bin packing.

Examples (token ids, some of them bearing loss) are placed into sequences under three limits at
once: tokens, segments and loss-bearing tokens. The dot-product heuristic picks, among the
examples that fit, the one whose demand vector has the largest dot product with what is left of
the sequence; if none fits whole, an example is cut to fill the rest. A sequence that ends short
is cut into power-of-two sequences, which need no padding.

Packing is local to a partition and looks at a bounded buffer of examples, so nothing is shuffled
and nothing is gathered; a retried task packs the same rows the same way.

``pack_documents`` packs plain text, all of which bears loss. ``pack_examples`` packs instruction data: an example is a list of
segments, some of which bear loss, and a sequence holds at most MAX_LOSS_TOKENS such tokens;
``pack_conversations`` makes an example of every answer and the turn before it.

Defined results: null or empty text is its closing id alone; every row is an example of its own,
also repeated rows and null ids; a closing id bears loss if the segment before it does; of several rows of one turn of
a conversation and role the least text counts; turns that no answer follows are examples without loss; an empty
table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import chunks, table

MAX_TOKENS = 2048
MAX_SEGMENTS = 256
#: Of instruction data; plain text has as many loss-bearing tokens as it has tokens.
MAX_LOSS_TOKENS = 1024
#: Closing id of every document.
END_ID = 1
#: Tokens of waiting examples at which a task starts to fill sequences, and at which it waits again.
BUFFER_TOKENS = 192 * MAX_TOKENS
LOW_TOKENS = 16 * MAX_TOKENS
#: Encoded words that a Python worker remembers.
CACHE_WORDS = 200_000
SPECIAL = "<|endoftext|>"

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "loss_tokens long, ids binary"
)


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordIds(dict):
    """Word -> its ids (little-endian unsigned 32-bit) as encoded behind one space; filled as words are met."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encode(" " + word)
        return ids


class WordCachedTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The byte-level pattern always starts a new piece at a space that is followed by no white space,
    so a text may be cut there and equal words encoded once. Words are encoded from the same
    vocabulary as ranks where that file lies beside the tokenizer's; texts that hold a special token
    are encoded whole by the tokenizer itself.
    """

    _shared: dict[str, WordCachedTokenizer] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = self._ranked(path.removesuffix(".json") + ".tiktoken") or self.whole
        self.words = WordIds(self.plain)
        self.inner_space = re.compile(r" (?=\s|$)")

    @staticmethod
    def _ranked(path: str) -> Callable[[str], bytes] | None:
        if not os.path.exists(path):
            return None
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: array("I", encoding.encode_ordinary(text)).tobytes()

    @classmethod
    def of(cls, path: str) -> WordCachedTokenizer:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return self.whole(text)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        words = text.split(" ")
        if self.inner_space.search(text):
            joined = [words[0]]
            for w in words[1:]:
                if w and not w[0].isspace():
                    joined.append(w)
                else:
                    joined[-1] += " " + w
            words = joined
        ids = list(map(self.words.__getitem__, words[1:]))
        return b"".join([self.plain(words[0]), *ids])


class Packer:
    """Fills sequences from waiting examples; ``emit`` gets the pieces of each finished sequence."""

    def __init__(self, emit: Callable[[list[tuple[int, int, int]]], None], limits=(MAX_TOKENS, MAX_SEGMENTS, MAX_TOKENS)):
        self.emit, self.limits = emit, np.array(limits, np.float64)
        self.max_tokens = int(limits[0])
        #: example -> (length, loss prefix sums or None if every token bears loss)
        self.examples: dict[int, tuple[int, np.ndarray | None]] = {}
        self.refs: list[int] = []  # example, first token left and demand of each waiting part
        self.starts: list[int] = []
        self.demands = np.zeros((0, 3))
        self.waiting = 0

    def loss(self, example: int, start: int, end: int) -> int:
        prefix = self.examples[example][1]
        return end - start if prefix is None else int(prefix[end] - prefix[start])

    def longest(self, example: int, start: int, tokens: int, loss: int) -> int:
        """The longest piece from ``start`` within both limits."""
        length, prefix = self.examples[example]
        end = min(length, start + tokens)
        if prefix is None:
            return min(end - start, loss)
        return min(end, int(np.searchsorted(prefix, prefix[start] + loss, side="right")) - 1) - start

    def add(self, items: list[tuple[int, int, np.ndarray | None]]) -> None:
        """Takes examples (number, length, loss prefix sums); whole sequences are cut off long ones at once."""
        new = []
        for example, length, prefix in items:
            self.examples[example] = (length, prefix)
            start = 0
            while length - start >= self.max_tokens and self.longest(example, start, self.max_tokens, int(self.limits[2])) == self.max_tokens:
                self.emit([(example, start, self.max_tokens)])
                start += self.max_tokens
            while start < length:  # no waiting part needs more than a sequence
                take = self.longest(example, start, self.max_tokens, int(self.limits[2]))
                self.refs.append(example)
                self.starts.append(start)
                new.append((take, 1, self.loss(example, start, start + take)))
                start += take
                self.waiting += take
        if new:
            self.demands = np.concatenate([self.demands, np.array(new, np.float64)])
        if self.waiting >= BUFFER_TOKENS:
            self.fill(LOW_TOKENS)

    def fill(self, until: int) -> None:
        """Fills sequences while more than ``until`` tokens wait."""
        while self.waiting > until:
            self._fill_one()
        alive = np.flatnonzero(self.demands[:, 0] > 0)
        self.refs = [self.refs[k] for k in alive]
        self.starts = [self.starts[k] for k in alive]
        self.demands = self.demands[alive]
        live = set(self.refs)
        self.examples = {k: v for k, v in self.examples.items() if k in live}

    def _fill_one(self) -> None:
        room, pieces, demands = self.limits.copy(), [], self.demands
        while room[0] > 0 and room[1] > 0:
            waiting = demands[:, 0] > 0
            fits = waiting & (demands <= room).all(axis=1)
            score = (demands / self.limits) @ (room / self.limits)
            if fits.any():
                k = int(np.where(fits, score, -1.0).argmax())
                take = int(demands[k, 0])
            elif waiting.any():
                k = int(np.where(waiting, score, -1.0).argmax())
                take = self.longest(self.refs[k], self.starts[k], int(room[0]), int(room[2]))
                if take <= 0:
                    break
            else:
                break
            example, start = self.refs[k], self.starts[k]
            used = self.loss(example, start, start + take)
            pieces.append((example, start, take))
            room -= (take, 1, used)
            self.starts[k] += take
            left = demands[k, 0] - take
            demands[k] = (left, 1 if left else 0, demands[k, 2] - used)
            self.waiting -= take
        self._close(pieces)

    def _close(self, pieces: list[tuple[int, int, int]]) -> None:
        """A full sequence as it is, a shorter one as power-of-two sequences."""
        left = sum(p[2] for p in pieces)
        if left == self.max_tokens:
            self.emit(pieces)
            return
        pieces = pieces[::-1]
        while left:
            room = size = 1 << (left.bit_length() - 1)
            out = []
            while room:
                example, start, length = pieces.pop()
                take = min(room, length)
                out.append((example, start, take))
                if take < length:
                    pieces.append((example, start + take, length - take))
                room -= take
            self.emit(out)
            left -= size


def _packed(examples: DataFrame, names: list[str], schema: str, encode_row: Callable, path: str, keep_ids: bool, limits: tuple) -> DataFrame:
    """Packs the rows of ``examples``; ``names`` are the columns that name an example, ``encode_row`` gives ids and loss prefix sums."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordCachedTokenizer.of(path).encode
        rows: list[tuple] = []
        ids_of: dict[int, tuple[tuple, np.ndarray]] = {}
        task = TaskContext.get()
        next_sequence = (task.partitionId() if task else 0) << 40

        def emit(pieces: list[tuple[int, int, int]]) -> None:
            nonlocal next_sequence
            offset = 0
            for example, start, length in pieces:
                name, ids = ids_of[example]
                part = ids[start : start + length].tobytes()
                loss = packer.loss(example, start, start + length)
                rows.append((*name, start, length, zlib.crc32(part), len(ids), next_sequence, offset, loss, part if keep_ids else None))
                offset += length
            next_sequence += 1

        def flush() -> pa.RecordBatch:
            fields = [x.split()[0] for x in schema.split(", ")]
            columns = list(zip(*rows)) or [()] * len(fields)
            arrays = [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(fields, columns)]
            rows.clear()
            for k in ids_of.keys() - packer.examples.keys():
                del ids_of[k]
            return pa.RecordBatch.from_arrays(arrays, names=fields)

        packer, example = Packer(emit, limits), 0
        for batch in chunks(batches, "text"):
            items = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                ids, prefix = encode_row(encode, *row[len(names) :])
                ids_of[example] = (row[: len(names)], ids)
                items.append((example, len(ids), prefix))
                example += 1
            packer.add(items)
            yield flush()
        packer.fill(0)
        yield flush()

    return examples.mapInArrow(pack, schema)


CLOSING = np.array([END_ID], "<u4").tobytes()


def _encode_text(encode: Callable[[str], bytes], text: str) -> tuple[np.ndarray, None]:
    return np.frombuffer(encode(text) + CLOSING, "<u4"), None


def _encode_segments(encode: Callable[[str], bytes], text: str, segments: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Segments are encoded one by one; ``text`` is only there to bound batches."""
    blobs, bears = [], []
    for segment in segments or [{"text": "", "loss": True}]:
        blob = encode(segment["text"] or "")
        blobs.append(blob)
        bears.append(np.full(len(blob) // 4, bool(segment["loss"])))
    bears.append(np.array([bool(segments[-1]["loss"]) if segments else True]))
    return np.frombuffer(b"".join([*blobs, CLOSING]), "<u4"), np.concatenate([[0], np.cumsum(np.concatenate(bears))])


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Per piece of the rows of ``docs``: its place in its document and in its sequence (every token bears loss)."""
    given = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    limits = (MAX_TOKENS, MAX_SEGMENTS, MAX_TOKENS)
    return _packed(given, ["doc_id"], PIECE_SCHEMA, _encode_text, tokenizer_path or default_tokenizer_path(), keep_ids, limits)


def pack_examples(
    examples: DataFrame, names: list[str], tokenizer_path: str | None = None, keep_ids: bool = True, limits=(MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS_TOKENS)
) -> DataFrame:
    """Per piece of ``examples`` (long columns ``names``, and ``segments``, an array of text and loss) the same as
    ``pack_documents``, with ``names`` in place of doc_id."""
    text = F.array_join(F.transform("segments", lambda s: F.coalesce(s["text"], F.lit(""))), "")
    given = examples.select(*(F.col(n).cast("long") for n in names), F.coalesce(text, F.lit("")).alias("text"), "segments")
    schema = PIECE_SCHEMA.replace("doc_id long", ", ".join(f"{n} long" for n in names))
    return _packed(given, names, schema, _encode_segments, tokenizer_path or default_tokenizer_path(), keep_ids, limits)


def instruction_examples(conversations: DataFrame, answering: str = "assistant") -> DataFrame:
    """conv_id, turn and segments of an example for each answer: the turn before it, and the answer, which bears loss.

    Turns are met by (conversation, turn), so a long conversation is spread over tasks.
    """
    is_answer = F.coalesce(F.col("role") == answering, F.lit(False))
    given = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), is_answer.alias("answer"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at = F.when(F.col("answer"), F.col("turn")).otherwise(F.col("turn") + 1)
    sides = given.groupBy("conv_id", at.alias("turn")).agg(
        F.min(F.when(~F.col("answer"), F.col("text"))).alias("prompt"), F.min(F.when(F.col("answer"), F.col("text"))).alias("reply")
    )

    def segment(name: str, loss: bool):
        return F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("text"), F.lit(loss).alias("loss")))

    return sides.select("conv_id", "turn", F.array_compact(F.array(segment("prompt", False), segment("reply", True))).alias("segments"))


def pack_conversations(conversations: DataFrame, tokenizer_path: str | None = None, limits=(MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS_TOKENS)) -> DataFrame:
    return pack_examples(instruction_examples(conversations), ["conv_id", "turn"], tokenizer_path, limits=limits)


def op7_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids", "loss_tokens")
