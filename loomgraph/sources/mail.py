"""Mailboxes read in parts: a batch reader by byte ranges, and a stream of a mailbox that grows.

A message begins at a line that opens with ``From `` at the start of the file or after a line feed. The batch reader gives Spark's
text source that border as the line separator, so files are split by byte ranges, a message that crosses a border belongs to
the range it begins in, and only Spark opens files. The stream reader's offset is a byte position per file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomgraph.sources.formats import MESSAGE_SCHEMA, parse_message

BORDER = b"\nFrom "
#: Bytes that the stream reader's partitions hold.
PART_BYTES = 64 << 20
_TYPES = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]


def message_row(path: str, raw: bytes) -> tuple:
    """A row of MESSAGE_SCHEMA from a message behind its ``From `` line."""
    body = raw.split(b"\n", 1)[1] if b"\n" in raw else b""
    return (path, *(str(x) if x is not None and not isinstance(x, list) else x for x in parse_message(body.replace(b"\n>From ", BORDER))))


def read_mailboxes(spark: SparkSession, path: str) -> DataFrame:
    """The messages of all mbox files below a folder. Text before a file's first message is left out; an empty file has none."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", BORDER.decode())
    records = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("content"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MESSAGE_SCHEMA.split(", ")]
        last = None
        for batch in batches:
            rows = []
            for where, start, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                opens_file, last = start == 0 and (where, start) != last, (where, start)
                if opens_file and not content.startswith(BORDER[1:]):
                    continue
                rows.append(message_row(where, content))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=names)

    return records.mapInArrow(parse, MESSAGE_SCHEMA)


def borders(path: str, first: int, last: int, chunk: int = 1 << 20) -> Iterator[int]:
    """Places in [first, last) where a message begins."""
    with open(path, "rb") as f:
        if first == 0 and f.read(5) == BORDER[1:] and last > 0:
            yield 0
        at = max(0, first - 1)
        f.seek(at)
        held = b""
        while True:
            more = f.read(chunk)
            if not more:
                return
            held += more
            found = held.find(BORDER)
            while found >= 0:
                place = at + found + 1
                if place >= last:
                    return
                yield place
                found = held.find(BORDER, found + 1)
            keep = min(len(held), len(BORDER) - 1)
            at += len(held) - keep
            held = held[len(held) - keep :]


def settled_size(path: str) -> int:
    """The size up to which messages are whole: all of it if the file ends with an empty line, else up to its last message's beginning."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        f.seek(max(0, size - 2))
        if f.read() == b"\n\n" or size == 0:
            return size
        step, end = 1 << 20, size
        while end > 0:
            start = max(0, end - step)
            f.seek(start)
            found = f.read(end - start + len(BORDER) - 1).rfind(BORDER)
            if found >= 0:
                return start + found + 1
            end = start
    return 0


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    last: int

    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class _MailboxStream(DataSourceStreamReader):
    def __init__(self, folder: str, part_bytes: int):
        self.folder, self.part_bytes = folder, part_bytes

    def _files(self) -> list[str]:
        return sorted(os.path.join(d, n) for d, _, names in os.walk(self.folder) for n in names if n.endswith(".mbox"))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: settled_size(path) for path in self._files()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for path, last in end.items():
            for first in range(start.get(path, 0), last, self.part_bytes):
                out.append(_Range(path, first, min(first + self.part_bytes, last)))
        return out

    def read(self, part: _Range) -> Iterator[tuple]:
        """Messages that begin in the range; the last one may end behind it."""
        with open(part.path, "rb") as f:
            for place in borders(part.path, part.first, part.last):
                following = next((b for b in borders(part.path, place + 1, 1 << 62)), None)
                f.seek(place)
                raw = f.read((following - place - 1) if following is not None else -1)
                yield message_row(part.path, raw)


class MailboxSource(DataSource):
    """``spark.readStream.format("mailbox").option("path", folder)``: messages of the folder's .mbox files as they grow. The folder is one
    that the driver and all executors share. Option ``partBytes``: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return MESSAGE_SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _MailboxStream(self.options["path"], int(self.options.get("partBytes", PART_BYTES)))
