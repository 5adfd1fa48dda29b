"""Helpers shared by the text operators: table access and Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of bytes or characters outside these (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes handled at once inside a task; one longer text is handled alone.
CHUNK_BYTES = 4 << 20


#: Rows of a batch that goes to a Python worker: documents may be long, and a batch is held whole.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Session settings of jobs over whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_bits(spark: SparkSession) -> int:
    """Bits of the buckets that packed rows are dealt into: some for each shuffle partition, few enough that a
    block's row still holds several entries."""
    return max(8, min(18, (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length()))


def boxed(docs: DataFrame, **added: Column) -> DataFrame:
    """``docs`` with each row as one struct column ``row``, so that its columns meet no other names."""
    return docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row")).withColumns(added)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unboxed(rows: DataFrame, docs: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of ``docs`` back from ``row``; where column ``text`` is given and not null it is the new text, and
    n_chars, if there is one, follows."""
    if text is None:
        return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
    changed = F.col(text).isNotNull()

    def column(name: str) -> Column:
        old = F.col("row").getField(name)
        if name == "text":
            return F.coalesce(F.col(text), old.cast("string"))
        if name == "n_chars":
            return F.when(changed, F.length(text).cast(docs.schema[name].dataType)).otherwise(old)
        return old

    return rows.select(*(column(c).alias(c) for c in docs.columns))


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds at most ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        first, base = 0, 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(first, last - first)
            first, base = last, int(ends[last - 1])


def blocks(batches: Iterator[pa.RecordBatch], limit: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Record batches cut and joined so that column text holds about ``limit`` bytes in each, of ``rows`` rows at most."""
    held, size, count = [], 0, 0
    for batch in chunks(batches, "text", limit):
        for first in range(0, batch.num_rows, rows):
            part = batch.slice(first, rows)
            n_bytes = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and (size + n_bytes > limit or count + part.num_rows > rows):
                yield pa.concat_batches(held)
                held, size, count = [], 0, 0
            held.append(part)
            size, count = size + n_bytes, count + part.num_rows
    if held:
        yield pa.concat_batches(held)


def slices(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of the runs in a sorted array."""
    if len(values):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(values[a]), a, b


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """The rows of a sorted input, grouped by their first column; one group is held at a time."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                yield from zip(*(c.to_pylist() for c in batch.slice(first, 64).columns))

    for key, group in groupby(rows(), key=lambda row: row[0]):
        yield key, list(group)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_of(column: pa.Array) -> list[bytes]:
    """Every row's UTF-8 bytes; nulls are empty."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()
