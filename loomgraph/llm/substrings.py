"""Operator 6: exact substring deduplication by suffix sorting with bucket pointers.

A byte goes if a 50-byte string covering it also starts in a document with a smaller id. Sorting
every suffix of the corpus is not needed for that, only those that can share 50 bytes:

1. Anchors. Of the 16-byte grams in each 50-byte window the one(s) of least hash are anchors, so equal
   windows have equal anchors at equal offsets. Tasks send hashes of anchors, packed by block of rows, to
   find those in two or more rows; a gram that repeats within a block is sent once.
2. Buckets. Rows with a shared anchor bring the bytes around it (at most 84), dealt by anchor. Their suffixes
   start in q-gram buckets (8 bytes) and are refined as in bucket-pointer refinement: those of one bucket
   are sorted by the bucket identifier of the suffix q bytes on, which gives buckets of 2q bytes, and these
   identifiers are used again for the next round (8, 16, 32, then 50 bytes by two overlapping ones). A suffix
   alone in its bucket takes no further part. The least document of a 50-byte bucket owns it; nothing is
   compared by hash alone.
3. Cutting. Windows owned by smaller documents come back as byte spans and are cut from the text.

A passage shared by a third of all rows is handled by blocks: equal contexts within a block are decided
there and sent once. An anchor in more than MIN_HOT rows, whose contexts may all differ, is sent
window by window under the window's own hash, so its bucket splits. The list of such anchors is bounded
by HOT_KEYS: the threshold rises with the number of all anchors; the results are the same either way.

A task sorts what it gets by bucket (or block) and holds one of them at a time; buckets grow in number
with the shuffle partitions, so a task's memory does not follow the size of its partition.

Defined results: null or empty text has no bytes and is kept; rows without an id own nothing and lose
nothing; rows with equal ids are not smaller than each other and each loses only what it holds itself; repeated
rows lose the same; other columns pass through whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import blocks, boxed, bucket_bits, chunks, runs, slices, table, text_buffer, texts_of, unboxed
from loomgraph.session import durable

WINDOW = 50
GRAM = 16
#: Places of a gram within a window.
PLACES = WINDOW - GRAM + 1
#: First length of refined buckets, and the later offset whose bucket refines each round.
Q_GRAM = 8
STEPS = (8, 16, WINDOW - 32)
#: Text bytes whose anchors are sent together, and rows of a block at most (their number fits 16 bits).
BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 1 << 16
CONTEXT_BLOCK_BYTES = 4 << 20
#: An anchor in more rows than this may be hot; at most HOT_KEYS anchors are.
MIN_HOT = 50_000
HOT_KEYS = 1 << 17
#: Context bytes refined together (more only where one anchor has more).
REFINE_BYTES = 1 << 18
KEY_MASK = np.uint64((1 << 48) - 1)

PACKED = "bucket long, block long, counts binary, keys binary, places binary, rows binary"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes that start at each place."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint16) | data[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    eight = four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)
    return _mix_grams(eight[:-8], eight[8:])


def _mix_grams(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    mixed = low * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= (high + (mixed >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values."""
    pick, span, out = np.minimum if least else np.maximum, 1, values
    while 2 * span <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def find_anchors(data: np.ndarray, part: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors, their keys, and for every place the least order of the window there.

    A gram's order is the high half of its hash, which is small for anchors; so their keys have the halves changed over,
    and buckets taken from the first bits of the keys are of one size.
    Long buffers are worked through in overlapping parts that stay in the processor's cache.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    places, hashes, least = [], [], []
    for first in range(0, n - WINDOW + 1, part):
        # windows first .. first + part - 1, with the windows before them that share their grams
        begin = max(0, first - PLACES + 1)
        piece = data[begin : min(n, first + part + WINDOW - 1 + PLACES)]
        h = gram_hashes(piece)
        order = (h >> np.uint64(32)).astype(np.uint32)
        minimum = sliding(order, PLACES, True)
        least.append(minimum[first - begin : first - begin + min(part, n - WINDOW + 1 - first)])
        best = sliding(np.pad(minimum, PLACES - 1), PLACES, False)  # greatest minimum of the windows over a gram
        here = np.flatnonzero(best == order)
        last = n if first + part > n - WINDOW else first + part
        here = here[(here + begin >= first) & (here + begin < last)]
        places.append(here + begin)
        hashes.append(h[here] << np.uint64(32) | h[here] >> np.uint64(32))
    return np.concatenate(places), np.concatenate(hashes), np.concatenate(least)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "binary": pa.binary(), "list": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t.replace("array<long>", "list")]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _pack_keys(keys: np.ndarray) -> bytes:
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (keys >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpack_keys(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return np.frombuffer(blob, np.uint32, n).astype(np.uint64) | np.frombuffer(blob, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)


def send_anchors(batches: Iterator[pa.RecordBatch], bucket_bits: int) -> Iterator[pa.RecordBatch]:
    """Packed rows by bucket of the anchors. With ``places``: anchors of one row of the block each; with ``counts``: anchors of
    several rows of the block. One more row per block has its row keys and the (row, anchor) pairs decided in it."""
    shift = np.uint64(64 - bucket_bits)
    for batch in blocks(batches, BLOCK_BYTES, BLOCK_ROWS):
        known = pc.is_valid(batch.column("doc_id")).to_numpy(zero_copy_only=False)
        row_keys = batch.column("row_key").to_numpy()
        data, offsets = text_buffer(batch.column("text"))
        at, keys, _ = find_anchors(data)
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = (at + GRAM <= offsets[doc + 1]) & known[doc] & (offsets[doc + 1] - offsets[doc] >= WINDOW)
        doc, keys = doc[inside], keys[inside]
        order = np.argsort(keys, kind="stable")  # rows stay in order within a key
        doc, keys = doc[order].astype(np.uint16), keys[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        doc, keys = doc[fresh], keys[fresh]
        if not len(keys):
            continue
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(first, len(keys)))
        # the same rows in the same order make the same block, also in a task that is run again
        block = xxhash.xxh64_intdigest(row_keys.tobytes()) - (1 << 63)
        rows: list[tuple] = []
        once, more = first[count == 1], first[count > 1]
        for bucket, a, b in slices(keys[once] >> shift):
            rows.append((bucket, block, None, _pack_keys(keys[once[a:b]] & KEY_MASK), doc[once[a:b]].tobytes(), None))
        counts = count[count > 1].astype(np.uint32)
        for bucket, a, b in slices(keys[more] >> shift):
            rows.append((bucket, block, counts[a:b].tobytes(), _pack_keys(keys[more[a:b]] & KEY_MASK), None, None))
        decided = np.repeat(count > 1, count)
        rows.append((int(keys[0] >> shift), block, None, _pack_keys(keys[decided] & KEY_MASK), doc[decided].tobytes(), row_keys.tobytes()))
        yield _batch(PACKED, rows)


FOUND = "block long, places binary, keys binary, rows binary, total long"


def shared_anchors(batches: Iterator[pa.RecordBatch], min_hot: int) -> Iterator[pa.RecordBatch]:
    """By block, the (row, anchor) pairs whose anchor is found in two or more rows; the row without a block has the
    anchors of over ``min_hot`` rows, their numbers of rows, and the number of all anchors seen."""
    hot_keys, hot_counts, total = [], [], 0
    for _, rows in runs(batches):
        out = [(block, places, keys, table, None) for _, block, _, keys, places, table in rows if table is not None]
        rows = [r for r in rows if r[5] is None]
        if rows:
            lengths = [len(r[3]) // 6 for r in rows]
            key = np.concatenate([_unpack_keys(r[3]) for r in rows])
            source = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
            place = np.concatenate([np.frombuffer(r[4], np.uint16) if r[2] is None else np.zeros(n, np.uint16) for r, n in zip(rows, lengths)])
            count = np.concatenate([np.ones(n, np.int64) if r[2] is None else np.frombuffer(r[2], np.uint32).astype(np.int64) for r, n in zip(rows, lengths)])
            order = np.argsort(key, kind="stable")
            key, source, place, count = key[order], source[order], place[order], count[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            summed = np.add.reduceat(count, first)
            total += int(summed.sum())
            hot = summed > min_hot
            hot_keys.append(key[first][hot])
            hot_counts.append(summed[hot])
            several = np.repeat(summed > 1, np.diff(np.append(first, len(key)))) & (count == 1)
            key, source, place = key[several], source[several], place[several]
            order = np.argsort(source, kind="stable")
            key, source, place = key[order], source[order], place[order]
            out += [(rows[k][1], place[a:b].tobytes(), _pack_keys(key[a:b]), None, None) for k, a, b in slices(source)]
        if out:
            yield _batch(FOUND, out)
    hot = np.concatenate([np.zeros(0, np.uint64), *hot_keys])
    yield _batch(FOUND, [(None, b"", _pack_keys(hot), np.concatenate([np.zeros(0, np.int64), *hot_counts]).tobytes(), total)])


LISTS = "row_key long, keys array<long>, hot array<long>, total long"


def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_key, keys): the shared anchors of the rows of each block; the summary passes through."""
    for block, rows in runs(batches):
        if block is None:
            yield _batch(LISTS, [(None, _unpack_keys(k).astype(np.int64).tolist(), np.frombuffer(c, np.int64).tolist(), n) for _, _, k, c, n in rows])
            continue
        row_keys = np.frombuffer(next(r[3] for r in rows if r[3] is not None), np.int64)
        pairs = np.unique(np.concatenate([np.frombuffer(p, np.uint16).astype(np.uint64) << np.uint64(48) | _unpack_keys(k) for _, p, k, _, _ in rows]))
        place, key = (pairs >> np.uint64(48)).astype(np.int64), (pairs & KEY_MASK).astype(np.int64)
        cuts = np.concatenate([np.flatnonzero(np.diff(place, prepend=-1)), [len(place)]]) if len(place) else np.zeros(1, np.int64)
        n = len(cuts) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(row_keys[place[cuts[:-1]]]), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(key)), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())],
            names=["row_key", "keys", "hot", "total"],
        )


CONTEXTS = "bucket long, n long, packed binary"
#: Numbers of a packed context besides its text: document, row, start in the text, length, place of the anchor.
CONTEXT_FIELDS = (np.int64, np.int64, np.uint32, np.uint8, np.uint8)
SPANS = "row_key long, doc_id long, start long, end long"


def _pack_contexts(rows: list[tuple]) -> bytes:
    columns = list(zip(*rows))
    return zlib.compress(b"".join([*(np.array(c, t).tobytes() for c, t in zip(columns, CONTEXT_FIELDS)), *columns[-1]]), 1)


def _unpack_contexts(n: int, packed: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    raw, at, fields = zlib.decompress(packed), 0, []
    for kind in CONTEXT_FIELDS:
        fields.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return fields, np.frombuffer(raw, np.uint8, offset=at)


def send_contexts(batches: Iterator[pa.RecordBatch], hot_keys, bucket_bits: int) -> Iterator[pa.RecordBatch]:
    """The windows of each shared anchor as one run of bytes, packed by bucket of the anchor (of the window, if
    the anchor is hot); rows with a negative number are spans already decided."""
    hot = hot_keys.value
    for part in blocks(batches, CONTEXT_BLOCK_BYTES, BLOCK_ROWS):
        ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        row_keys = part.column("row_key").to_numpy()
        data, offsets = text_buffer(part.column("text"))
        wanted_keys = pc.list_flatten(part.column("keys")).to_numpy(zero_copy_only=False).astype(np.uint64)
        held = pc.list_value_length(part.column("keys")).to_numpy(zero_copy_only=False)
        wanted = np.sort(np.repeat(np.arange(len(ids), dtype=np.uint64), held) << np.uint64(48) | wanted_keys)
        at, keys, least = find_anchors(data)
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + GRAM <= offsets[doc + 1]
        at, keys, doc = at[inside], keys[inside], doc[inside]
        own = doc.astype(np.uint64) << np.uint64(48) | (keys & KEY_MASK)
        place = np.searchsorted(wanted, own)
        ok = (place < len(wanted)) & (wanted[np.minimum(place, len(wanted) - 1)] == own) if len(wanted) else np.zeros(len(own), bool)
        at, keys, doc = at[ok], keys[ok], doc[ok]
        order = keys.astype(np.uint32)
        low = np.full(len(at), -1)
        high = np.full(len(at), -2)
        for back in range(PLACES):
            start = at - back
            valid = (start >= offsets[doc]) & (start + WINDOW <= offsets[doc + 1])
            valid[valid] = least[start[valid]] == order[valid]
            low[valid] = start[valid]
            high[valid & (high < 0)] = start[valid & (high < 0)]
        buckets = (keys >> np.uint64(64 - bucket_bits)).tolist()
        is_hot = np.isin(keys & KEY_MASK, hot).tolist() if len(hot) else [False] * len(keys)
        groups: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}
        raw = data.tobytes()
        for bucket, a, hot_here, lo, hi, d in zip(buckets, at.tolist(), is_hot, low.tolist(), high.tolist(), doc.tolist()):
            if lo < 0:
                continue
            begin = lo - int(offsets[d])
            if hot_here:
                for w in range(lo, hi + 1):
                    text = raw[w : w + WINDOW]
                    # equal windows have equal first bytes, which serve as their anchor
                    groups.setdefault((xxhash.xxh64_intdigest(text) >> (64 - bucket_bits), 0, text), []).append((d, begin + w - lo))
            else:
                groups.setdefault((bucket, a - lo, raw[lo : hi + WINDOW]), []).append((d, begin))
        dealt_rows: dict[int, list[tuple]] = {}
        decided: dict[int, list[tuple[int, int]]] = {}
        id_list, key_list = ids.tolist(), row_keys.tolist()
        for (bucket, left, text), found in groups.items():
            owner = min(id_list[d] for d, _ in found)
            rest = []
            for d, begin in found:
                if id_list[d] == owner:
                    rest.append((owner, key_list[d], begin, len(text), left, text))
                else:
                    decided.setdefault(d, []).append((begin, begin + len(text)))
            # equal rows send their contexts once
            dealt_rows.setdefault(bucket, []).extend(rest if len(rest) == 1 else dict.fromkeys(rest))
        rows = [(bucket, len(x), _pack_contexts(x)) for bucket, x in dealt_rows.items()]
        spans = {(key_list[d], id_list[d], a, b) for d, x in decided.items() for a, b in merged(x)}
        if spans:
            rows.append((next(iter(dealt_rows)), -len(spans), zlib.compress(np.array(sorted(spans), np.int64).tobytes(), 1)))
        if rows:
            yield _batch(CONTEXTS, rows)


def identifiers(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers 0, 1, ... of equal names, and how many suffixes each bucket has."""
    order = np.argsort(names)
    ordered = names[order]
    new = np.ones(len(names), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    found = np.empty(len(names), np.uint64)
    found[order] = np.cumsum(new) - 1
    return found, np.diff(np.append(np.flatnonzero(new), len(names)))


def window_buckets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes at ``starts`` those that share their first WINDOW bytes with another, and their buckets.

    Round k sorts the suffixes of a bucket by the identifiers, found in round k - 1, of those STEPS[k] bytes on.
    """
    padded = np.concatenate([data, np.zeros(WINDOW + Q_GRAM, np.uint8)])
    two = padded[:-1].astype(np.uint16) | padded[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    eight = four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)
    bucket, counts = identifiers(eight[: len(data) + WINDOW - Q_GRAM])
    for step in STEPS[:-1]:
        starts = starts[counts[bucket[starts]] > 1]
        # the last round still asks for the buckets of up to WINDOW - step bytes on
        here = np.arange(len(bucket) - step)
        bucket, counts = identifiers(bucket[here] << np.uint64(32) | bucket[here + step])
    starts = starts[counts[bucket[starts]] > 1]
    last, counts = identifiers(bucket[starts] << np.uint64(32) | bucket[starts + STEPS[-1]])
    several = counts[last] > 1
    return starts[several], last[several]


def owned_elsewhere(docs: np.ndarray, begin: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Marks the places in ``data`` whose window also starts in a context of a smaller document."""
    marks = np.zeros(len(data) + 1, bool)
    lasts = size - WINDOW + 1
    context = np.repeat(np.arange(len(begin)), lasts)
    starts = np.arange(len(context)) - np.repeat(np.cumsum(lasts) - lasts, lasts) + begin[context]
    starts, bucket = window_buckets(data, starts)
    if not len(starts):
        return marks
    holder = docs[np.searchsorted(begin, starts, side="right") - 1]
    owner = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(owner, bucket.astype(np.int64), holder)
    marks[starts[holder > owner[bucket.astype(np.int64)]]] = True
    return marks


def refine_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (row_key, doc_id, start, end) of windows owned by smaller documents, bucket by bucket."""
    names = [f.split()[0] for f in SPANS.split(", ")]
    for _, rows in runs(batches):
        fields, texts = [], []
        for _, n, packed in rows:
            if n < 0:
                spans = np.frombuffer(zlib.decompress(packed), np.int64).reshape(-n, 4)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(spans[:, k])) for k in range(4)], names=names)
            else:
                some, text = _unpack_contexts(n, packed)
                fields.append(some)
                texts.append(text)
        if not fields:
            continue
        doc, row, start, size, left = (np.concatenate(x) for x in zip(*fields))
        data, size = np.concatenate(texts), size.astype(np.int64)
        place = np.cumsum(size) - size
        raw, numbers = data.tobytes(), {}
        text = np.fromiter((numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(place.tolist(), (place + size).tolist())), np.int64, len(place))
        owner = np.full(len(numbers), np.iinfo(np.int64).max)
        np.minimum.at(owner, text, doc)
        lost = doc > owner[text]  # a smaller document has the same context
        if lost.any():
            columns = (row[lost], doc[lost], start[lost].astype(np.int64), start[lost] + size[lost])
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=names)
        doc, row, start, size, left, place = (x[~lost] for x in (doc, row, start, size, left, place))
        anchor = np.concatenate([gram_hashes_at(data, place[k : k + 4096] + left[k : k + 4096]) for k in range(0, len(place), 4096)])
        order = np.argsort(anchor, kind="stable")
        begins = np.flatnonzero(np.diff(anchor[order], prepend=~anchor[order[:1]]))
        several = np.minimum.reduceat(doc[order], begins) < np.maximum.reduceat(doc[order], begins)
        # contexts around an anchor of one document take no further part
        order = order[np.repeat(several, np.diff(np.append(begins, len(order))))]
        ends = np.append(np.flatnonzero(np.diff(anchor[order])) + 1, len(order))
        total = np.cumsum(size[order])
        first = 0
        while first < len(order):
            later = ends[ends > first]
            held = total[later - 1] - (total[first - 1] if first else 0)
            last = int(later[max(0, np.searchsorted(held, REFINE_BYTES, side="right") - 1)])
            some = order[first:last]
            first = last
            begin = np.cumsum(size[some]) - size[some]
            take = np.arange(int(size[some].sum())) + np.repeat(place[some] - begin, size[some])
            marks = owned_elsewhere(doc[some], begin, size[some], data[take])
            edges = np.flatnonzero(np.diff(marks.astype(np.int8), prepend=0))
            low, high = edges[::2], edges[1::2]  # windows of a run start at low .. high - 1
            if len(low):
                of = np.searchsorted(begin, low, side="right") - 1
                origin = start[some[of]].astype(np.int64) - begin[of]
                columns = (row[some[of]], doc[some[of]], origin + low, origin + high - 1 + WINDOW)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=names)


def gram_hashes_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``gram_hashes`` at some places."""
    pairs = np.ascontiguousarray(data[at[:, None] + np.arange(GRAM)]).view("<u8")
    return _mix_grams(pairs[:, 0], pairs[:, 1])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of a list of spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def merged_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    return merged([(s["start"], s["end"]) for s in spans or ()])


def own_spans(doc_id: int | None, spans: list[dict] | None) -> list[tuple[int, int]]:
    """The merged spans of a row; those of another id whose row key is equal by chance are left out."""
    return merged([(s["start"], s["end"]) for s in spans or () if s["doc_id"] == doc_id])


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return text
    edges = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """row_key and ``spans`` (array of doc_id, start, end in bytes) of what smaller documents hold; ``docs`` has row_key,
    doc_id, text."""
    spark = docs.sparkSession
    bits = bucket_bits(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select("row_key", "doc_id", "text").mapInArrow(partial(send_anchors, bucket_bits=bits), PACKED)
    sorted_packed = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    found = sorted_packed.mapInArrow(partial(shared_anchors, min_hot=MIN_HOT), FOUND)
    shared = durable(found.repartition(partitions, "block").sortWithinPartitions("block").mapInArrow(by_row, LISTS), "anchors")
    summary = shared.filter("row_key is null")
    total = summary.agg(F.sum("total")).first()[0] or 0
    # at most total / threshold anchors can be hot, so at most HOT_KEYS
    counted = summary.select(F.explode(F.arrays_zip("keys", "hot")).alias("k")).select("k.keys", "k.hot")
    hot = [r[0] for r in counted.filter(F.col("hot") > max(MIN_HOT, total // HOT_KEYS)).select("keys").collect()]
    hot_keys = spark.sparkContext.broadcast(np.sort(np.array(hot, np.uint64)))
    # blocks that hold the same row have found the same anchors of it
    lists = shared.filter("row_key is not null").groupBy("row_key").agg(F.first("keys").alias("keys"))
    contexts = docs.join(lists, "row_key").mapInArrow(partial(send_contexts, hot_keys=hot_keys, bucket_bits=bits), CONTEXTS)
    spans = contexts.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(refine_buckets, SPANS)
    return spans.groupBy("row_key").agg(F.collect_set(F.struct("doc_id", "start", "end")).alias("spans"))


def row_key(doc_id, text):
    """Tells rows with different ids or texts apart; spans carry the id too, so that only equal ids could mix them up."""
    return F.xxhash64(doc_id, text)


def _given(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), row_key(doc_id, text).alias("row_key"))


def substring_digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: n_bytes, n_removed, n_spans and the digest of what is kept."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                raw = text.encode()
                runs = own_spans(doc_id, spans)
                rows.append((doc_id, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(raw, runs)).hexdigest()))
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    given = _given(docs)
    joined = given.join(repeated_spans(given), "row_key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeated_substrings(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated bytes; a character cut apart is dropped, n_chars follows the text."""

    @F.arrow_udf("string")
    def cut(doc_id: pa.Array, text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for d, t, s in zip(doc_id.to_pylist(), texts_of(text), spans.to_pylist()):
            out.append(kept_bytes(t, own_spans(d, s)).decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    given = _given(docs)
    whole = boxed(docs)
    doc_id, text = F.col("row.doc_id").cast("long"), F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    joined = whole.withColumn("row_key", row_key(doc_id, text)).join(repeated_spans(given), "row_key", "left")
    shorter = F.when(F.col("spans").isNotNull(), cut(doc_id, text, "spans"))
    return unboxed(joined.withColumn("shorter", shorter), docs, text="shorter")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(table(spark, sf_dir, "documents"))
