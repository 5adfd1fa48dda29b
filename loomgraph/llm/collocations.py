"""Operator 12: phrase collocations by Rabin-Karp fingerprints.

Texts (A-Z lower-cased) are cut into pieces and words; a phrase is 1 to 5 words of one piece. In a block of documents
every word has a 64-bit hash, and one prefix polynomial over all words gives the fingerprint of every phrase by a subtraction
and a multiplication, in numpy. Fingerprints carry the language, as everything is counted per language.

Counting. A block sends every distinct fingerprint of a length with its count, packed by bucket; buckets are summed, and a
fingerprint with LEAST occurrences or more sets one of a fixed number of bits. A phrase can only be frequent if all its
words and pairs of words are, so words go first, then pairs of frequent words, then phrases of frequent pairs; each filter is
broadcast and has FILTER_BITS bits at any size of the corpus. The sums only decide what is looked at again, and they never
fall short: equal fingerprints of different phrases, and different fingerprints of one bit, let too much through, never too little.

Verifying. Tasks then read the texts once more. Of all occurrences of a fingerprint that passes, the first in the block is the
pointer (document, word); the others are compared with the text there, word by word, and what differs gets a pointer of
its own. A task sends each phrase once, as text, with its count and its least pointer, packed by bucket; where a bucket's
phrases meet, equal texts are added up. So counts are exact whatever the fingerprints do, and only phrases that pass are ever made into strings.

Scores, cuts and the rule of longer phrases are joins over the frequent phrases. Products are decimals of 38 digits.

Defined results: null or empty text has no words; null lang is ``und``; repeated rows count as often as they are there;
the pointer is the least (doc_id, word) among the blocks' first ones, rows without an id last; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import blocks, bucket_bits, runs, slices, table, text_buffer
from loomgraph.llm.passages import SEEDS, mix, word_hashes
from loomgraph.session import durable

LONGEST = 5
LEAST = 100
TOP = 2000
BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 1 << 15
#: Bits of each broadcast filter, as a power of two: 16 MiB.
FILTER_BITS = 27
#: Bits of a fingerprint that are sent beside its bucket's.
SENT_BITS = 24
#: Phrases that a task adds up before it sends them, and text bytes it looks at meanwhile.
HELD_PHRASES = 1 << 19
PHRASE_BYTES = 4 << 20
#: A language's candidates are ranked in so many parts first.
RANK_PARTS = 32
#: Languages up to which their totals are broadcast; beyond it they are joined.
BROADCAST_LANGS = 10_000
#: Base of the polynomial (odd, so it has an inverse modulo 2 ** 64).
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
# Fixed values of the contract: what ends a piece, what ends a word.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(PIECE_ENDS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """The words of a block in order: their bytes, hashes, rows, and how many words of their piece start at each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    row: np.ndarray
    ahead: np.ndarray
    lang: np.ndarray

    def fingerprints(self, kept_bits: int) -> Iterator[np.ndarray]:
        """For each length the fingerprints of the phrases from every word on (of no use where the piece ends before)."""
        n = len(self.starts)
        prefix = np.zeros(n + 1, np.uint64)
        prefix[1:] = np.cumsum(self.hashes * powers(BASE, n), dtype=np.uint64)
        shift = powers(INVERSE, n)
        keep = np.uint64(((1 << kept_bits) - 1) << (64 - kept_bits))
        for length in range(1, LONGEST + 1):
            m = max(0, n - length + 1)
            value = (prefix[length:] - prefix[:m]) * shift[:m] if m else prefix[:0]
            yield mix(value + self.lang[self.row[:m]] * np.uint64(2 * length + 1)) & keep


def find_words(batch: pa.RecordBatch) -> Words:
    data, offsets = text_buffer(batch.column("text"))
    data = _LOWER[data]
    kind = _KIND[data]
    inside = kind == 0
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[cuts] = inside[cuts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first, len(starts))
    ahead = np.repeat(last[1:], np.diff(last)) - np.arange(len(starts))
    langs = pc.dictionary_encode(batch.column("lang"))
    names = [s.encode() for s in langs.dictionary.to_pylist()]
    sizes = np.array([len(s) for s in names], np.int64)
    whole = np.frombuffer(b"".join(names), np.uint8)
    of_lang = word_hashes(whole, np.cumsum(sizes) - sizes, np.cumsum(sizes), SEEDS[1])
    lang = of_lang[langs.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(batch.num_rows, np.uint64)
    return Words(data, starts, ends, word_hashes(data, starts, ends, SEEDS[0]), row, ahead, lang)


def passing(bits: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    at = fingerprints >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def looked_at(words: Words, filters: list[np.ndarray | None], kept_bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, fingerprints) of the phrases that can be frequent as far as the filters of shorter ones tell:
    words, pairs of frequent words, longer phrases of frequent pairs. ``filters``: of words, of pairs, of the longer ones."""
    short = None
    for length, found in enumerate(words.fingerprints(kept_bits), 1):
        ok = words.ahead[: len(found)] >= length
        if length > 1:
            parts = 2 if length == 2 else length - 1
            for k in range(parts):
                ok &= short[k : k + len(found)]
        at = np.flatnonzero(ok)
        yield length, at, found[at]
        if length < 3:
            bits = filters[length - 1]
            if bits is None:
                return
            short = np.zeros(len(found), bool)
            short[at] = passing(bits, found[at])


def packed_ints(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes, so that high bytes of small ones cost nothing."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked_ints(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel()


SENT = "bucket long, hashes binary, counts binary"


def send_fingerprints(batches: Iterator[pa.RecordBatch], filters: list, lengths: tuple[int, ...], bits: int, kept_bits: int) -> Iterator[pa.RecordBatch]:
    """The distinct fingerprints of a block with their counts: SENT_BITS of each beside the bucket's own, as steps from one to the next."""
    known = [f.value if f is not None else None for f in filters]
    for batch in blocks(batches, BLOCK_BYTES, BLOCK_ROWS):
        found = [f for length, _, f in looked_at(find_words(batch), known, kept_bits) if length in lengths]
        hashes = np.sort(np.concatenate(found) >> np.uint64(64 - SENT_BITS - bits))
        if not len(hashes):
            continue
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(hashes)))
        hashes = hashes[first]
        rest = hashes & np.uint64((1 << SENT_BITS) - 1)
        rows = [(bucket, packed_ints(np.diff(rest[a:b], prepend=rest[:0].dtype.type(0))), packed_ints(count[a:b])) for bucket, a, b in slices(hashes >> np.uint64(SENT_BITS))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "hashes", "counts"])


def set_bits(batches: Iterator[pa.RecordBatch], least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Each bucket's share of the filter, if any bit is set."""
    for bucket, rows in runs(batches):
        hashes = np.concatenate([np.cumsum(unpacked_ints(h), dtype=np.uint32) for _, h, _ in rows])
        count = np.concatenate([unpacked_ints(c) for _, _, c in rows])
        order = np.argsort(hashes, kind="stable")
        hashes, count = hashes[order], count[order].astype(np.int64)
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        first = np.flatnonzero(new)
        frequent = hashes[first][np.add.reduceat(count, first) >= least]
        if len(frequent):
            share = np.zeros(1 << (FILTER_BITS - bits), bool)
            share[frequent >> np.uint32(SENT_BITS - FILTER_BITS + bits)] = True
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([np.packbits(share, bitorder="little").tobytes()], pa.binary())], names=["bucket", "share"])


def frequent_filter(docs: DataFrame, filters: list, lengths: tuple[int, ...], least: int, kept_bits: int):
    """The broadcast filter of the phrases of ``lengths``."""
    spark = docs.sparkSession
    bits = bucket_bits(spark)
    sent = docs.select("lang", "text").mapInArrow(partial(send_fingerprints, filters=filters, lengths=lengths, bits=bits, kept_bits=kept_bits), SENT)
    dealt = sent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket")
    shares = dealt.mapInArrow(partial(set_bits, least=least, bits=bits), "bucket long, share binary")
    whole = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = len(whole) >> bits
    for row in shares.toLocalIterator():  # len(whole) bytes in all
        whole[row.bucket * size : (row.bucket + 1) * size] = np.frombuffer(row.share, np.uint8)
    return spark.sparkContext.broadcast(whole)


def same_words(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words at ``a`` and ``b`` (arrays of places) have the same bytes."""
    size = words.ends[a] - words.starts[a]
    same = size == words.ends[b] - words.starts[b]
    rows, at = np.flatnonzero(same), 0
    while len(rows):
        x, y = words.starts[a[rows]] + at, words.starts[b[rows]] + at
        for k in range(min(8, int((size[rows] - at).max()))):
            inside = at + k < size[rows]
            same[rows] &= ~inside | (words.data[np.minimum(x + k, len(words.data) - 1)] == words.data[np.minimum(y + k, len(words.data) - 1)])
        at += 8
        rows = rows[same[rows] & (size[rows] > at)]
    return same


def word_numbers(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A number for every word that equal words of the block share and others do not, and the numbers' first places: words of
    one hash are compared with the first of them, and those that differ are told apart by their text."""
    order = np.argsort(words.hashes, kind="stable")
    hashes = words.hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    firsts = order[np.flatnonzero(new)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    odd = np.flatnonzero(~same_words(words, np.arange(len(order)), firsts[number]))
    more: dict[tuple[int, bytes], int] = {}
    places = []
    for p in odd.tolist():
        key = (int(number[p]), words.data[words.starts[p] : words.ends[p]].tobytes())
        if key not in more:
            more[key] = len(firsts) + len(places)
            places.append(p)
        number[p] = more[key]
    return number, np.append(firsts, np.array(places, np.int64))


def grouped(fingerprints: np.ndarray, at: np.ndarray, number: np.ndarray, lang: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pointers, and how many occurrences each stands for, of phrases that are the same in text and language."""
    order = np.argsort(fingerprints, kind="stable")  # so the first of a group is the first in the block
    at, fingerprints = at[order], fingerprints[order]
    new = np.ones(len(at), bool)
    new[1:] = fingerprints[1:] != fingerprints[:-1]
    group = np.cumsum(new) - 1
    pointer = at[new]
    same = lang[at] == lang[pointer[group]]
    for k in range(length):
        same &= number[at + k] == number[pointer[group] + k]
    count = np.bincount(group[same], minlength=len(pointer))
    odd: dict[tuple, list[int]] = {}
    for p in at[~same].tolist():
        odd.setdefault((int(lang[p]), *number[p : p + length].tolist()), []).append(p)
    extra = [min(places) for places in odd.values()]
    return np.append(pointer, np.array(extra, np.int64)), np.append(count, np.array([len(p) for p in odd.values()], np.int64))


PACKED = "bucket long, lang string, phrases binary, counts binary, docs binary, words binary"
PHRASES = "lang string, words int, phrase string, f long, doc_id long, word long"
#: Stands for the id of a row without one; such pointers come last.
NO_ID = (1 << 63) - 1


def _sent(held: dict[str, dict[str, list]], totals: dict[str, int]) -> pa.RecordBatch:
    """A row for each language and bucket, its phrases sorted; and a row for each language with its number of words."""
    rows = []
    for lang, phrases in held.items():
        order = sorted(phrases, key=lambda p: (phrases[p][0], p))
        bucket = np.array([phrases[p][0] for p in order], np.int64)
        for k, a, b in slices(bucket):
            values = np.array([phrases[p][1:] for p in order[a:b]], np.int64).T
            rows.append((k, lang, zlib.compress("\n".join(order[a:b]).encode(), 1), *(zlib.compress(v.tobytes(), 1) for v in values)))
    rows += [(0, lang, None, np.int64(n).tobytes(), None, None) for lang, n in totals.items()]
    types = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in PACKED.split(", ")])


def materialise(batches: Iterator[pa.RecordBatch], filters: list, bits: int, kept_bits: int) -> Iterator[pa.RecordBatch]:
    """The phrases of a task that pass, with their verified counts and pointers, added up over its blocks; and the number of words of each language."""
    known = [f.value for f in filters]
    held: dict[str, dict[str, list]] = {}
    totals: dict[str, int] = {}
    for batch in blocks(batches, PHRASE_BYTES, BLOCK_ROWS):
        words = find_words(batch)
        if not len(words.starts):
            continue
        number, firsts = word_numbers(words)
        encoded = pc.dictionary_encode(batch.column("lang"))
        names = encoded.dictionary.to_pylist()
        lang = encoded.indices.to_numpy(zero_copy_only=False)[words.row]
        for k, n in enumerate(np.bincount(lang, minlength=len(names)).tolist()):
            if n:
                totals[names[k]] = totals.get(names[k], 0) + n
        texts = [words.data[a:b].tobytes().decode() for a, b in zip(words.starts[firsts].tolist(), words.ends[firsts].tolist())]
        ids = [NO_ID if d is None else d for d in batch.column("doc_id").to_pylist()]
        of_row = np.searchsorted(words.row, np.arange(batch.num_rows))
        of_lang = [held.setdefault(name, {}) for name in names]
        for length, at, fingerprints in looked_at(words, known, kept_bits):
            ok = passing(known[min(length, 3) - 1], fingerprints)
            at, fingerprints = at[ok], fingerprints[ok]
            pointers, counts = grouped(fingerprints, at, number, lang, length)
            bucket = (fingerprints[np.searchsorted(at, pointers)] >> np.uint64(64 - bits)).tolist()
            row = words.row[pointers]
            parts = number[pointers[:, None] + np.arange(length)].tolist()
            for k, p, b, n, r, w in zip(lang[pointers].tolist(), parts, bucket, counts.tolist(), row.tolist(), (pointers - of_row[row]).tolist()):
                phrase = " ".join([texts[i] for i in p])
                seen = of_lang[k].get(phrase)
                if seen is None:
                    of_lang[k][phrase] = [b, n, ids[r], w]
                else:
                    seen[1] += n
                    if (ids[r], w) < (seen[2], seen[3]):
                        seen[2:] = ids[r], w
        if sum(map(len, held.values())) > HELD_PHRASES:
            yield _sent(held, {})
            held = {}
    if totals:
        yield _sent(held, totals)


def add_phrases(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The phrases of a bucket with ``least`` occurrences or more, equal texts of a language added up; and the languages' numbers of words (phrase null)."""
    for _, rows in runs(batches):
        held: dict[str, dict[bytes, list]] = {}
        out = []
        for _, lang, phrases, counts, docs, words in rows:
            if phrases is None:
                out.append((lang, 0, None, int(np.frombuffer(counts, np.int64)[0]), None, None))
                continue
            known = held.setdefault(lang, {})
            columns = (np.frombuffer(zlib.decompress(c), np.int64).tolist() for c in (counts, docs, words))
            for phrase, n, doc, word in zip(zlib.decompress(phrases).split(b"\n"), *columns):
                seen = known.get(phrase)
                if seen is None:
                    known[phrase] = [n, doc, word]
                else:
                    seen[0] += n
                    if (doc, word) < (seen[1], seen[2]):
                        seen[1:] = doc, word
        for lang, phrases in held.items():
            out += [(lang, p.count(b" ") + 1, p.decode(), n, None if doc == NO_ID else doc, word) for p, (n, doc, word) in phrases.items() if n >= least]
        if out:
            types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in PHRASES.split(", ")])


def frequent_phrases(docs: DataFrame, least: int = LEAST, kept_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """All phrases with ``least`` occurrences or more (lang, words, phrase, f, doc_id, word), and the words of each language
    (lang, n). ``kept_bits`` of a fingerprint count; fewer make more of them meet and change nothing else."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))
    filters: list = [None, None, None]
    for k, lengths in enumerate(((1,), (2,), tuple(range(3, LONGEST + 1)))):
        filters[k] = frequent_filter(rows, filters[:2], lengths, least, kept_bits)
    bits = bucket_bits(docs.sparkSession)
    sent = rows.mapInArrow(partial(materialise, filters=filters, bits=bits, kept_bits=kept_bits), PACKED)
    dealt = sent.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket")
    kept = durable(dealt.mapInArrow(partial(add_phrases, least=least), PHRASES), "phrases")
    totals = kept.filter("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))
    return kept.filter("phrase is not null"), totals


def with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    few = totals.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS
    return rows.join(F.broadcast(totals) if few else totals, "lang")


def joined(words: Column, first: int | Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut: lang, phrase, a, l, r, n, score."""
    split = F.split("phrase", " ", -1)
    cuts = phrases.filter("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "doc_id", "word", "k", joined(split, 1, F.col("k")).alias("head"), joined(split, F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    parts = phrases.filter(F.col("words") < LONGEST)
    heads = parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    known = with_totals(cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]), totals)
    known = known.withColumn("score", F.expr("(1000 * cast(a as decimal(15,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = known.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "doc_id", "word")).alias("x"))
    return best.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score", "x.doc_id", "x.word")


def covered(phrases: DataFrame) -> DataFrame:
    """Per phrase inside a longer one the largest count of such: lang, phrase, longer."""
    split, n = F.split("phrase", " ", -1), F.col("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: joined(split, at, size))))
    parts = phrases.filter("words > 2").select("lang", "f", F.explode(F.array_distinct(inner)).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def mine_collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, kept_bits: int = 64) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, and the pointer example_doc_id, example_word."""
    phrases, totals = frequent_phrases(docs, least, kept_bits)
    found = scored(phrases, totals).join(covered(phrases), ["lang", "phrase"], "left")
    found = found.filter(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    first = found.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("doc_id").alias("example_doc_id"), F.col("word").alias("example_word"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns only; pointers depend on how documents are dealt into blocks."""
    return mine_collocations(table(spark, sf_dir, "documents")).drop("example_doc_id", "example_word")


_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {n} AS words, array_to_string(w[i:i + {n - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM p)" for n in range(1, LONGEST + 1)
)
OP12_SQL = f"""
WITH p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, words, phrase, count(*)::HUGEINT AS f, string_split(phrase, ' ') AS w FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT c.lang, c.phrase, c.words, c.f AS a, h.f AS l, r.f AS r, t.n, k, 1000 * c.f * t.n // (h.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM f WHERE words > 1) c
  JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
  JOIN t ON t.lang = c.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM cuts) WHERE i = 1),
inner_phrases AS (
  SELECT lang, f, array_to_string(w[i:i + s - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, words - s + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS s FROM f WHERE words > 2))),
longer AS (SELECT lang, phrase, max(f) AS f FROM inner_phrases GROUP BY ALL),
ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
  FROM best LEFT JOIN longer ON best.lang = longer.lang AND best.phrase = longer.phrase
  WHERE longer.f IS NULL OR 100 * longer.f < 100 * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {TOP}
"""
