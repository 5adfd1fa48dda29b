"""Near copies of whole documents: word shingles with a Jaccard similarity from SIMILARITY on.

Candidates meet by SimHash fingerprints of their shingles first, linked by operator 5's generalised pigeonhole. These find the close ones:
at a Jaccard similarity of 0.8 about ten of the 64 bits differ, and parts short enough to find that far meet nearly everything.
The rest of the candidates meet by minima of hashed shingles (BANDS keys of ROWS minima: a pair at 0.8 meets with probability 0.998, a closer one
sooner), and every link is verified by the exact similarity of the two sets of shingles. Before that, pairs that
cannot reach it fall out by sizes and by bitmaps that hold the parity of shingles hashed to each bit: two
bitmaps differ in no more bits than the sets differ in shingles, so no link is lost.

Documents with equal words are one class. In a bucket every class is compared with the least one; only
classes that this leaves outside the least one's component are compared with the rest of the bucket, so
that the components are those of all verified pairs, while a large group of copies costs one comparison each.

Defined results: letters A to Z count as small ones; a text of fewer words than a shingle is one shingle;
texts without words are copies of each other; null ids come last; of equal rows one stays; other columns pass
through whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import boxed, chunks, texts_of, unboxed
from loomgraph.llm.simhash import HASH_SEED, LOWER, NO_ID, choose_parts, fingerprint_links, fingerprint_of
from loomgraph.operators.components import connected_components, hot_join
from loomgraph.session import durable

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 6
#: 64-bit words of a bitmap.
BITMAP_WORDS = 16
#: Pairs of one class, about, that are compared in one place.
BLOCK_PAIRS = 1 << 10
#: Shingles whose minima are taken at once.
SHINGLES_AT_ONCE = 1 << 12


def shingles(words: list[bytes], joined: bytes, shingle: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a text."""
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.unique(np.array([digest(joined[a:b], HASH_SEED) for a, b in spans], np.uint64))


@cache
def permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(11).integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32)
    return draw[0] | np.uint32(1), draw[1]


def bands(hashes: np.ndarray) -> list[int]:
    """One key for each band, signed; none for a text without words."""
    if not len(hashes):
        return []
    factor, shift = permutations()
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for first in range(0, len(short), SHINGLES_AT_ONCE):
        np.minimum(least, ((short[first : first + SHINGLES_AT_ONCE] ^ shift) * factor).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bit k tells whether an odd number of the shingles fall on k."""
    bits = 64 * BITMAP_WORDS
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def may_link(n: Column, bits: Column, other_n: Column, other_bits: Column, similarity: float) -> Column:
    """False only for pairs whose sizes and bitmaps rule the similarity out."""
    sizes = F.least(n, other_n) >= similarity * F.greatest(n, other_n)
    differ = sum((F.bit_count(bits[k].bitwiseXOR(other_bits[k])) for k in range(BITMAP_WORDS)), F.lit(0))
    return sizes & (differ * (1 + similarity) <= (n + other_n) * (1 - similarity) + 1e-6)


def sketch(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        ids, sizes, maps, keys, prints = [], [], [], [], []
        for text in texts_of(batch.column("text")):
            words = text.translate(LOWER).split()
            joined = b" ".join(words)
            hashes = shingles(words, joined, shingle)
            ids.append(xxhash.xxh64_intdigest(joined, HASH_SEED))
            sizes.append(len(hashes))
            maps.append(bitmap(hashes))
            keys.append(bands(hashes))
            prints.append(fingerprint_of(hashes) if len(hashes) else 0)
        columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(maps, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "id", "n", "bits", "bands", "fp"])


@cache
def shingle_column(shingle: int):
    @F.arrow_udf("binary")
    def hashed(text: pa.Array) -> pa.Array:
        split = (t.translate(LOWER).split() for t in texts_of(text.cast(pa.string())))
        return pa.array([shingles(words, b" ".join(words), shingle).tobytes() for words in split], pa.binary())

    return hashed


def compare(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """``u, v`` of the similar pairs among rows u, block, v, s sorted by them, where the row without v holds the set of u for the block's pairs."""
    first = np.zeros(0, np.uint64)
    for batch in batches:
        found = []
        for u, v, s in zip(*(batch.column(c) for c in ("u", "v", "s"))):
            shingled = np.frombuffer(s.as_buffer(), np.uint64)
            if not v.is_valid:
                first = shingled.copy()
                continue
            both = len(np.intersect1d(first, shingled, assume_unique=True))
            if both / max(len(first) + len(shingled) - both, 1) >= similarity:
                found.append((u.as_py(), v.as_py()))
        columns = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v"])


def row_keys(rows: DataFrame) -> DataFrame:
    """A row's id without nulls, and the hash of its text, which tells rows with one id apart."""
    return rows.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs ``u, v`` of classes whose sets of shingles are similar, from the texts of a row of each."""
    asked = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    rows = row_keys(classes.join(asked, "id").select("id", "first.doc_id", "first.text_hash")).select("id", "__id", "text_hash")
    texts = row_keys(docs.select("doc_id", "text", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))).drop("doc_id")
    one = texts.join(rows, ["__id", "text_hash"]).dropDuplicates(["id"])
    sets = durable(one.select("id", shingle_column(shingle)(F.col("text").cast("string")).alias("s")), "near-sets")
    # a set goes to each of its pairs as v, and once to every block of pairs as u
    per_u = pairs.groupBy("u").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK_PAIRS))
    dealt = hot_join(pairs, per_u, "u", pairs.count()).select("u", F.pmod(F.xxhash64("v"), "blocks").alias("block"), "v")
    dealt = durable(dealt, "near-dealt")
    firsts = dealt.select("u", "block").distinct().join(sets.withColumnRenamed("id", "u"), "u").withColumn("v", F.lit(None).cast("long"))
    sent = dealt.join(sets.withColumnRenamed("id", "v"), "v").unionByName(firsts)
    met = sent.repartition("u", "block").sortWithinPartitions("u", "block", "v")
    return durable(met.mapInArrow(partial(compare, similarity=similarity), "u long, v long"), "near-links")


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Candidates ``rep, id`` by the classes' SimHash fingerprints (``fp``): every class with the least of its fingerprint, and the least ones of linked fingerprints."""
    prints = durable(classes.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "near-prints")
    links = fingerprint_links(prints, choose_parts(prints))
    own = hot_join(classes.select("id", "fp"), prints, "fp", classes.count()).filter("id <> rep").select("rep", "id")
    least = prints.select("fp", "rep")
    met = links.join(least.toDF("u", "rep"), "u").join(least.toDF("v", "id"), "v").select("rep", "id")
    return own.union(met)


def near_copy_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of ``docs``: doc_id, ``text_hash``, and ``root``, the least class of its component."""
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    schema = "doc_id long, text_hash long, id long, n int, bits array<long>, bands array<long>, fp long"
    sketched = durable(given.mapInArrow(partial(sketch, shingle=shingle), schema), "near-sketch")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    classes = durable(sketched.groupBy("id").agg(first, F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "near-classes")
    index = classes.select("id", F.explode("bands").alias("band"))
    least = index.groupBy("band").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count("*").alias("n")).filter("rep <> last").drop("last")
    met = durable(hot_join(index, least, "band", BANDS * classes.count()), "near-met")
    sized = classes.select("id", "n", "bits")
    reps = sized.select(F.col("id").alias("rep"), F.col("n").alias("rep_n"), F.col("bits").alias("rep_bits"))
    stars = durable(met.filter("id <> rep").select("rep", "id").union(fingerprint_pairs(classes)).distinct(), "near-stars")
    reps = reps.join(stars.groupBy("rep").agg(F.count("*").alias("n")), "rep")
    stars = hot_join(stars, reps, "rep", stars.count()).join(sized, "id")
    stars = stars.filter(may_link(F.col("n"), F.col("bits"), F.col("rep_n"), F.col("rep_bits"), similarity))
    links = verified(durable(stars.select(F.col("rep").alias("u"), F.col("id").alias("v")), "near-pairs"), docs, classes, shingle, similarity)
    joined = connected_components(links)
    # pairs of one bucket that no star compares: at least one of them is outside the component of the bucket's least
    named = met.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    roots = joined.select(F.col("node").alias("rep"), F.col("component").alias("rep_c"))
    placed = durable(named.join(roots, "rep", "left").withColumn("rep_c", F.coalesce("rep_c", "rep")), "near-placed")
    held = placed.join(placed.filter("c <> rep_c").select("band").distinct(), "band", "left_semi").join(sized, "id")
    held = durable(held, "near-outside")
    outside = held.filter("c <> rep_c").select("band", F.col("id").alias("x"), F.col("n").alias("x_n"), F.col("bits").alias("x_bits"), F.col("c").alias("x_c"))
    met_outside = F.expr("c <> x_c") & may_link(F.col("n"), F.col("bits"), F.col("x_n"), F.col("x_bits"), similarity)
    rest = held.filter("id <> rep").join(outside, "band").filter(met_outside)
    pairs = durable(rest.select(F.least("id", "x").alias("u"), F.greatest("id", "x").alias("v")).distinct(), "near-pairs")
    if not pairs.isEmpty():
        more = verified(pairs, docs, classes, shingle, similarity)
        joined = connected_components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    rooted = sketched.select("doc_id", "text_hash", "id").join(joined.withColumnRenamed("node", "id"), "id", "left")
    return rooted.select("doc_id", "text_hash", F.coalesce("component", "id").alias("root"))


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group: that with the least doc_id (and hash of the text, if ids repeat)."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = near_copy_groups(docs, shingle, similarity).groupBy("root").agg(F.min(order).alias("first"))
    wanted = row_keys(kept.select("first.doc_id", F.col("first.text_hash").alias("__hash"))).select("__id", "__hash")
    keyed = row_keys(boxed(docs, doc_id=F.col("row.doc_id"), __hash=F.xxhash64(F.col("row.text").cast("string"))))
    return unboxed(keyed.join(wanted, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"]), docs)
