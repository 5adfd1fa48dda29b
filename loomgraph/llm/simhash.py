"""Operator 5: near-duplicate groups by SimHash fingerprints and a generalised pigeonhole.

Fingerprints within ``DISTANCE`` bits are linked. The pigeonhole principle in its general form says:
if the 64 bits are cut into m parts with thresholds t_1..t_m that sum to DISTANCE - m + 1, two linked
fingerprints are within t_i of each other in some part i (a threshold of -1 leaves a part out).
Correlated bits are grouped into the same part, the thresholds (and m) are chosen by dynamic
programming on candidate counts estimated from the bucket sizes of all fingerprints, and candidates
that share a bucket are verified on all 64 bits.

Work is done on distinct fingerprints, so copies cost one row. A bucket with more than HEAVY_BUCKET
fingerprints is not paired: its members are grouped by one-bit neighbours instead. Two fingerprints
are within two bits exactly if they share a value among themselves and their 64 one-bit flips, and a
value is shared by at most 65 fingerprints, so that way is exact and linear.

Defined results: null or empty text has fingerprint zero, linked like any other; equal rows share a
component; null ids never name a component unless it has no other id; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import boxed, chunks, table, texts_of, unboxed
from loomgraph.operators.components import connected_components, hot_join
from loomgraph.session import durable

SHINGLE = 3
HASH_SEED = 42
BITS = 64
DISTANCE = 2
#: Numbers of parts that are tried, and the size from which a bucket takes the linear way.
PART_COUNTS = (2, 3, 4)
HEAVY_BUCKET = 64
#: Stands for a null id in joins.
NO_ID = -(1 << 63)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at once.
HASHES_AT_ONCE = 1 << 15


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return fingerprint_of(np.array([digest(joined[a:b], HASH_SEED) for a, b in spans], np.uint64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit number."""
    ones = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), HASHES_AT_ONCE):
        some = hashes[first : first + HASHES_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return int(bits.view(">i8")[0])


@cache
def simhash_column():
    @F.arrow_udf("long")
    def fingerprint(text: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([text.cast(pa.string())], names=["text"])
        return pa.array([simhash(t) for part in chunks([rows], "text") for t in texts_of(part.column("text"))], pa.int64())

    return fingerprint


def with_fingerprints(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    return docs.withColumn(column, simhash_column()(F.col("text").cast("string")))


def bit_statistics(prints: DataFrame) -> np.ndarray:
    """The 64 x 64 correlations of the bits over all fingerprints, from per-task co-occurrence counts."""

    def count(batches):
        together, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8")
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            for first in range(0, len(bits), 1 << 14):
                together += bits[first : first + (1 << 14)].T @ bits[first : first + (1 << 14)]
            n += len(bits)
        if n:
            cells = np.append(together.ravel(), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    summed = prints.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = np.zeros(BITS * BITS + 1)
    for cell, n in summed.collect():  # 4097 rows whatever the input
        cells[cell] = n
    n = max(cells[-1], 1)
    both = cells[:-1].reshape(BITS, BITS) / n
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both - np.outer(p, p)) / np.outer(spread, spread))


def group_bits(correlation: np.ndarray, n_parts: int) -> list[list[int]]:
    """Greedy parts of equal size: each grows by the bit most correlated with it."""
    free, parts = set(range(BITS)), []
    for k in range(n_parts):
        size = BITS // n_parts + (k < BITS % n_parts)
        rest = sorted(free)
        part = [max(rest, key=lambda b: correlation[b, rest].sum())]
        free -= set(part)
        while len(part) < size:
            best = max(sorted(free), key=lambda b: correlation[b, part].sum())
            part.append(best)
            free.remove(best)
        parts.append(sorted(part))
    return parts


def part_mask(part: list[int]) -> int:
    """Bits are numbered from the most significant; the mask is signed like the fingerprints."""
    mask = sum(1 << (BITS - 1 - b) for b in part)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def allocate_thresholds(costs: list[dict[int, float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds that sum to ``distance - m + 1`` at least cost, by dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, c in part.items():
                if total + t not in step or cost + c < step[total + t][0]:
                    step[total + t] = (cost + c, [*chosen, t])
        best = step
    return best.get(distance - len(costs) + 1, (float("inf"), []))


def choose_parts(prints: DataFrame) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe: the cheapest of all plans by estimated candidates."""
    correlation = bit_statistics(prints)
    plans = {m: group_bits(correlation, m) for m in PART_COUNTS}
    parts = [(m, k, part_mask(p)) for m, ps in plans.items() for k, p in enumerate(ps)]
    keys = F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value")) for i, (_, _, mask) in enumerate(parts)))
    buckets = prints.select(F.explode(keys).alias("k")).groupBy("k.part", "k.value").agg(F.count("*").alias("n"))
    pairs = F.least(F.col("n") * (F.col("n") - 1) / 2, F.col("n") * (BITS + 1))
    rows = buckets.groupBy("part").agg(F.sum(pairs).alias("pairs"), F.sum("n").alias("n")).collect()  # a row per part
    found = {parts[r["part"]][:2]: (r["pairs"], r["n"]) for r in rows}
    options = []
    for m, ps in plans.items():
        costs = []
        for k, part in enumerate(ps):
            candidates, n = found.get((m, k), (0.0, 0))
            costs.append({-1: 0.0, 0: n + candidates, 1: (len(part) + 1) * (n + candidates)})
        cost, thresholds = allocate_thresholds(costs, DISTANCE)
        options.append((cost, m, thresholds))
    _, m, thresholds = min(options)
    return [(part, t) for part, t in zip(plans[m], thresholds) if t >= 0]


def _flips(bits: list[int]) -> list[int]:
    return [part_mask([b]) for b in bits]


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint_links(prints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints (column ``fp``) that connect all within DISTANCE."""
    fp = F.col("fp")
    index_keys, probe_keys = [], []
    for k, (bits, threshold) in enumerate(parts):
        value = fp.bitwiseAND(F.lit(part_mask(bits)))
        probes = [value, *(value.bitwiseXOR(F.lit(f)) for f in (_flips(bits) if threshold else []))]
        index_keys.append(F.struct(F.lit(k).alias("part"), value.alias("value")))
        probe_keys += [F.struct(F.lit(k).alias("part"), p.alias("value")) for p in probes]
    index = prints.select("fp", F.explode(F.array(*index_keys)).alias("k")).select("fp", "k.part", "k.value")
    probes = prints.select("fp", F.explode(F.array(*probe_keys)).alias("k")).select("fp", "k.part", "k.value")
    heavy = durable(
        index.groupBy("part", "value").agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY_BUCKET).select("part", "value"), "simhash-heavy"
    )
    light = index.join(heavy, ["part", "value"], "left_anti").alias("i")
    found = light.join(
        probes.alias("p"),
        (F.col("i.part") == F.col("p.part"))
        & (F.col("i.value") == F.col("p.value"))
        & (F.col("p.fp") < F.col("i.fp"))
        & (_differ(F.col("p.fp"), F.col("i.fp")) <= DISTANCE),
    ).select(F.col("p.fp").alias("u"), F.col("i.fp").alias("v"))
    crowded = probes.join(heavy, ["part", "value"], "left_semi").select("fp").distinct()
    near = F.array(F.lit(0).cast("long"), *(F.lit(f).cast("long") for f in _flips(list(range(BITS)))))
    neighbours = crowded.select("fp", F.explode(F.transform(near, lambda f: fp.bitwiseXOR(f))).alias("shared"))
    least = F.min("fp").over(Window.partitionBy("shared"))  # at most 65 fingerprints share a value
    linear = neighbours.select(least.alias("u"), F.col("fp").alias("v")).filter("u <> v")
    return found.union(linear).distinct()


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, ``text_hash``, ``fp`` and ``component_id``; and ``root``, the component's least
    fingerprint."""
    given = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    printed = durable(with_fingerprints(given, "fp").drop("text"), "simhash")
    prints = durable(printed.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "simhash-distinct")
    links = fingerprint_links(prints, choose_parts(prints))
    roots = connected_components(links).withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    # a fingerprint of very many rows, or a component of very many fingerprints, is not gathered in one task
    placed = hot_join(rooted.select("fp", "root", F.col("n").alias("copies")), named, "root", prints.count()).withColumnRenamed("copies", "n")
    return hot_join(printed, placed, "fp", printed.count())


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group: that with the least doc_id (and hash of the text, if ids repeat)."""
    groups = near_duplicate_groups(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = groups.groupBy("root").agg(F.min(order).alias("first")).select(
        F.col("first.doc_id").alias("__keep_id"), F.col("first.text_hash").alias("__hash")
    )
    # a key without nulls, so that the join and the removal of repeated rows use one shuffle of the texts;
    # the hash of the text tells rows with one id apart without a second round of fingerprints
    no_id = F.lit(NO_ID)
    keyed = boxed(docs, __id=F.coalesce(F.col("row.doc_id").cast("long"), no_id), __hash=F.xxhash64("row.text"))
    wanted = first.select(F.coalesce(F.col("__keep_id").cast("long"), no_id).alias("__id"), "__hash")
    return unboxed(keyed.join(wanted, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"]), docs)


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
