"""Operator 2: mixing sources to target weights, in DataFrame operations only.

Every source gets a token budget from its weight (water filling under a cap on repeats).
Efraimidis-Spirakis sampling orders the documents of a source: the key of a document is an
exponential variate over its quality weight, so sorting by it ascending draws without
replacement in proportion to quality. Whole epochs come first; the rest of the budget is
filled along the sorted keys by prefix sums, and the document on the border gives only the
words that still fit.

A source may hold a third of all rows, so no window runs over a whole source: keys are dealt
into buckets, prefix sums run over bucket totals, and only the one bucket per source in which
the budget ends is sorted row by row. Buckets are equal steps of the logarithm of the key: whatever the
weights, no step of length 1/n holds more than 0.37/n of a source, and with n the root of the source's rows both
the buckets and the rows of one are few. What comes out is one small row per source (its
key threshold), joined back to the documents.

Defined results: null text has size 0; null source is a source of its own, sorted last; equal
rows (same id and text) share one key and split the border's words evenly; other columns pass through whatever
their names; an empty table gives no rows; sources without words have target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD, boxed, table, unboxed
from loomgraph.operators.ordered import global_row_number
from loomgraph.session import durable

#: Weights dealt to the sources in order of their names, repeating.
SOURCE_WEIGHTS = (5.0, 2.0, 1.0)
#: The mix has this share of all words; no source is taken more often than MAX_EPOCHS.
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2.0
#: Sources up to this number are broadcast to the documents; more are joined by a shuffle, with the same result.
BROADCAST_SOURCES = 10_000
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Prose has five to six characters a word; a document weighs less the further it is from that."""
    mean_length = F.length(text) / F.greatest(size, F.lit(1))
    return 1.0 / (1.0 + F.abs(F.log(F.greatest(mean_length, F.lit(0.1)) / 5.5)))


def with_sampling_key(docs: DataFrame) -> DataFrame:
    """Adds ``__size`` (words) and ``__key`` (Efraimidis-Spirakis key, smaller is drawn earlier)."""
    sized = docs.withColumn("__size", word_count(F.col("text")))
    bits = F.xxhash64(F.lit(SEED), "doc_id", "text").bitwiseAND(F.lit((1 << 53) - 1))
    uniform = (bits.cast("double") + 0.5) / float(1 << 53)
    weight = F.coalesce(quality_weight(F.col("text"), F.col("__size")), F.lit(1.0))
    return sized.withColumn("__key", -F.log(uniform) / weight)


def source_targets(keyed: DataFrame) -> DataFrame:
    """One row per source: ``source_size``, ``n_rows`` and ``target``, by water filling.

    The level rises in rounds: sources that it fills to their cap give the rest of their share to the others, until no more are filled. A round is one
    aggregate over the sources, and few are needed, as a round fills all sources under its level. Caps and weights are whole, so their sums do not
    depend on order. However many sources there are, no task sees them all.
    """
    sources = keyed.groupBy("source").agg(F.sum("__size").alias("source_size"), F.count("*").alias("n_rows"))
    dealt = F.array(*map(F.lit, SOURCE_WEIGHTS))
    weight = F.element_at(dealt, (F.pmod(F.col("row_number") - 1, F.lit(len(SOURCE_WEIGHTS))) + 1).cast("int"))
    ranked = global_row_number(sources, F.col("source").asc_nulls_last()).withColumns({"__weight": weight, "__cap": MAX_EPOCHS * F.col("source_size")})
    ranked = durable(ranked, "mix-sources")
    budget = TOTAL_SHARE * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, n_filled = -1.0, -1
    while True:
        filled = F.col("__cap") <= F.col("__weight") * level
        spent, sharing, n = ranked.agg(
            F.coalesce(F.sum(F.when(filled, F.col("__cap"))), F.lit(0.0)), F.sum(F.when(~filled, F.col("__weight"))), F.count_if(filled)
        ).first()
        if n == n_filled or not sharing:
            break
        level, n_filled = (budget - spent) / sharing, n
    target = F.least("__cap", F.col("__weight") * level)
    return ranked.select("source", "source_size", "n_rows", target.alias("target"))


def source_thresholds(keyed: DataFrame) -> DataFrame:
    """One row per source: its target, whole ``epochs``, and where along its keys the rest of the budget ends.

    ``cut_key`` is the key of the border group, ``cut_words`` what each of its rows still gives.
    """
    targets = durable(source_targets(keyed), "mix-targets")
    largest = targets.agg(F.max("n_rows")).first()[0] or 0
    n_buckets = max(1, math.isqrt(largest))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "__rest", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    bucket = F.floor(F.log(F.greatest("__key", F.lit(1e-300))) * n_buckets)
    bucketed = keyed.withColumn("__bucket", bucket)

    def border(parts: DataFrame, order: str) -> DataFrame:
        running = Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        summed = parts.withColumn("__before", F.coalesce(F.sum("__words").over(running), F.lit(0)))
        joined = summed.alias("p").join(plan.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
        inside = (F.col("__start") <= F.col("__rest")) & (F.col("__rest") < F.col("__start") + F.col("__words"))
        return joined.withColumn("__start", F.col("__before") + F.col("__base")).filter(inside)

    totals = bucketed.groupBy("source", "__bucket").agg(F.sum("__size").alias("__words"))
    edge = border(totals.withColumn("__base", F.lit(0)), "__bucket").select(
        F.col("p.source").alias("source"), F.col("__bucket"), F.col("__start").alias("__base")
    )
    edge_rows = bucketed.alias("d").join(
        edge.alias("e"),
        F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.__bucket") == F.col("e.__bucket")),
    )
    groups = edge_rows.groupBy(F.col("d.source").alias("source"), F.col("__key")).agg(
        F.sum("__size").alias("__words"), F.count("*").alias("__ties"), F.first("__base").alias("__base")
    )
    cuts = border(groups, "__key").select(
        F.col("p.source").alias("source"),
        F.col("__key").alias("cut_key"),
        F.floor((F.col("__rest") - F.col("__start")) / F.col("__ties")).alias("cut_words"),
    )
    return plan.alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select(
        "t.source", "source_size", "target", "epochs", "cut_key", "cut_words"
    )


def _with_taken(keyed: DataFrame, thresholds: DataFrame) -> DataFrame:
    per_source = durable(thresholds.withColumnRenamed("source", "__source"), "mix-thresholds")
    if per_source.count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    joined = keyed.join(per_source, keyed["source"].eqNullSafe(per_source["__source"]), "left").drop("__source")
    partial = (
        F.when(F.col("__key") < F.col("cut_key"), F.col("__size"))
        .when(F.col("__key") == F.col("cut_key"), F.least("__size", "cut_words"))
        .otherwise(0)
    )
    return joined.withColumn("__partial", partial.cast("long")).withColumn(
        "taken", F.col("epochs") * F.col("__size") + F.col("__partial")
    )


def mix_plan(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken`` (and its sampling key)."""
    keyed = durable(with_sampling_key(docs.select("doc_id", "source", "text")).drop("text"), "mix-keys")
    taken = _with_taken(keyed, source_thresholds(keyed))
    return taken.select(
        "doc_id", F.col("__size").alias("size"), "source_size", "target", "taken", F.col("__key").alias("sampling_key")
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document once per whole epoch and once more if
    drawn; the border document's last copy has only its first words, joined by one space."""
    keyed = durable(with_sampling_key(docs.select("doc_id", "source", "text")).drop("text"), "mix-keys")
    whole = boxed(docs, **{c: F.col(f"row.{c}") for c in ("doc_id", "source", "text")})
    taken = _with_taken(with_sampling_key(whole).drop("doc_id", "text"), source_thresholds(keyed))
    copies = F.col("epochs") + F.when(F.col("__partial") > 0, 1).otherwise(0)
    dealt = taken.filter(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    cut = (F.col("__copy") > F.col("epochs")) & (F.col("__partial") < F.col("__size"))
    words = F.filter(F.split("row.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    shortened = F.array_join(F.slice(words, F.lit(1), F.col("__partial").cast("int")), " ")
    return unboxed(dealt.withColumn("shorter", F.when(cut, shortened)), docs, text="shorter")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


#: DuckDB finds size, source_size, target; ``taken`` depends on the sampling keys (see tests for brute force).
