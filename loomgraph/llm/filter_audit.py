"""Operator 11: interaction of filters by the Hart-Mas-Colell potential.

Five filters (FILTERS) remove documents. A coalition S of filters plays the removal game: its worth v(S) is the number of
documents that fail at least one of its filters. The potential of a coalition is defined recursively,

    P(empty) = 0,    P(S) = (v(S) + sum of P(S without i) over all i in S) / |S|,

and the Shapley value of filter i is P(all) - P(all without i). All 32 potentials of a part are computed by one
fold over its coalitions in ascending order, times 120, which makes every potential a whole number (the dividend of a
coalition of s filters enters it divided by s). Steps of an order need no replay either: what a filter
removes behind the coalition S is v(S with i) - v(S), what is kept is the number of documents minus v(S with i), what only
it fails is v(all) - v(all without i), and what it fails on its own is v(i); labelled losses are the same games over labelled documents.

Documents are read once, in tasks that give each its filters A to D and a digest of its text (256 bits). Filter E
(identical to an earlier document's text) needs the least id of each text: equal texts are counted
by part and label inside the tasks before they meet, with the count at their least id, so copies of one text in a third of all rows
cost one row per task. Only the 32 counts per part and label go further.

Defined results: null text is empty and equal to empty text; null lang is the empty string; a row without an id has no smaller id
before it and is before no other row, and has no labels; rows of one id and text are not copies of each other; an id
labelled twice is good or toxic if any label says so; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import chunks, table, texts_of

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
EVERY = (1 << len(FILTERS)) - 1
ORDERS = ["".join(p) for p in permutations(FILTERS)]
GAMES = ("all", "good", "toxic")


def text_failures(text: bytes, n_chars: int) -> int:
    """Bits 0 to 3: which of the filters A to D the text fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MAX_CAPITAL_PERCENT * n_chars) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def read_documents(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, part, failures of A to D, and the digest of the text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = texts_of(batch.column("text"))
            chars = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            columns = [
                batch.column("doc_id"),
                batch.column("part"),
                pa.array([text_failures(t, n) for t, n in zip(texts, chars)], pa.int32()),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "failed", "digest"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string"))
    return rows.mapInArrow(read, "doc_id long, part string, failed int, digest binary")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic (0 or 1). Rows without an id are dealt by their text, and meet no label."""
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled"), F.lit(0).cast("long").alias("unnamed"))
    marked = marked.agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(0))).withColumn(
        "u", F.when(F.col("doc_id").isNull(), F.xxhash64("digest").bitwiseOR(F.lit(1))).otherwise(F.lit(0)).cast("long")
    )
    met = rows.join(marked, (rows.k == marked.labelled) & (rows.u == marked.unnamed), "left")
    return met.select("k", "u", "doc_id", "part", "failed", "digest", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def failure_counts(rows: DataFrame) -> DataFrame:
    """part, failed (bits of all five filters), and the number of documents, of good and of toxic ones."""
    same = ["digest", "part", "failed", "good", "toxic"]
    # dealt by k and u already; rows of one id and text become one
    once = rows.groupBy("k", "u", "doc_id", *same).agg(F.count("*").alias("n"))
    named = F.when(F.col("doc_id").isNotNull(), F.col("n"))
    texts = once.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_unnamed"),
        F.min("doc_id").alias("least"),
        F.min_by(named, F.col("doc_id")).alias("n_least"),
    )
    # a text has few rows left here: one for each part and label at most
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    split = texts.withColumn("passes", F.col("n_unnamed") + F.when(first, F.col("n_least")).otherwise(0))
    copies = F.lit(1 << FILTERS.index("E"))
    both = F.array(F.struct(F.col("failed"), F.col("passes").alias("n")), F.struct(F.col("failed").bitwiseOR(copies).alias("failed"), (F.col("n") - F.col("passes")).alias("n")))
    one = split.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.failed", "x.n")
    return one.groupBy("part", "failed").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def coalition_worths(counts: DataFrame) -> DataFrame:
    """Per part, for each game an array of the 32 worths, at place S that of coalition S; and the number of documents."""

    def worth(game: str, coalition: int) -> Column:
        return F.sum(F.when(F.col("failed").bitwiseAND(F.lit(coalition)) != 0, F.col(game)).otherwise(0))

    arrays = [F.array(*(worth(game, s) for s in range(EVERY + 1))).alias(f"v_{game}") for game in GAMES]
    return counts.groupBy("part").agg(F.sum("all").alias("n"), *arrays)


def whole(quotient: Column) -> Column:
    """Exact for the numbers of a game: they are far below 2 ** 53 and divide without a rest."""
    return F.round(quotient).cast("long")


def potentials(worth: Column) -> Column:
    """The potentials of all coalitions times 120, in the order of ``worth``."""

    def step(known: Column, coalition: Column) -> Column:
        bits = F.filter(F.array(*(F.lit(1 << i) for i in range(len(FILTERS)))), lambda b: coalition.bitwiseAND(b) != 0)
        below = F.aggregate(bits, F.lit(0).cast("long"), lambda total, b: total + F.get(known, coalition.bitwiseXOR(b)))
        return F.concat(known, F.array(whole((F.get(worth, coalition) * len(ORDERS) + below) / F.size(bits))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(EVERY)), F.array(F.lit(0).cast("long")), step)


def filter_bit(order: Column, step: Column) -> Column:
    return F.element_at(F.array(*(F.lit(1 << i) for i in range(len(FILTERS)))), F.ascii(F.substring(order, step, F.lit(1))) - ord(FILTERS[0]) + 1)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    worths = coalition_worths(failure_counts(with_labels(read_documents(docs), labels)))
    games = worths.withColumn("potential", potentials(F.col("v_all")))
    orders = games.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    order, step = F.col("filter_order"), F.col("step")
    earlier = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda k: k < step), F.lit(0), lambda s, k: s.bitwiseOR(filter_bit(order, k)))
    steps = steps.withColumns({"own": filter_bit(order, step), "before": earlier})
    steps = steps.withColumns({"after": F.col("before").bitwiseOR(F.col("own")), "others": F.lit(EVERY).bitwiseXOR(F.col("own"))})

    def gain(array: str, upper: str | int, lower: str | int) -> Column:
        return F.get(array, F.col(upper) if isinstance(upper, str) else F.lit(upper)) - F.get(array, F.col(lower))

    removed = gain("v_all", "after", "before")
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("n") - F.get("v_all", F.col("after"))).alias("kept"),
        removed.alias("removed"),
        (F.get("v_all", F.col("own")) - removed).alias("redundant"),
        gain("v_all", EVERY, "others").alias("unique_fails"),
        gain("v_good", "after", "before").alias("good_lost"),
        gain("v_toxic", "after", "before").alias("toxic_lost"),
        gain("potential", EVERY, "others").alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
f AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, {{
      'A': len(words) < {MIN_WORDS}, 'B': 100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words),
      'C': 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > {MAX_CAPITAL_PERCENT} * length(d.text),
      'D': regexp_matches(d.text, '[#$%&*|]'), 'E': coalesce(d.doc_id > least, false)}} AS x
  FROM d JOIN firsts ON d.text = firsts.text LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, good, toxic, map(['A', 'B', 'C', 'D', 'E'], [x.A, x.B, x.C, x.D, x.E]) AS x, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT filter_order, s.step::INTEGER AS step, filter_order[s.step] AS c FROM orders, range(1, 6) s(step)),
played AS (
  SELECT m.part, filter_order, step, c, n, good, toxic, x[c] AS fails,
    len(list_filter(string_split(filter_order[1:step - 1], ''), lambda k: k <> '' AND x[k])) AS earlier,
    len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: x[k])) AS failed
  FROM m, steps),
r AS (
  SELECT part, filter_order, step, c,
    coalesce(sum(n) FILTER (NOT fails AND earlier = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails AND earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND earlier > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails AND failed = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n * good) FILTER (fails AND earlier = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(n * toxic) FILTER (fails AND earlier = 0), 0)::BIGINT AS toxic_lost
  FROM played GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley
FROM r
"""
