"""Operator 4: quality rules with adaptive thresholds.

Per document a set of counts is taken from the whole text. Instead of fixed cutoffs, each rule
cuts at an outlier fence of its own language and source: the quartiles come from quantile
sketches. A sketch is a histogram over integers that keeps the leading ``SKETCH_BITS`` bits of a
value (relative error under 1/32), so it has a bounded number of cells whatever the data, two of
them merge by adding counts, and the aggregation is an ordinary grouped count with map-side
combine. Sketches of small groups are merged upward (source into language, language into all).

Defined results: null text has no words (all counts 0, base_failed); null language or source
is a group of its own; equal rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import chunks, table, texts_of
from loomgraph.session import durable

REPEAT_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
#: Leading bits that a sketch keeps of a value.
SKETCH_BITS = 6
#: Groups of language and source up to which their fences are broadcast; beyond it they are joined.
BROADCAST_GROUPS = 10_000
#: A group with fewer passing documents takes the thresholds of the next larger one.
MIN_GROUP = 30
#: Fences lie this many quartile ranges beyond the quartiles, plus a rule's margin.
FENCE = 3
#: Rule -> (value in thousandths of a word, margin in thousandths, whether a lower fence holds too).
RULES = {
    "symbols": ("1000 * n_symbols", 100, False),
    "dup_lines": ("1000 * n_dup_lines", 20, False),
    "repeats": ("1000 * n_repeat_words", 150, False),
    "capitals": ("1000 * n_capitals", 500, False),
    "word_length": ("1000 * word_chars", 2000, True),
}

METRICS_SCHEMA = (
    "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, n_capitals long"
)


def repeated_words(words: list) -> int:
    """Words covered by windows of five words that occur twice or more in the list."""
    windows = list(zip(*(words[k:] for k in range(REPEAT_WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    starts = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(REPEAT_WINDOW):
        covered[k : k + len(starts)] |= starts
    return int(covered.sum())


def text_metrics(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals of one text."""
    words = text.split()  # on bytes: exactly space and tab to carriage return
    joined = b"".join(words)
    word_chars = int((np.frombuffer(joined, np.int8) >= -64).sum())  # all but continuation bytes
    n_symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.split()]
    n_capitals = len(joined) - len(joined.translate(None, bytes(range(65, 91))))
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeated_words(words), n_capitals


def document_metrics(docs: DataFrame) -> DataFrame:
    """Counts per row of ``docs``, with its doc_id, lang and source."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = np.array([text_metrics(t) for t in texts_of(batch.column("text"))], dtype=np.int64).reshape(-1, 6)
            kept = [batch.column(c) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(rows[:, k]) for k in range(6))],
                names=["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals"],
            )

    given = docs.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")
    )
    return given.mapInArrow(measure, METRICS_SCHEMA).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def sketch_cell(value: Column) -> Column:
    """The value without all but its leading bits: the lower end of its cell."""
    drop = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def group_fences(measured: DataFrame) -> DataFrame:
    """Per (lang, source) and rule its ``low`` and ``high``, from merged sketches of passing documents."""
    values = F.array(
        *(
            F.struct(F.lit(rule).alias("rule"), F.expr(f"({value}) div greatest(n_words, 1)").alias("value"))
            for rule, (value, _, _) in RULES.items()
        )
    )
    cells = (
        measured.withColumn("__v", F.explode(values))
        .select("lang", "source", "base_failed", F.col("__v.rule").alias("rule"), sketch_cell(F.col("__v.value")).alias("cell"))
        .groupBy("lang", "source", "rule", "cell")
        .agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("n"))
    )
    cells = durable(cells, "quality-sketches")
    groups = cells.select("lang", "source", "rule").distinct()

    def quartiles(level: int, keys: list[str]) -> DataFrame:
        merged = cells.groupBy(*keys, "rule", "cell").agg(F.sum("n").alias("n"))
        ordered = Window.partitionBy(*keys, "rule").orderBy("cell")
        counted = merged.withColumn("__upto", F.sum("n").over(ordered)).withColumn(
            "__all", F.sum("n").over(Window.partitionBy(*keys, "rule"))
        )
        quartile = lambda k: F.min(F.when(4 * F.col("__upto") >= k * F.col("__all"), F.col("cell")))
        found = counted.groupBy(*keys, "rule").agg(
            quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("__all").alias("n")
        )
        return found.select(
            *(F.col(k).alias(f"__{k}") for k in keys), F.col("rule").alias("__rule"), F.struct("n", "q1", "q3").alias(f"level{level}")
        )

    fences = groups
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        merged = quartiles(level, keys)
        same = F.col("rule") == F.col("__rule")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        fences = fences.join(merged, same, "left").drop("__rule", *(f"__{k}" for k in keys))
    used = (
        F.when(F.col("level0.n") >= MIN_GROUP, F.col("level0"))
        .when(F.col("level1.n") >= MIN_GROUP, F.col("level1"))
        .otherwise(F.col("level2"))
    )
    margin = F.element_at(F.create_map(*chain(*((F.lit(r), F.lit(m)) for r, (_, m, _) in RULES.items()))), F.col("rule"))
    two_sided = F.col("rule").isin([r for r, (_, _, low) in RULES.items() if low])
    spread = FENCE * (F.col("__q.q3") - F.col("__q.q1")) + margin
    return fences.withColumn("__q", used).select(
        "lang",
        "source",
        "rule",
        F.when(two_sided, F.col("__q.q1") - spread).alias("low"),
        (F.col("__q.q3") + spread).alias("high"),
    )


def apply_quality_rules(docs: DataFrame) -> DataFrame:
    """Per document its counts, ``base_failed``, ``failed_rules`` and ``kept``."""
    measured = durable(document_metrics(docs), "quality-metrics")
    fences = group_fences(measured)
    wide = fences.groupBy(F.col("lang").alias("__lang"), F.col("source").alias("__source")).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", F.struct("low", "high")))).alias("__fences")
    )
    wide = durable(wide, "quality-fences")
    if wide.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        wide = F.broadcast(wide)
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    joined = measured.join(wide, same, "left")

    def broken(rule: str, value: str) -> Column:
        number, fence = F.expr(f"({value}) div greatest(n_words, 1)"), F.col("__fences")[rule]
        outside = (number > fence["high"]) | F.coalesce(number < fence["low"], F.lit(False))
        return F.when(outside, F.lit(rule))

    failed = F.array_compact(F.array(*(broken(rule, value) for rule, (value, _, _) in RULES.items())))
    return joined.withColumn("failed_rules", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_CASES = " UNION ALL ".join(
    f"SELECT lang, source, base_failed, '{rule}' AS rule, ({value}) // greatest(n_words, 1) AS v FROM m"
    for rule, (value, _, _) in RULES.items()
)
_MARGINS = " ".join(f"WHEN '{r}' THEN {m}" for r, (_, m, _) in RULES.items())
_LOW = ", ".join(f"'{r}'" for r, (_, _, low) in RULES.items() if low)


def _level(keys: list[str]) -> str:
    by = ", ".join([*keys, "rule"])
    return f"""SELECT {by}, max(total) AS n, min(cell) FILTER (4 * upto >= total) AS q1, min(cell) FILTER (4 * upto >= 3 * total) AS q3
      FROM (SELECT {by}, cell, sum(n) OVER (PARTITION BY {by} ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {by}) AS total
            FROM (SELECT {by}, cell, sum(n) AS n FROM cells GROUP BY {by}, cell)) GROUP BY {by}"""


OP4_SQL = f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
s AS (SELECT row_number() OVER () AS rid, * FROM w),
windows AS (
  SELECT rid, i, [words[i], words[i+1], words[i+2], words[i+3], words[i+4]] AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - {REPEAT_WINDOW - 2})) AS i FROM s)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range(0, {REPEAT_WINDOW}) r(k) GROUP BY rid),
c AS (
  SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
  FROM s LEFT JOIN covered USING (rid)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
vals AS ({_CASES}),
cells AS (
  SELECT lang, source, rule, (v >> greatest(length(bin(v)) - {SKETCH_BITS}, 0)) << greatest(length(bin(v)) - {SKETCH_BITS}, 0) AS cell,
         sum(CASE WHEN base_failed THEN 0 ELSE 1 END) AS n
  FROM vals GROUP BY ALL),
l0 AS ({_level(["lang", "source"])}), l1 AS ({_level(["lang"])}), l2 AS ({_level([])}),
f AS (
  SELECT g.lang, g.source, g.rule,
    CASE WHEN l0.n >= {MIN_GROUP} THEN l0.q1 WHEN l1.n >= {MIN_GROUP} THEN l1.q1 ELSE l2.q1 END AS q1,
    CASE WHEN l0.n >= {MIN_GROUP} THEN l0.q3 WHEN l1.n >= {MIN_GROUP} THEN l1.q3 ELSE l2.q3 END AS q3
  FROM (SELECT DISTINCT lang, source, rule FROM cells) g
  LEFT JOIN l0 ON g.rule = l0.rule AND g.lang IS NOT DISTINCT FROM l0.lang AND g.source IS NOT DISTINCT FROM l0.source
  LEFT JOIN l1 ON g.rule = l1.rule AND g.lang IS NOT DISTINCT FROM l1.lang
  LEFT JOIN l2 ON g.rule = l2.rule),
fence AS (
  SELECT lang, source, rule, CASE WHEN rule IN ({_LOW}) THEN q1 - spread END AS low, q3 + spread AS high
  FROM (SELECT *, {FENCE} * (q3 - q1) + CASE rule {_MARGINS} END AS spread FROM f)),
verdict AS (
  SELECT v.lang, v.source, v.rule, v.v, v.v > fence.high OR coalesce(v.v < fence.low, false) AS broken
  FROM (SELECT DISTINCT lang, source, rule, v FROM vals) v
  JOIN fence ON v.rule = fence.rule AND v.lang IS NOT DISTINCT FROM fence.lang AND v.source IS NOT DISTINCT FROM fence.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (
    SELECT 1 FROM verdict WHERE broken AND verdict.lang IS NOT DISTINCT FROM m.lang AND verdict.source IS NOT DISTINCT FROM m.source
    AND ({" OR ".join(f"(verdict.rule = '{r}' AND verdict.v = ({v}) // greatest(m.n_words, 1))" for r, (v, _, _) in RULES.items())})) AS kept
FROM m
"""
