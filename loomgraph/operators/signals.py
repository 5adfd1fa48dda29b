"""Signals over time, correlation patterns, calibration, gap and divergence reports."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import sigma_strength
from loomgraph.operators.aggregates import first_of
from loomgraph.operators.graph_reads import band
from loomgraph.operators.ordered import mann_kendall, running_within
from loomgraph.plans.model import Graph
from loomgraph.plans.registry import query
from loomgraph.session import durable

TRIGGER, QUIET = 0.5, 0.3


def current_against_baseline(daily: DataFrame, keys: list[str], now: Column, current_days: int, baseline_days: int, sigma: float = 3.0) -> DataFrame:
    """Strength per key: mean of the current days against mean and deviation of the days before."""
    age = F.datediff(now, "day")
    fresh = (age >= 0) & (age < current_days)
    old = (age >= current_days) & (age < current_days + baseline_days)
    per = daily.groupBy(*keys).agg(
        F.avg(F.when(fresh, F.col("value"))).alias("current"), F.avg(F.when(old, F.col("value"))).alias("baseline"),
        F.stddev_pop(F.when(old, F.col("value"))).alias("deviation"), F.count_if(old).alias("n"),
    )
    return per.withColumn("strength", sigma_strength(F.col("current"), F.col("baseline"), F.coalesce("deviation", F.lit(0.0)), sigma))


def pattern(signals: DataFrame, group: str, rules: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Correlation patterns: every listed signal of the first list reaches TRIGGER and those of the second stay under QUIET."""
    names = sorted({s for loud, quiet in rules.values() for s in [*loud, *quiet]})
    wide = signals.groupBy(group).pivot("signal", names).agg(F.max("strength")).na.fill(0.0)
    fired = []
    for name, (loud, quiet) in rules.items():
        condition = F.lit(True)
        for s in loud:
            condition = condition & (F.col(s) >= TRIGGER)
        for s in quiet:
            condition = condition & (F.col(s) < QUIET)
        fired.append(F.when(condition, F.lit(name)))
    return wide.select(group, F.explode(F.array_compact(F.array(*fired))).alias("pattern"))


#: Chebyshev fit of the complementary error function, relative error below 1.2e-7, lowest power first.
ERFC_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided_p(z: Column) -> Column:
    """Probability of a normal deviate at least this far from 0."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    power = reduce(lambda tail, c: F.lit(c) + t * tail, reversed(ERFC_FIT), F.lit(0.0))
    return F.least(F.lit(1.0), t * F.exp(power - x * x))


def trend_strength(points: DataFrame, keys: list[str], order: str, value: str, direction: str, min_points: int = 10, alpha: float = 0.05) -> DataFrame:
    """Mann-Kendall per series of at least ``min_points``: p, and 1 - p as strength where it trends that way below ``alpha``, else 0."""
    tested = mann_kendall(points, keys, order, value).filter(F.col("n") >= min_points).withColumn("p", two_sided_p(F.col("z")))
    hit = (F.signum("z") == (1 if direction == "increasing" else -1)) & (F.col("p") < alpha)
    return tested.select(*keys, "n", "z", "p", F.when(hit, F.least(F.lit(1.0), 1 - F.col("p"))).otherwise(0.0).alias("strength"))


def trend_or_now(trend: DataFrame, now: DataFrame, module: str) -> DataFrame:
    """One row per module of either side: the greater of the trend's and the point-in-time strength, and both."""
    joined = trend.select(module, F.col("strength").alias("trend")).join(now.select(module, F.col("strength").alias("now")), module, "full")
    return joined.select(module, F.greatest("trend", "now").alias("strength"), "trend", "now")


def deprecation_signal(claims: DataFrame, module: str, kind: str, day: str, deprecated_use: Column, today: Column, window: int, now_days: int, threshold: int = 5) -> DataFrame:
    """Per module, the strongest falling type among its daily counts, or the most used deprecated type of late.

    The trend looks at counts of all claims of the window; the point in time at claims of the last ``now_days`` for which
    ``deprecated_use`` holds, whose largest count by type is divided by ``threshold``, to 1 at most. Modules without either give no row.
    """
    age = F.datediff(today, day)
    typed = claims.filter(F.col(kind).isNotNull() & (age >= 0))
    daily = typed.filter(F.col(module).isNotNull() & (age <= window)).groupBy(module, kind, day).agg(F.count("*").alias("y"))
    falling = trend_strength(daily, [module, kind], day, "y", "decreasing").filter("strength > 0")
    trend = falling.groupBy(module).agg(F.max("strength").alias("strength"))
    late = typed.filter(deprecated_use & (age <= now_days)).groupBy(F.coalesce(module, F.lit("__global__")).alias(module), kind).agg(F.count("*").alias("n"))
    now = late.groupBy(module).agg(F.least(F.lit(1.0), F.max("n") / threshold).alias("strength"))
    return trend_or_now(trend, now, module)


def failure_signal(runs: DataFrame, module: str, order: str, total: str, failing: str, min_points: int = 10) -> DataFrame:
    """Per module, the rising failure rate over its oldest runs, or the rate of the last of these.

    As many of the oldest runs as twice ``min_points``, 20 at least, are looked at; runs of nothing do not count.
    """
    numbered = runs.withColumn("__r", F.row_number().over(Window.partitionBy(module).orderBy(order))).filter(F.col("__r") <= max(20, 2 * min_points))
    rated = numbered.filter(F.col(total) > 0).withColumn("rate", F.coalesce(failing, F.lit(0)) / F.col(total))
    trend = trend_strength(rated, [module], order, "rate", "increasing", min_points)
    last = rated.groupBy(module).agg(F.max_by("rate", order).alias("rate"))
    now = last.filter("rate > 0").select(module, F.least(F.lit(1.0), F.col("rate")).alias("strength"))
    return trend_or_now(trend, now, module)


def run_detectors(spark: SparkSession, detectors: dict[str, Callable[[], DataFrame]], columns: str) -> tuple[DataFrame, DataFrame]:
    """Runs every detector as Spark jobs side by side: (records with their detector, one row of the run's status).

    A detector that fails takes its own records with it and no others; the status is success, partial_failure or error, and
    ``failures`` names who failed and why. ``columns`` is the schema all detectors return.
    """

    def run(name: str) -> tuple[DataFrame | None, str]:
        try:
            return durable(detectors[name]().selectExpr(*(c.split()[0] for c in columns.split(", "))), f"detector-{name}"), ""
        except Exception as problem:  # a detector's failure is a result here
            return None, f"{type(problem).__name__}: {problem}"[:500]

    with ThreadPoolExecutor(max_workers=max(1, min(8, len(detectors)))) as pool:
        found = dict(zip(detectors, pool.map(run, detectors)))
    parts = [df.withColumn("detector", F.lit(name)) for name, (df, _) in found.items() if df is not None]
    failures = {name: why for name, (df, why) in found.items() if df is None}
    status = "success" if not failures else "partial_failure" if parts else "error"
    records = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], columns + ", detector string")
    row = [(status, len(parts), len(failures), failures)]
    return records, spark.createDataFrame(row, "status string, succeeded int, failed int, failures map<string,string>")


@query(
    "n01_signal_trend",
    """WITH d AS (SELECT metric, day, count(*)::DOUBLE AS value FROM samples GROUP BY 1, 2), p AS (SELECT metric, avg(value) FILTER (DATE '2024-01-15' - day = 0) AS current, avg(value) FILTER (DATE '2024-01-15' - day BETWEEN 1 AND 14) AS baseline,
    stddev_pop(value) FILTER (DATE '2024-01-15' - day BETWEEN 1 AND 14) AS deviation FROM d GROUP BY 1)
    SELECT metric, round(current, 6) AS current, round(baseline, 6) AS baseline, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce((current - baseline - deviation) / nullif(baseline + deviation, 0), 0))), 6) AS strength FROM p""",
)
def _(g: Graph) -> DataFrame:
    daily = g.samples.groupBy("metric", "day").agg(F.count("*").cast("double").alias("value"))
    found = current_against_baseline(daily, ["metric"], F.lit("2024-01-15").cast("date"), 1, 14, 1.0)
    return found.select("metric", *(F.round(c, 6).alias(c) for c in ("current", "baseline", "strength")))


@query("n02_cross_type_collision", "SELECT module, least(1.0::DOUBLE, count(*) / 50.0::DOUBLE) AS strength FROM (SELECT module, subject FROM claims GROUP BY 1, 2 HAVING count(DISTINCT predicate) > 1) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    mixed = g.claims.groupBy("module", "subject").agg(F.countDistinct("predicate").alias("n")).filter("n > 1")
    return mixed.groupBy("module").agg(F.least(F.lit(1.0), F.count("*") / 50.0).alias("strength"))


@query(
    "n03_cooccurrence_without_edge",
    """WITH o AS (SELECT DISTINCT chunk_id, module, subject FROM claims), p AS (SELECT DISTINCT a.module, a.subject AS a, b.subject AS b FROM o a JOIN o b ON a.chunk_id = b.chunk_id AND a.module = b.module AND a.subject < b.subject),
    r AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges WHERE rel_type = 'supplies')
    SELECT module, count(*) AS pairs, round(avg(CASE WHEN r.a IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS strength FROM p LEFT JOIN r ON p.a = r.a AND p.b = r.b GROUP BY 1""",
)
def _(g: Graph) -> DataFrame:
    one = g.claims.select("chunk_id", "module", F.col("subject").alias("a")).distinct()
    pairs = one.join(one.withColumnRenamed("a", "b"), ["chunk_id", "module"]).filter("a < b").select("module", "a", "b").distinct()
    known = g.edges.filter("rel_type = 'supplies'").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.lit(1).alias("known")).distinct()
    joined = pairs.join(known, ["a", "b"], "left")
    return joined.groupBy("module").agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("known").isNull().cast("double")), 6).alias("strength"))


@query("n04_type_drift", "SELECT module, max(share) AS largest, round(max(share) - min(share), 6) AS drift FROM (SELECT module, predicate, round(count(*) / sum(count(*)) OVER (PARTITION BY module), 6) AS share FROM claims GROUP BY 1, 2) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    counted = g.claims.groupBy("module", "predicate").agg(F.count("*").alias("n"))
    share = counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("module")), 6))
    return share.groupBy("module").agg(F.max("share").alias("largest"), F.round(F.max("share") - F.min("share"), 6).alias("drift"))


@query("n05_deprecation_trend")
def _(g: Graph) -> DataFrame:
    daily = g.samples.filter("metric = 'error' OR metric = 'view'").groupBy("metric", "day").agg(F.count("*").alias("y"))
    return mann_kendall(daily, ["metric"], "day", "y").select("metric", "s", F.round("z", 6).alias("z"), "trend")


@query(
    "n08_correlation_patterns",
    """WITH s AS (SELECT module, max(CASE WHEN predicate = 'made_by' THEN x END) AS a, max(CASE WHEN predicate = 'sold_by' THEN x END) AS b, max(CASE WHEN predicate = 'shipped_by' THEN x END) AS c
      FROM (SELECT module, predicate, round(count(*) FILTER (verdict = 'INSUFFICIENT') / count(*), 6) AS x FROM claims GROUP BY 1, 2) GROUP BY 1)
    SELECT module, 'all_uncertain' AS pattern FROM s WHERE a >= 0.5 AND b >= 0.5 AND c >= 0.5 UNION ALL SELECT module, 'made_only' FROM s WHERE a >= 0.5 AND b < 0.3""",
)
def _(g: Graph) -> DataFrame:
    rate = F.round(F.count_if(F.col("verdict") == "INSUFFICIENT") / F.count("*"), 6)
    signals = g.claims.groupBy("module", F.col("predicate").alias("signal")).agg(rate.alias("strength"))
    return pattern(signals, "module", {"all_uncertain": (["made_by", "sold_by", "shipped_by"], []), "made_only": (["made_by"], ["sold_by"])})


#: Deviations that a change of a rate or latency must pass.
SIGMAS = 2.0


def diagnoses(signals: DataFrame, series: DataFrame, now: str, lookback_hours: float = 24.0, current_days: int = 1, baseline_days: int = 14, sigmas: float = SIGMAS, min_points: int = 10, emit: float = 0.0) -> DataFrame:
    """(pattern, module, strength) of the six correlation patterns that fire, strength from 0 to 1.

    ``signals`` (signal A to F, module, strength, detected_at, status): of each signal and module the latest of successful runs within the lookback counts.
    ``series`` (metric, module, at, value): hourly ``retrieval``, ``zero_results`` and ``latency_p95`` of the whole, daily ``throughput`` of modules. A change is the mean
    of the current days against mean and deviation of the baseline days. Patterns over the whole have module ``__global__``. A module
    without enough points of throughput counts as steady.
    """
    at = F.lit(now).cast("timestamp")
    fresh = signals.filter((F.col("status") == "success") & (F.col("detected_at") >= at - F.make_interval(hours=F.lit(int(lookback_hours)))))
    latest = fresh.groupBy("signal", "module").agg(F.max_by("strength", "detected_at").alias("s"))
    one = lambda c: F.coalesce(F.max(F.when(F.col("signal") == c, F.col("s"))), F.lit(0.0)).alias(c)
    modules = latest.groupBy("module").agg(*map(one, "ABCDEF"))
    within = lambda days: F.col("at") > at - F.make_interval(days=F.lit(days))
    changes = series.filter("metric <> 'throughput'").filter((F.col("at") <= at) & within(baseline_days)).groupBy("metric").agg(
        F.avg(F.when(within(current_days), F.col("value"))).alias("now"), F.avg("value").alias("base"), F.stddev_pop("value").alias("spread")
    )
    value = lambda m, c: F.coalesce(F.max(F.when(F.col("metric") == m, F.col(c))), F.lit(0.0)).alias(f"{m}_{c}")
    whole = changes.agg(*(value(m, c) for m in ("retrieval", "zero_results", "latency_p95") for c in ("now", "base", "spread")))  # one row
    known = modules.agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(f"max_{c}") for c in "ABCDEF"))  # one row
    top = F.broadcast(whole.crossJoin(known))  # one row
    daily = series.filter("metric = 'throughput'").filter((F.col("at") <= at) & within(baseline_days)).withColumn("y", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)))
    falling = mann_kendall(daily, ["module"], "at", "y").filter((F.col("trend") == "decreasing") & (F.col("n") >= min_points)).select("module", F.lit(True).alias("falling"))
    c = F.col
    share = lambda part, of: F.when(c(of) > 0, F.least(F.lit(1.0), part / c(of)))
    drop, rise, slow = c("retrieval_base") - c("retrieval_now"), c("zero_results_now") - c("zero_results_base"), c("latency_p95_now") - c("latency_p95_base")
    dropped = (drop >= sigmas * c("retrieval_spread")) & (c("retrieval_spread") > 0)
    risen = (rise > sigmas * c("zero_results_spread")) & (c("zero_results_spread") > 0)
    slower = (slow > sigmas * c("latency_p95_spread")) & (c("latency_p95_base") + sigmas * c("latency_p95_spread") > 0)
    loudest = F.greatest(*(c(f"max_{x}") for x in "ABCDEF"))
    local = modules.join(falling, "module", "left").crossJoin(top)
    fires = lambda name, when, strength: F.when(when, F.struct(F.lit(name).alias("pattern"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), strength)).alias("strength")))
    per_module = F.array(
        fires("schema_drift_per_module", (c("C") >= TRIGGER) & (c("D") >= TRIGGER), (c("C") + c("D")) / 2),
        fires("cq_regression_pre_extraction", (c("F") >= TRIGGER) & c("falling").isNull(), c("F")),
        fires("relationship_gap_propagation", (c("B") >= TRIGGER) & risen, (c("B") + F.coalesce(share(rise, "zero_results_base"), F.lit(1.0))) / 2),
        fires("ontology_constraint_conflict", (c("E") >= TRIGGER) & (c("B") >= TRIGGER), (c("E") + c("B")) / 2),
    )
    overall = F.array(
        fires("extraction_quality_problem", (c("max_A") >= TRIGGER) & dropped, (c("max_A") + F.coalesce(share(drop, "retrieval_base"), F.lit(0.0))) / 2),
        fires("graph_or_index_problem", slower & (loudest < QUIET), F.coalesce(share(slow, "latency_p95_base"), F.lit(1.0))),
    )
    shown = local.select("module", F.explode(per_module).alias("x")).unionByName(whole.crossJoin(known).select(F.lit("__global__").alias("module"), F.explode(overall).alias("x")))
    return shown.filter("x is not null").select("x.pattern", "module", "x.strength").filter(F.col("strength") >= emit)


@query("n08_six_patterns")
def _(g: Graph) -> DataFrame:
    """Signals of each module from its claims of the last days, series from the samples; no SQL, see the scenarios in the tests."""
    day = g.claims.agg(F.max("created_on").cast("timestamp").alias("t")).first().t
    spread = F.posexplode(F.array(*(F.pmod(F.xxhash64("module", F.lit(k)), F.lit(100)) / 100 for k in range(6))))
    rates = g.claims.groupBy("module", F.col("created_on").cast("timestamp").alias("detected_at")).agg(F.count("*").alias("n")).select("module", "detected_at", spread)
    signals = rates.select(F.substring(F.lit("ABCDEF"), F.col("pos") + 1, F.lit(1)).alias("signal"), "module", F.col("col").alias("strength"), "detected_at", F.lit("success").alias("status"))
    last = g.samples.agg(F.max("ts").alias("t")).first().t
    moved = F.col("at") + (F.lit(day) - F.lit(last))
    names = F.create_map(F.lit("click"), F.lit("retrieval"), F.lit("view"), F.lit("zero_results"))
    hourly = g.samples.groupBy(F.coalesce(F.try_element_at(names, F.col("metric")), F.lit("latency_p95")).alias("metric"), F.date_trunc("hour", "ts").alias("at")).agg(F.avg("value").alias("value"))
    series = hourly.select("metric", F.lit("__global__").alias("module"), moved.alias("at"), "value")
    daily = g.claims.groupBy("module", F.col("created_on").cast("timestamp").alias("at")).agg(F.count("*").cast("double").alias("value")).select(F.lit("throughput").alias("metric"), "module", "at", "value")
    return diagnoses(signals, series.unionByName(daily), str(day), lookback_hours=24 * 400, baseline_days=400)


@query("n10_signal_to_proposal", "SELECT module, predicate, round(least(1.0::DOUBLE, count(DISTINCT created_on) / 3.0::DOUBLE) * avg(confidence), 6) AS confidence FROM claims WHERE status = 'quarantined' GROUP BY 1, 2")
def _(g: Graph) -> DataFrame:
    score = F.least(F.lit(1.0), F.countDistinct("created_on") / 3.0) * F.avg("confidence")
    return g.claims.filter("status = 'quarantined'").groupBy("module", "predicate").agg(F.round(score, 6).alias("confidence"))


@query("n13_non_regression_gate", "SELECT module, CASE WHEN b >= 0.9 AND b >= a - 0.05 THEN 'pass' WHEN b >= a - 0.05 THEN 'differential' ELSE 'fail' END AS gate FROM (SELECT module, avg(confidence) FILTER (created_on < DATE '1995-01-01') AS a, avg(confidence) FILTER (created_on >= DATE '1995-01-01') AS b FROM claims GROUP BY 1)")
def _(g: Graph) -> DataFrame:
    cut = F.lit("1995-01-01").cast("date")
    means = g.claims.groupBy("module").agg(F.avg(F.when(F.col("created_on") < cut, F.col("confidence"))).alias("a"), F.avg(F.when(F.col("created_on") >= cut, F.col("confidence"))).alias("b"))
    holds = F.col("b") >= F.col("a") - 0.05
    return means.select("module", F.when((F.col("b") >= 0.9) & holds, "pass").when(holds, "differential").otherwise("fail").alias("gate"))


@query(
    "n14_gap_report",
    """SELECT v.entity_type, count(*) AS n, count(c.subject) AS evidenced, CASE WHEN count(c.subject) / count(*) >= 0.8 THEN 'covered' WHEN count(c.subject) / count(*) >= 0.5 THEN 'partial' ELSE 'gap' END AS grade
    FROM vertices v LEFT JOIN (SELECT DISTINCT subject FROM claims UNION SELECT DISTINCT object FROM claims) c ON v.entity_id = c.subject GROUP BY 1""",
)
def _(g: Graph) -> DataFrame:
    evidence = g.claims.select(F.col("subject").alias("entity_id")).union(g.claims.select("object")).distinct().withColumn("e", F.lit(1))
    counted = g.vertices.join(evidence, "entity_id", "left").groupBy("entity_type").agg(F.count("*").alias("n"), F.count("e").alias("evidenced"))
    return counted.withColumn("grade", band(F.col("evidenced") / F.col("n"), [(0.8, "covered"), (0.5, "partial")], "gap"))


@query("n16_documented_reality", "SELECT coalesce(origin, 'document') AS origin, entity_type, count(*) AS n, round(avg(confidence), 6) AS confidence FROM vertices WHERE deprecated = false GROUP BY 1, 2")
def _(g: Graph) -> DataFrame:
    from loomgraph.operators.graph_reads import live

    return live(g.vertices).groupBy(F.coalesce("origin", F.lit("document")).alias("origin"), "entity_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(
    "n17_directive_snapshots",
    """SELECT metric, day, n, round((n - lag(n) OVER (PARTITION BY metric ORDER BY day)) / 1.0::DOUBLE, 6) AS velocity, n >= 60 AS satisfied FROM (SELECT metric, day, count(*) AS n FROM samples GROUP BY 1, 2)
    QUALIFY lag(day) OVER (PARTITION BY metric ORDER BY day) IS NULL OR day - lag(day) OVER (PARTITION BY metric ORDER BY day) = 1""",
)
def _(g: Graph) -> DataFrame:
    daily = g.samples.groupBy("metric", "day").agg(F.count("*").alias("n"))
    w = Window.partitionBy("metric").orderBy("day")
    gap = F.datediff("day", F.lag("day").over(w))
    snap = daily.withColumn("velocity", F.round((F.col("n") - F.lag("n").over(w)).cast("double"), 6)).withColumn("gap", gap)
    return snap.filter("gap IS NULL OR gap = 1").select("metric", "day", "n", "velocity", (F.col("n") >= 60).alias("satisfied"))


@query("n19_readiness_gate", "SELECT module, count(*) FILTER (confidence >= 0.5) AS strong, CASE WHEN count(*) FILTER (confidence >= 0.5) >= 100 AND count(DISTINCT entity_type) >= 1 THEN 'ready' ELSE 'not_ready' END AS gate FROM vertices GROUP BY 1")
def _(g: Graph) -> DataFrame:
    strong = F.count_if(F.col("confidence") >= 0.5)
    ready = (strong >= 100) & (F.countDistinct("entity_type") >= 1)
    return g.vertices.groupBy("module").agg(strong.alias("strong"), F.when(ready, "ready").otherwise("not_ready").alias("gate"))


@query("n20_document_groups", "SELECT source, grp, count(*) AS n FROM (SELECT source, (coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 20000)::BIGINT AS grp FROM documents) GROUP BY 1, 2")
def _(g: Graph) -> DataFrame:
    placed = running_within(g.table("documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("doc_id")], F.col("n_chars"))
    grouped = placed.select("source", F.floor(F.col("before") / 20000).alias("grp"))
    return grouped.groupBy("source", "grp").agg(F.count("*").alias("n"))


@query("n21_evidence_bundle", "SELECT subject, count(*) AS n, array_to_string(list_slice(list_sort(list(claim_id)), 1, 10), ',') AS claims FROM claims WHERE verdict = 'SUPPORTED' GROUP BY 1")
def _(g: Graph) -> DataFrame:
    supported = g.claims.filter("verdict = 'SUPPORTED'").select("subject", "claim_id")
    return supported.groupBy("subject").agg(F.count("*").alias("n")).join(first_of(supported, "subject", "claim_id", 10).withColumnRenamed("first", "claims"), "subject")


@query("n22_progress_indicator", "SELECT round(count(*) FILTER (status = 'accepted') / count(*), 6) AS progress FROM claims")
def _(g: Graph) -> DataFrame:
    return g.claims.agg(F.round(F.count_if(F.col("status") == "accepted") / F.count("*"), 6).alias("progress"))


@query("n05_deprecation_signal")
def _(g: Graph) -> DataFrame:
    used = (F.col("status") == "quarantined") & (F.col("verdict") == "REFUTED")
    return deprecation_signal(g.claims, "module", "predicate", "created_on", used, F.lit("1995-06-01").cast("date"), 365, 30, 500)


@query("n07_failure_signal")
def _(g: Graph) -> DataFrame:
    runs = g.samples.groupBy("metric", "day").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("failing"))
    return failure_signal(runs, "metric", "day", "total", "failing")


@query(
    "n09_detector_run",
    """SELECT 'refuted' AS detector, module, round(count(*) FILTER (verdict = 'REFUTED') / count(*), 6) AS strength, 'partial_failure' AS status FROM claims GROUP BY 2
    UNION ALL SELECT 'uncertain', module, round(count(*) FILTER (verdict = 'INSUFFICIENT') / count(*), 6), 'partial_failure' FROM claims GROUP BY 2""",
)
def _(g: Graph) -> DataFrame:
    rate = lambda v: g.claims.groupBy("module").agg(F.round(F.count_if(F.col("verdict") == v) / F.count("*"), 6).alias("strength"))
    detectors = {"refuted": lambda: rate("REFUTED"), "uncertain": lambda: rate("INSUFFICIENT"), "broken": lambda: g.table("no_such_table")}
    records, status = run_detectors(g.spark, detectors, "module string, strength double")
    return records.crossJoin(F.broadcast(status.select("status")))  # one row


@query("n06_domain_range_violations", "SELECT module, count(*) FILTER (predicate = 'made_by' AND amount > 40) AS violations, round(count(*) FILTER (predicate = 'made_by' AND amount > 40) / count(*), 6) AS rate FROM claims GROUP BY 1")
def _(g: Graph) -> DataFrame:
    wrong = F.count_if((F.col("predicate") == "made_by") & (F.col("amount") > 40))
    return g.claims.groupBy("module").agg(wrong.alias("violations"), F.round(wrong / F.count("*"), 6).alias("rate"))


@query("n07_failure_rate_trend")
def _(g: Graph) -> DataFrame:
    daily = g.samples.groupBy("metric", "day").agg((F.count_if(F.col("value") > 50) / F.count("*")).alias("rate"))
    return mann_kendall(daily, ["metric"], "day", "rate").select("metric", "n", "trend")


@query("n12_autonomy_tick", "SELECT claim_id FROM claims WHERE status = 'quarantined' AND confidence >= 0.9 AND created_on < DATE '1995-06-01' - 30 AND verdict <> 'REFUTED'")
def _(g: Graph) -> DataFrame:
    cooled = F.col("created_on") < F.date_sub(F.lit("1995-06-01").cast("date"), 30)
    return g.claims.filter((F.col("status") == "quarantined") & (F.col("confidence") >= 0.9) & cooled & (F.col("verdict") != "REFUTED")).select("claim_id")


@query(
    "n15_divergence_map",
    "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'only_b' WHEN b.k IS NULL THEN 'only_a' WHEN a.n <> b.n THEN 'contradictory' ELSE 'consensus' END AS bucket FROM (SELECT subject AS k, count(*) AS n FROM claims WHERE status = 'accepted' GROUP BY 1) a FULL JOIN (SELECT subject AS k, count(*) AS n FROM claims WHERE status = 'quarantined' GROUP BY 1) b ON a.k = b.k",
)
def _(g: Graph) -> DataFrame:
    from loomgraph.operators.ontology import diff

    side = lambda s: g.claims.filter(F.col("status") == s).groupBy(F.col("subject").alias("k")).agg(F.count("*").alias("n"))
    bucket = F.element_at(F.create_map(*map(F.lit, ("added", "only_b", "removed", "only_a", "modified", "contradictory", "unchanged", "consensus"))), F.col("change"))
    return diff(side("accepted"), side("quarantined"), ["k"], ["n"]).select("k", bucket.alias("bucket"))


@query("n18_covering_directives", "SELECT d.document, e.rel_type FROM (SELECT document, list(DISTINCT rel_type) AS rels FROM edges GROUP BY 1) d JOIN (SELECT DISTINCT rel_type FROM edges) e ON list_contains(d.rels, e.rel_type)")
def _(g: Graph) -> DataFrame:
    covered = g.edges.groupBy("document").agg(F.collect_set("rel_type").alias("rels"))
    return covered.select("document", F.explode("rels").alias("rel_type"))
