"""Directives: snapshots of how far each is realised, which stand still, and which cover a segment.

A criterion holds if its query found rows. For a strategic directive that is evidence for it; for an operational one its rows are
counter-evidence, of which samples are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.ordered import mann_kendall
from loomgraph.plans.model import Graph
from loomgraph.plans.registry import query

# The tiers, and when a directive stands still.
STRATEGIC, OPERATIONAL = "Strategic_Initiative", "Operational_Adjustment"
STALLED_VELOCITY, STALLED_DAYS, STALLED_POINTS = 0.005, 7, 3
ACCELERATING, STEADY = 0.5, 0.05


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each directive: directive_id, snapshot_at, progress, velocity."""
    last = F.max_by(F.struct("progress", "velocity"), "snapshot_at").alias("x")
    return snapshots.groupBy("directive_id").agg(F.max("snapshot_at").alias("snapshot_at"), last).select("directive_id", "snapshot_at", "x.progress", "x.velocity")


def realization_snapshots(directives: DataFrame, results: DataFrame, snapshots: DataFrame, at: Column) -> DataFrame:
    """One new snapshot for each active directive (directive_id, tier, status).

    ``results`` (directive_id, criterion_id, n_rows, n_samples, executed_at) are the criteria's queries, ``snapshots`` what was kept before. Progress is the share of
    criteria that hold; strategic directives without criteria have 0, operational ones none. Velocity is the change a day since the last snapshot, over a day at least.
    """
    holds = F.coalesce(F.col("n_rows") > 0, F.lit(False))
    counted = results.groupBy("directive_id").agg(
        F.count("*").alias("criteria"), F.count_if(holds).alias("held"), F.sum(F.when(holds, F.coalesce("n_samples", F.lit(0)))).alias("samples"),
        F.min(F.when(holds, F.col("executed_at"))).alias("first_seen"), F.max(F.when(holds, F.col("executed_at"))).alias("last_seen"),
    )
    before = latest_snapshots(snapshots).select("directive_id", F.col("snapshot_at").alias("__at"), F.col("progress").alias("__progress"))
    rows = directives.filter("status = 'active'").select("directive_id", "tier").join(counted, "directive_id", "left").join(before, "directive_id", "left")
    n, held = F.coalesce("criteria", F.lit(0)), F.coalesce("held", F.lit(0))
    strategic, operational = F.col("tier") == STRATEGIC, F.col("tier") == OPERATIONAL
    progress = F.when(n > 0, held / n).when(~operational, 0.0)
    days = (F.unix_timestamp(at) - F.unix_timestamp("__at")) / 86400
    return rows.withColumn("progress", progress).select(
        "directive_id", at.alias("snapshot_at"), "progress", ((F.col("progress") - F.col("__progress")) / F.greatest(F.lit(1.0), days)).alias("velocity"),
        F.when(strategic, held).alias("evidence_consistent"), F.when(operational, F.nullif(F.coalesce("samples", F.lit(0)), F.lit(0))).alias("evidence_counter"),
        F.when(operational, F.col("first_seen")).alias("first_evidence_at"), F.when(operational, F.col("last_seen")).alias("last_counter_evidence_at"),
        F.when(strategic, (n > 0) & (held == n)).alias("all_satisfied"),
    )


def stalled(directives: DataFrame, snapshots: DataFrame, now: Column) -> DataFrame:
    """(directive_id, is_stalled) of all ``directives`` (directive_id, status, status_at).

    Stalled is what is active, has been so for a week, has three velocities or more without a trend (neither rising nor falling), and a mean velocity near zero.
    """
    series = snapshots.filter("velocity is not null").select("directive_id", "snapshot_at", "velocity")
    trends = mann_kendall(series, ["directive_id"], "snapshot_at", "velocity").select("directive_id", "n", "trend")
    means = series.groupBy("directive_id").agg(F.avg("velocity").alias("mean"))
    joined = directives.join(trends, "directive_id", "left").join(means, "directive_id", "left")
    old = F.unix_timestamp(now) - F.unix_timestamp("status_at") >= STALLED_DAYS * 86400
    still = (F.col("n") >= STALLED_POINTS) & (F.col("trend") == "no trend") & (F.abs("mean") < STALLED_VELOCITY)
    return joined.select("directive_id", F.coalesce((F.col("status") == "active") & old & still, F.lit(False)).alias("is_stalled"))


def covering_directives(segments: DataFrame, directives: DataFrame, snapshots: DataFrame, visible: Column, now: Column) -> DataFrame:
    """Per segment (segment) the active directives that affect it and are visible, with the progress, velocity and its band of their last snapshot
    and whether they stand still (null without a snapshot). ``directives`` has an array ``segments``."""
    active = directives.filter((F.col("status") == "active") & F.coalesce(visible, F.lit(False)))
    affected = active.select("directive_id", "tier", F.explode(F.array_distinct("segments")).alias("segment"))
    latest, still = latest_snapshots(snapshots), stalled(directives, snapshots, now)
    found = segments.select("segment").distinct().join(affected, "segment").join(latest, "directive_id", "left").join(still, "directive_id", "left")
    v = F.col("velocity")
    band = F.when(v.isNull(), None).when(F.col("is_stalled") | (v == 0), "stalled").when(v >= ACCELERATING, "accelerating").when(v >= STEADY, "steady").otherwise("slowing")
    return found.select("segment", "directive_id", "tier", "progress", "velocity", band.alias("velocity_band"), F.when(F.col("snapshot_at").isNotNull(), F.col("is_stalled")).alias("is_stalled"))


def _directives(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Directives, results and earlier snapshots from parts, their line items and orders: a part is a directive, its lines are its criteria."""
    tier = F.when(F.col("p_partkey") % 2 == 0, STRATEGIC).otherwise(OPERATIONAL)
    segments = F.array(F.concat(F.lit("s"), F.col("p_size") % 7), F.concat(F.lit("s"), F.col("p_partkey") % 5))
    directives = g.table("part").select(F.col("p_partkey").alias("directive_id"), tier.alias("tier"), F.when(F.col("p_partkey") % 11 == 0, "closed").otherwise("active").alias("status"), segments.alias("segments"), F.lit("2020-01-01 00:00:00").cast("timestamp").alias("status_at"))
    lines = g.table("lineitem").filter("l_partkey % 13 <> 0")
    results = lines.select(F.col("l_partkey").alias("directive_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("criterion_id"), (F.col("l_quantity") - 25).cast("long").alias("n_rows"), F.col("l_linenumber").cast("long").alias("n_samples"), F.col("l_shipdate").cast("timestamp").alias("executed_at"))
    snapshots = g.table("part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("directive_id"), F.lit("2023-12-22 00:00:00").cast("timestamp").alias("snapshot_at"), (F.col("p_size") / 50.0).cast("double").alias("progress"), F.lit(None).cast("double").alias("velocity"))
    return directives, results, snapshots


_NOW = "2024-01-01 00:00:00"


@query(
    "n17_realization_snapshots",
    f"""WITH r AS (SELECT l_partkey AS id, count(*) AS n, count(*) FILTER (CAST(l_quantity - 25 AS BIGINT) > 0) AS held, sum(l_linenumber) FILTER (CAST(l_quantity - 25 AS BIGINT) > 0) AS samples,
      min(l_shipdate) FILTER (CAST(l_quantity - 25 AS BIGINT) > 0) AS a, max(l_shipdate) FILTER (CAST(l_quantity - 25 AS BIGINT) > 0) AS b FROM lineitem WHERE l_partkey % 13 <> 0 GROUP BY 1),
    d AS (SELECT p_partkey AS id, p_partkey % 2 = 0 AS strategic, CASE WHEN p_partkey % 3 <> 0 THEN p_size / 50.0::DOUBLE END AS old FROM part WHERE p_partkey % 11 <> 0),
    p AS (SELECT d.*, r.*, CASE WHEN r.n > 0 THEN held / n WHEN strategic THEN 0 END AS progress FROM d LEFT JOIN r ON d.id = r.id)
    SELECT id AS directive_id, round(progress, 6) AS progress, round((progress - old) / 10.0::DOUBLE, 6) AS velocity, CASE WHEN strategic THEN coalesce(held, 0) END AS evidence_consistent,
      CASE WHEN NOT strategic THEN nullif(coalesce(samples, 0), 0)::BIGINT END AS evidence_counter, CASE WHEN NOT strategic THEN a END AS first_evidence_at, CASE WHEN NOT strategic THEN b END AS last_counter_evidence_at,
      CASE WHEN strategic THEN coalesce(n > 0 AND held = n, false) END AS all_satisfied FROM p""",
)
def _(g: Graph) -> DataFrame:
    directives, results, snapshots = _directives(g)
    found = realization_snapshots(directives, results, snapshots, F.lit(_NOW).cast("timestamp")).drop("snapshot_at")
    dates = {c: F.col(c).cast("timestamp_ntz") for c in ("first_evidence_at", "last_counter_evidence_at")}
    return found.withColumns({"progress": F.round("progress", 6), "velocity": F.round("velocity", 6), **dates})


@query(
    "n18_covering_snapshots",
    """SELECT DISTINCT s.segment, p_partkey AS directive_id, CASE WHEN p_partkey % 2 = 0 THEN 'Strategic_Initiative' ELSE 'Operational_Adjustment' END AS tier,
      CASE WHEN p_partkey % 3 <> 0 THEN p_size / 50.0::DOUBLE END AS progress, CASE WHEN p_partkey % 3 <> 0 THEN false END AS is_stalled
    FROM (SELECT 's' || i AS segment FROM range(0, 7) t(i)) s JOIN part ON s.segment IN ('s' || p_size % 7, 's' || p_partkey % 5) WHERE p_partkey % 11 <> 0 AND p_partkey % 4 <> 1""",
)
def _(g: Graph) -> DataFrame:
    directives, _, snapshots = _directives(g)
    segments = directives.select(F.explode("segments").alias("segment"))
    found = covering_directives(segments, directives, snapshots, F.col("directive_id") % 4 != 1, F.lit(_NOW).cast("timestamp"))
    return found.drop("velocity", "velocity_band")
