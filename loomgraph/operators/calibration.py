"""Calibration of confidences by tier: approval by band, trailing trust, regression against earlier bands, trend of approval.

Decisions are rows of a tier with a score, whether they were approved, and a time. All steps are aggregates of few rows a tier; the trailing
window is a rank with a limit, of which tasks keep a window's rows a tier before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import wilson_interval
from loomgraph.operators.ordered import mann_kendall
from loomgraph.operators.signals import two_sided_p
from loomgraph.plans.model import Graph
from loomgraph.plans.registry import query

# Width of a band, least decisions of one that is judged, drop of its rate that counts, trailing decisions, least snapshots of a trend.
WIDTH, SPARSE, SENSITIVITY, WINDOW, SNAPSHOTS = 0.1, 5, 0.1, 50, 8


def tier_bands(decisions: DataFrame, tier: str, score: str, approved: Column, width: float = WIDTH) -> DataFrame:
    """(tier, band, n, approved, rate): every tier has all bands of [0, 1], the last one closed; an empty band has rate 0.

    Decisions without a tier, and those whose score is null or outside [0, 1], are in no band.
    """
    n = -int(-1 / width // 1)
    index = F.least(F.floor(F.round(F.col(score) / width, 9)), F.lit(n - 1)).cast("int")
    inside = F.col(score).between(0, 1)
    found = decisions.filter(F.col(tier).isNotNull()).groupBy(tier, F.when(inside, index).alias("band")).agg(F.count("*").alias("n"), F.count_if(approved).alias("approved"))
    # the tiers come out of the same aggregate, so decisions are read once; a band is empty where only the frame gives it
    frame = found.select(tier, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("band"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("approved"))
    summed = found.filter("band is not null").unionByName(frame).groupBy(tier, "band").agg(F.sum("n").alias("n"), F.sum("approved").alias("approved"))
    return summed.withColumn("rate", F.coalesce(F.try_divide("approved", "n"), F.lit(0.0)))


def band_regressions(bands: DataFrame, earlier: DataFrame, tier: str, sensitivity: float = SENSITIVITY, sparse: int = SPARSE) -> DataFrame:
    """``bands`` with ``historical`` (the rate in ``earlier``; 1 where that has no such band), ``lower`` and ``upper`` (Wilson, 95 %), ``threshold``
    (historical less ``sensitivity``, 0 at least), ``sparse`` and ``regression``: not sparse, and the lower end is under the threshold."""
    before = earlier.select(tier, "band", F.col("rate").alias("historical"))
    joined = bands.join(before, [tier, "band"], "left").withColumn("historical", F.coalesce("historical", F.lit(1.0)))
    low, high = wilson_interval(F.col("approved").cast("double"), F.nullif(F.col("n"), F.lit(0)).cast("double"))
    judged = joined.withColumn("sparse", F.col("n") < sparse).withColumns({
        "lower": F.when(F.col("sparse"), 0.0).otherwise(F.greatest(low, F.lit(0.0))),
        "upper": F.when(F.col("sparse"), 0.0).otherwise(F.least(high, F.lit(1.0))),
        "threshold": F.greatest(F.col("historical") - sensitivity, F.lit(0.0)),
    })
    return judged.withColumn("regression", ~F.col("sparse") & (F.col("lower") < F.col("threshold")))


def trailing_trust(decisions: DataFrame, tier: str, approved: Column, newest: list, window: int = WINDOW) -> DataFrame:
    """(tier, decisions, trust): all decisions of a tier, and the approved share of its last ``window`` ones (all, if it has fewer)."""
    place = F.row_number().over(Window.partitionBy(tier).orderBy(*newest))
    known = decisions.filter(F.col(tier).isNotNull())
    last = known.withColumn("__approved", F.coalesce(approved, F.lit(False))).withColumn("__place", place).filter(F.col("__place") <= window)
    trust = last.groupBy(tier).agg((F.count_if("__approved") / F.count("*")).alias("trust"))
    return known.groupBy(tier).agg(F.count("*").alias("decisions")).join(trust, tier)


def approval_trend(snapshots: DataFrame, tier: str, at: str, rate: str, least: int = SNAPSHOTS) -> DataFrame:
    """(tier, snapshots, direction, p, tau) of a tier's series of rates; under ``least`` points insufficient_data, with neither p nor tau."""
    known = snapshots.filter(F.col(tier).isNotNull() & F.col(at).isNotNull() & F.col(rate).isNotNull())
    tested = mann_kendall(known, [tier], at, rate)
    enough, n = F.col("n") >= least, F.col("n")
    direction = F.when(~enough, "insufficient_data").otherwise(F.replace(F.col("trend"), F.lit(" "), F.lit("_")))
    return tested.select(
        tier, F.col("n").alias("snapshots"), direction.alias("direction"), F.when(enough, two_sided_p(F.col("z"))).alias("p"), F.when(enough, F.col("s") / (n * (n - 1) / 2)).alias("tau")
    )


def tier_report(bands: DataFrame, trust: DataFrame, trend: DataFrame, tier: str) -> DataFrame:
    """One row a tier with decisions: trust, whether a band regressed and the lowest such band, and the trend (none: insufficient_data)."""
    fallen = bands.groupBy(tier).agg(F.bool_or("regression").alias("regression_detected"), F.min(F.when(F.col("regression"), F.col("band"))).alias("lowest_band"))
    joined = trust.join(fallen, tier, "left").join(trend, tier, "left")
    return joined.withColumns({
        "regression_detected": F.coalesce("regression_detected", F.lit(False)),
        "snapshots": F.coalesce("snapshots", F.lit(0).cast("long")),
        "direction": F.coalesce("direction", F.lit("insufficient_data")),
    })


_EARLIER = "created_on < DATE '1995-06-01'"
_BANDS_SQL = f"""k AS (SELECT module, range::INT AS band FROM (SELECT DISTINCT module FROM claims), range(10)),
    c AS (SELECT module, least(floor(round(confidence / 0.1, 9)), 9)::INT AS band, count(*) AS n, count(*) FILTER (verdict = 'SUPPORTED') AS a,
      count(*) FILTER ({_EARLIER}) AS n0, count(*) FILTER ({_EARLIER} AND verdict = 'SUPPORTED') AS a0 FROM claims GROUP BY 1, 2),
    r AS (SELECT module, band, coalesce(n, 0)::DOUBLE AS n, coalesce(a / nullif(n, 0), 0) AS rate, greatest(coalesce(a0 / nullif(n0, 0), 0) - 0.1::DOUBLE, 0) AS threshold FROM k LEFT JOIN c USING (module, band)),
    b AS (SELECT *, CASE WHEN n < 5 THEN false ELSE greatest((rate + 1.9208::DOUBLE / n - 1.96::DOUBLE * sqrt(rate * (1 - rate) / n + 0.9604::DOUBLE / (n * n))) / (1 + 3.8416::DOUBLE / n), 0) < threshold END AS regression FROM r)"""


def _judged_bands(g: Graph) -> DataFrame:
    approved = F.col("verdict") == "SUPPORTED"
    earlier = tier_bands(g.claims.filter(_EARLIER), "module", "confidence", approved)
    return band_regressions(tier_bands(g.claims, "module", "confidence", approved), earlier, "module")


@query("n11_band_regressions", f"WITH {_BANDS_SQL} SELECT module, band, n::BIGINT AS n, round(rate, 6) AS rate, round(threshold, 6) AS threshold, regression FROM b")
def _(g: Graph) -> DataFrame:
    return _judged_bands(g).select("module", "band", "n", F.round("rate", 6).alias("rate"), F.round("threshold", 6).alias("threshold"), "regression")


@query(
    "n11_tier_report",
    f"""WITH {_BANDS_SQL},
    t AS (SELECT module, count(*) AS decisions, round(count(*) FILTER (place <= 50 AND verdict = 'SUPPORTED') / count(*) FILTER (place <= 50), 6) AS trust
      FROM (SELECT module, verdict, row_number() OVER (PARTITION BY module ORDER BY created_on DESC, claim_id DESC) AS place FROM claims) GROUP BY 1),
    f AS (SELECT module, bool_or(regression) AS regression_detected, min(band) FILTER (regression) AS lowest_band FROM b GROUP BY 1),
    m AS (SELECT module, date_trunc('month', created_on) AS at, count(*) FILTER (verdict = 'SUPPORTED') / count(*) AS rate FROM claims GROUP BY 1, 2),
    s AS (SELECT a.module, sum(sign(b.rate - a.rate))::DOUBLE AS s FROM m a JOIN m b ON a.module = b.module AND a.at < b.at GROUP BY 1),
    v AS (SELECT module, sum(k)::DOUBLE AS n, sum(k * (k - 1) * (2 * k + 5))::DOUBLE AS ties FROM (SELECT module, rate, count(*) AS k FROM m GROUP BY 1, 2) GROUP BY 1),
    z AS (SELECT module, n, s, CASE WHEN s = 0 THEN 0 ELSE (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18) END AS z FROM s JOIN v USING (module))
    SELECT module, decisions, trust, regression_detected, lowest_band, n::BIGINT AS snapshots, round(s / (n * (n - 1) / 2), 6) AS tau,
      CASE WHEN n < 8 THEN 'insufficient_data' WHEN z > 1.959964 THEN 'increasing' WHEN z < -1.959964 THEN 'decreasing' ELSE 'no_trend' END AS direction
    FROM t JOIN f USING (module) JOIN z USING (module)""",
)
def _(g: Graph) -> DataFrame:
    approved = F.col("verdict") == "SUPPORTED"
    monthly = g.claims.groupBy("module", F.date_trunc("month", "created_on").alias("at")).agg((F.count_if(approved) / F.count("*")).alias("rate"))
    trust = trailing_trust(g.claims, "module", approved, [F.desc("created_on"), F.desc("claim_id")])
    report = tier_report(_judged_bands(g), trust, approval_trend(monthly, "module", "at", "rate"), "module")
    return report.select("module", "decisions", F.round("trust", 6).alias("trust"), "regression_detected", "lowest_band", "snapshots", F.round("tau", 6).alias("tau"), "direction")
