"""Grouped reports over the graph, claims, messages and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph_reads import incidence, live
from loomgraph.operators.ordered import running_within
from loomgraph.plans.model import Graph
from loomgraph.plans.registry import query
from loomgraph.session import durable


def type_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    v = live(vertices).groupBy(F.col("entity_type").alias("type")).agg(F.count("*").alias("n"))
    e = live(edges).groupBy(F.col("rel_type").alias("type")).agg(F.count("*").alias("n"))
    return v.union(e)


def health_report(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: totals, edges per vertex, deprecated counts, live vertices without an edge and their share of all."""
    per_id = incidence(vertices, edges)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    one = per_id.agg(
        *map(total, ("n_vertices", "deprecated_vertices", "n_edges", "deprecated_edges")), F.count_if((F.col("n_live") > 0) & (F.col("n_ends") == 0)).alias("orphans")
    )
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    return one.withColumns({"edge_vertex_ratio": ratio("n_edges", "n_vertices"), "orphan_rate": ratio("orphans", "n_vertices")})


def relationship_coverage(vertices: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per relation and source type: edges, distinct sources, and their share of the type, thinnest first.

    A source's edges are one row before they meet its vertex; with ``tasks`` sources are dealt to so many, and are not sent again.
    """
    dealt = lambda df: df if tasks is None else df.repartition(tasks, "source")
    named = dealt(live(vertices).select(F.col("entity_id").alias("source"), "entity_type"))
    known = durable(named.groupBy("source", "entity_type").agg(F.count("*").alias("copies")), "vertices")  # used twice
    counted = dealt(live(edges).select("rel_type", "source")).groupBy("source", "rel_type").agg(F.count("*").alias("n"))
    typed = counted.join(dealt(known), "source")
    covered = typed.groupBy("rel_type", "entity_type").agg(F.count("*").alias("covered"), F.sum(F.col("n") * F.col("copies")).alias("n_edges"))
    totals = known.groupBy("entity_type").agg(F.sum("copies").alias("total"))
    percent = F.round(100.0 * F.col("covered") / F.col("total"), 4)
    return covered.join(totals, "entity_type").withColumn("percent", percent).orderBy(F.asc_nulls_last("percent"), "rel_type", "entity_type")


def with_tail(counts: DataFrame, name: str, n: int) -> DataFrame:
    """The ``n`` largest rows of (name, count), the rest summed as ``_other_``."""
    rank = F.row_number().over(Window.orderBy(F.desc("n"), F.col(name)))
    ranked = counts.withColumn("__rank", rank)
    return ranked.groupBy(F.when(F.col("__rank") <= n, F.col(name)).otherwise("_other_").alias(name)).agg(F.sum("n").alias("n")).filter("n > 0")


def first_of(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, first): the k least values of each key, joined by commas. Tasks keep k a key before anything is shuffled."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(value))
    kept = rows.filter(F.col(value).isNotNull()).select(key, value).withColumn("__place", place).filter(F.col("__place") <= k)
    return kept.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias("first"))


def bucket_counts(samples: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Per key the cumulative counts of values up to each of the ascending bounds, and of all (``+Inf``): an array ``le``."""
    return samples.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.array(*(F.count_if(F.col(value) <= b) for b in bounds), F.count("*")).alias("le"))


def bucket_quantile(counts: Column, bounds: list[float], q: float) -> Column:
    """The quantile of cumulative bucket counts by linear interpolation inside its bucket.

    The first bucket begins at 0 if its bound is above that, else its bound is the answer; in the last one, ``+Inf``, the answer is the bound before it; no values
    give null.
    """
    edges = F.array(*(F.lit(float(b)) for b in bounds))
    rank = q * F.element_at(counts, -1)
    at = F.array_position(F.transform(counts, lambda c: c >= rank), True).cast("int")
    upper, lower = F.get(edges, at - 1), F.coalesce(F.get(edges, at - 2), F.lit(0.0))
    below = F.coalesce(F.get(counts, at - 2), F.lit(0))
    inside = lower + (upper - lower) * F.try_divide(rank - below, F.get(counts, at - 1) - below)
    first = F.when((at == 1) & (upper <= 0), upper).otherwise(F.coalesce(inside, upper))
    return F.when(F.element_at(counts, -1) > 0, F.when(at > len(bounds), F.lit(float(bounds[-1]))).otherwise(first))


def daily_sketches(samples: DataFrame, keys: list[str], value: str, distinct: str) -> DataFrame:
    """A quantile sketch and a distinct-count sketch per key and day, to be stored and merged over any days."""
    return samples.groupBy(*keys, "day").agg(F.kll_sketch_agg_double(value).alias("quantiles"), F.hll_sketch_agg(distinct).alias("distinct"), F.count("*").alias("n"))


def merged_sketches(sketches: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Per key the approximate quantile and number of distinct values of the days given, from their sketches alone."""
    both = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("quantiles").alias("k"), F.hll_union_agg("distinct").alias("h"), F.sum("n").alias("n"))
    return both.select(*keys, F.kll_sketch_get_quantile_double("k", F.lit(q)).alias("quantile"), F.hll_sketch_estimate("h").alias("n_distinct"), "n")


def noisy_or(weight: Column) -> Column:
    """1 - prod(1 - w) as an aggregate; a weight of one gives one."""
    return 1.0 - F.product(1.0 - weight)


def counter_rate(samples: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Per series the increase over the window per second, with counter resets added back."""
    before = F.lag("value").over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
    step = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    return samples.withColumn("__step", step).groupBy(*keys).agg((F.sum("__step") / seconds).alias("rate"))


def confidence_bands(rows: DataFrame, score: str, approved: Column, width: float = 0.1) -> DataFrame:
    """Approval per band of equal width over [0, 1], the last one closed; empty bands count zero."""
    n = round(1 / width)
    spark = rows.sparkSession
    bands = spark.range(n).select(F.col("id").cast("int").alias("band"))
    index = F.least(F.floor(F.round(F.col(score) / width, 9)), F.lit(n - 1)).cast("int")
    counted = rows.groupBy(index.alias("band")).agg(F.count("*").alias("n"), F.count_if(approved).alias("approved"))
    joined = bands.join(counted, "band", "left").na.fill(0, ["n", "approved"])
    return joined.withColumn("rate", F.round(F.try_divide(F.col("approved"), F.col("n")), 6))


def nearest_rank(values: DataFrame, keys: list[str], order: list, last: int, q: float) -> DataFrame:
    """Nearest-rank quantile of the last rows per key."""
    recent = values.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__r") <= last)
    ranked = recent.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("value"))).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    return ranked.filter(F.col("__k") == F.greatest(F.ceil(q * F.col("__n")), F.lit(1))).select(*keys, F.col("value").alias("quantile"))


@query("a01_type_counts", "SELECT entity_type AS type, count(*) AS n FROM vertices WHERE deprecated = false GROUP BY 1 UNION ALL SELECT rel_type, count(*) FROM edges WHERE deprecated = false GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return type_counts(g.vertices, g.edges)


@query(
    "a02_graph_health_report",
    """WITH v AS (SELECT count(*) AS n_vertices, count(*) FILTER (deprecated) AS deprecated_vertices FROM vertices),
    e AS (SELECT count(*) AS n_edges, count(*) FILTER (deprecated) AS deprecated_edges FROM edges),
    o AS (SELECT count(*) AS orphans FROM vertices WHERE deprecated = false AND entity_id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges))
    SELECT *, round(n_edges / n_vertices, 6) AS edge_vertex_ratio, round(orphans / n_vertices, 6) AS orphan_rate FROM v, e, o""",
)
def _(g: Graph) -> DataFrame:
    return health_report(g.vertices, g.edges)


@query("a03_ranked_edge_targets", "SELECT v.name AS target_name, count(*) AS n FROM edges e JOIN vertices v ON e.target = v.entity_id WHERE e.rel_type = 'located_in' AND v.name IS NOT NULL GROUP BY 1")
def _(g: Graph) -> DataFrame:
    named = g.vertices.filter("name IS NOT NULL").select(F.col("entity_id").alias("target"), F.col("name").alias("target_name"))
    return g.edges.filter("rel_type = 'located_in'").join(named, "target").groupBy("target_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_name")


@query(
    "a04_relationship_coverage",
    """SELECT e.rel_type, v.entity_type, count(DISTINCT e.source) AS covered, count(*) AS n_edges, t.total, round(100.0::DOUBLE * count(DISTINCT e.source) / t.total, 4) AS percent
    FROM edges e JOIN vertices v ON e.source = v.entity_id JOIN (SELECT entity_type, count(*) AS total FROM vertices WHERE deprecated = false GROUP BY 1) t ON v.entity_type = t.entity_type
    WHERE e.deprecated = false AND v.deprecated = false GROUP BY e.rel_type, v.entity_type, t.total""",
)
def _(g: Graph) -> DataFrame:
    return relationship_coverage(g.vertices, g.edges, g.tasks("lineitem", "orders"))


@query("a05_count_by_segment", "SELECT coalesce(CASE WHEN module = 'geo' THEN NULL ELSE module END, '_unclassified') AS segment, count(*) AS n FROM vertices GROUP BY 1")
def _(g: Graph) -> DataFrame:
    segment = F.coalesce(F.when(F.col("module") != "geo", F.col("module")), F.lit("_unclassified"))
    return g.vertices.groupBy(segment.alias("segment")).agg(F.count("*").alias("n"))


@query("a06_top_types_by_origin", "SELECT entity_type, count(*) AS n FROM vertices WHERE coalesce(origin, 'document') = 'document' GROUP BY 1 ORDER BY n DESC, entity_type LIMIT 10")
def _(g: Graph) -> DataFrame:
    kept = g.vertices.filter(F.coalesce("origin", F.lit("document")) == "document")
    return kept.groupBy("entity_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type").limit(10)


@query("a07_origin_breakdown", "SELECT coalesce(origin, 'document') AS origin, count(*) AS n FROM vertices GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return g.vertices.groupBy(F.coalesce("origin", F.lit("document")).alias("origin")).agg(F.count("*").alias("n"))


@query(
    "a08_top_n_with_tail",
    "SELECT CASE WHEN rn <= 5 THEN module ELSE '_other_' END AS module, sum(n)::BIGINT AS n FROM (SELECT module, n, row_number() OVER (ORDER BY n DESC, module) AS rn FROM (SELECT module, count(*) AS n FROM vertices GROUP BY 1)) GROUP BY 1",
)
def _(g: Graph) -> DataFrame:
    return with_tail(g.vertices.groupBy("module").agg(F.count("*").alias("n")), "module", 5)


@query("a09_top_types_in_window", "SELECT predicate, count(*) AS n FROM claims WHERE created_on >= DATE '1995-01-01' AND created_on < DATE '1996-01-01' GROUP BY 1 ORDER BY n DESC, predicate LIMIT 5")
def _(g: Graph) -> DataFrame:
    window = g.claims.filter("created_on >= DATE '1995-01-01' AND created_on < DATE '1996-01-01'")
    return window.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate").limit(5)


@query("a10_collect_distinct_per_name", "SELECT subject, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS predicates, count(DISTINCT object) AS n_objects, count(*) AS n FROM claims GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return g.claims.groupBy("subject").agg(
        F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("predicates"), F.countDistinct("object").alias("n_objects"), F.count("*").alias("n")
    )


@query("a12_daily_counts", "SELECT module, predicate, created_on AS day, count(*) AS n FROM claims GROUP BY 1, 2, 3")
def _(g: Graph) -> DataFrame:
    return g.claims.groupBy("module", "predicate", F.col("created_on").alias("day")).agg(F.count("*").alias("n"))


@query("a13_quarantined_counts", "SELECT module, count(*) AS n FROM claims WHERE status = 'quarantined' AND (confidence < 0.2 OR amount > 45) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    rules = F.array_compact(F.array(F.when(F.col("confidence") < 0.2, "low_confidence"), F.when(F.col("amount") > 45, "range")))
    return g.claims.filter("status = 'quarantined'").filter(F.exists(rules, lambda r: r.isNotNull())).groupBy("module").agg(F.count("*").alias("n"))


@query(
    "a14_counter_rate",
    """SELECT metric, round(sum(step) / 2592000, 9) AS rate FROM (SELECT metric, CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END AS step
    FROM (SELECT metric, value, lag(value) OVER (PARTITION BY metric, label ORDER BY ts, event_id) AS b FROM samples)) GROUP BY 1""",
)
def _(g: Graph) -> DataFrame:
    rates = counter_rate(g.samples, ["metric", "label"], 2592000.0)
    return rates.groupBy("metric").agg(F.round(F.sum("rate"), 9).alias("rate"))


@query("a15_quantile_per_metric", "SELECT metric, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.5), 6) AS p50 FROM samples GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return g.samples.groupBy("metric").agg(F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.percentile("value", 0.5), 6).alias("p50"))


_BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0]


@query(
    "a15_bucket_quantile",
    f"""WITH c AS (SELECT metric, [{", ".join(f"count(*) FILTER (value <= {b})" for b in _BOUNDS)}, count(*)] AS le FROM samples WHERE value IS NOT NULL GROUP BY 1),
    p AS (SELECT metric, le, 0.95::DOUBLE * le[-1] AS rank, {_BOUNDS}::DOUBLE[] AS b FROM c),
    i AS (SELECT *, list_position(list_transform(le, lambda x: x >= rank), true) AS k FROM p)
    SELECT metric, round(CASE WHEN k > {len(_BOUNDS)} THEN b[-1] ELSE coalesce(b[k - 1], 0) + (b[k] - coalesce(b[k - 1], 0)) * (rank - coalesce(le[k - 1], 0)) / (le[k] - coalesce(le[k - 1], 0)) END, 6) AS p95 FROM i""",
)
def _(g: Graph) -> DataFrame:
    counted = bucket_counts(g.samples, ["metric"], "value", _BOUNDS)
    return counted.select("metric", F.round(bucket_quantile(F.col("le"), _BOUNDS, 0.95), 6).alias("p95"))


@query("a57_sketch_rollup")
def _(g: Graph) -> DataFrame:
    stored = durable(daily_sketches(g.samples, ["metric"], "value", "user_id"), "sketches")
    return merged_sketches(stored, ["metric"], 0.95)


@query("a16_avg_stddev_over_time", "SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation FROM (SELECT metric, date_trunc('hour', ts) AS h, avg(value) AS v FROM samples GROUP BY 1, 2) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    hourly = g.samples.groupBy("metric", F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("v"))
    return hourly.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("deviation"))


@query(
    "a17_rolling_nearest_rank",
    """SELECT metric, value AS quantile FROM (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value) AS k, count(*) OVER (PARTITION BY metric) AS n
    FROM (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS r FROM samples) WHERE r <= 100) WHERE k = greatest(ceil(0.95 * n), 1)""",
)
def _(g: Graph) -> DataFrame:
    return nearest_rank(g.samples, ["metric"], [F.desc("ts"), F.desc("event_id")], 100, 0.95)


@query("a18_resolution_stats", "SELECT verdict AS tier, count(*) AS n, round(avg(confidence), 6) AS similarity, round(count(*) FILTER (status = 'accepted') / count(*), 6) AS matched FROM claims GROUP BY 1")
def _(g: Graph) -> DataFrame:
    matched = F.count_if(F.col("status") == "accepted") / F.count("*")
    return g.claims.groupBy(F.col("verdict").alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("similarity"), F.round(matched, 6).alias("matched"))


@query(
    "a19_corpus_summary",
    "SELECT source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, array_to_string(list_slice(list_sort(list(doc_id)), 1, 5), ',') AS first_docs FROM documents GROUP BY 1",
)
def _(g: Graph) -> DataFrame:
    docs = g.table("documents").select("source", "doc_id", "n_chars")
    counted = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    first = first_of(docs, "source", "doc_id", 5).withColumnsRenamed({"source": "__source", "first": "first_docs"})
    return counted.join(first, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


@query("a20_counts_by_several", "SELECT verdict, status, count(*) AS n FROM claims GROUP BY GROUPING SETS ((verdict), (status), ())")
def _(g: Graph) -> DataFrame:
    return g.claims.groupingSets([["verdict"], ["status"], []], "verdict", "status").agg(F.count("*").alias("n"))


@query("a21_rollup_counts", "SELECT module, predicate, count(*) AS n FROM claims GROUP BY ROLLUP (module, predicate)")
def _(g: Graph) -> DataFrame:
    return g.claims.rollup("module", "predicate").agg(F.count("*").alias("n"))


@query("a22_decision_pivot", "SELECT predicate, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'quarantined') AS quarantined FROM claims GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return g.claims.groupBy("predicate").pivot("status", ["accepted", "quarantined"]).count().na.fill(0)


@query("a23_processing_summary", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest, count(*) FILTER (n_chars = 0) AS empty FROM documents GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return g.table("documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.count_if(F.col("n_chars") == 0).alias("empty")
    )


@query(
    "a24_calibration_bands",
    """SELECT b.band, coalesce(c.n, 0) AS n, coalesce(c.approved, 0) AS approved, CASE WHEN coalesce(c.n, 0) > 0 THEN round(c.approved / c.n, 6) END AS rate
    FROM (SELECT range::INT AS band FROM range(10)) b LEFT JOIN (SELECT least(floor(round(confidence / 0.1, 9)), 9)::INT AS band, count(*) AS n, count(*) FILTER (status = 'accepted') AS approved
    FROM claims GROUP BY 1) c USING (band)""",
)
def _(g: Graph) -> DataFrame:
    return confidence_bands(g.claims, "confidence", F.col("status") == "accepted")


@query(
    "a25_trailing_trust",
    "SELECT module, round(avg(ok), 6) AS trust FROM (SELECT module, CASE WHEN status = 'accepted' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ok, row_number() OVER (PARTITION BY module ORDER BY created_on DESC, claim_id DESC) AS r FROM claims) WHERE r <= 50 GROUP BY 1",
)
def _(g: Graph) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("module").orderBy(F.desc("created_on"), F.desc("claim_id")))
    recent = g.claims.withColumn("__r", r).filter("__r <= 50")
    return recent.groupBy("module").agg(F.round(F.avg((F.col("status") == "accepted").cast("double")), 6).alias("trust"))


@query(
    "a26_pass_rate",
    "SELECT module, count(*) FILTER (verdict = 'SUPPORTED') AS passed, count(*) FILTER (verdict = 'REFUTED') AS failed, count(*) FILTER (verdict = 'INSUFFICIENT') AS out_of_scope, round(count(*) FILTER (verdict = 'SUPPORTED') / nullif(count(*) FILTER (verdict <> 'INSUFFICIENT'), 0), 6) AS rate FROM claims GROUP BY 1",
)
def _(g: Graph) -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v)
    return g.claims.groupBy("module").agg(
        n("SUPPORTED").alias("passed"), n("REFUTED").alias("failed"), n("INSUFFICIENT").alias("out_of_scope"),
        F.round(F.try_divide(n("SUPPORTED"), F.count_if(F.col("verdict") != "INSUFFICIENT")), 6).alias("rate"),
    )


@query("a27_gap_summary", "SELECT verdict, CASE WHEN confidence < 0.3 THEN 'high' ELSE 'low' END AS severity, count(*) AS n FROM claims WHERE status = 'quarantined' GROUP BY 1, 2")
def _(g: Graph) -> DataFrame:
    severity = F.when(F.col("confidence") < 0.3, "high").otherwise("low")
    return g.claims.filter("status = 'quarantined'").groupBy("verdict", severity.alias("severity")).agg(F.count("*").alias("n"))


@query("a28_progress", "SELECT document_id, round(avg(CASE WHEN status = 'accepted' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS progress, bool_and(status = 'accepted') AS complete FROM claims GROUP BY 1")
def _(g: Graph) -> DataFrame:
    ok = F.col("status") == "accepted"
    return g.claims.groupBy("document_id").agg(F.round(F.avg(ok.cast("double")), 6).alias("progress"), F.bool_and(ok).alias("complete"))


@query("a30_tag_union_per_thread", "SELECT thread, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM (SELECT thread, unnest(['t' || (turn % 3), 'all']) AS tag FROM messages) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    tags = F.array(F.concat(F.lit("t"), (F.col("turn") % 3).cast("string")), F.lit("all"))
    return g.messages.groupBy("thread").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(tags)))), ",").alias("tags"))


@query("a31_sender_counts", "SELECT sender, count(*) AS n FROM messages GROUP BY 1 HAVING count(*) >= 5")
def _(g: Graph) -> DataFrame:
    return g.messages.groupBy("sender").agg(F.count("*").alias("n")).filter("n >= 5")


@query(
    "a32_top_objects_per_subject",
    "SELECT subject, object, n FROM (SELECT subject, object, count(*) AS n, row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, object) AS r FROM claims GROUP BY 1, 2) WHERE r <= 10",
)
def _(g: Graph) -> DataFrame:
    counted = g.claims.groupBy("subject", "object").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("n"), "object"))
    return counted.withColumn("r", r).filter("r <= 10").drop("r")


@query("a33_majority_vote", "SELECT subject, verdict FROM (SELECT subject, verdict, row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, min(claim_id)) AS r FROM claims GROUP BY 1, 2) WHERE r = 1")
def _(g: Graph) -> DataFrame:
    votes = g.claims.groupBy("subject", "verdict").agg(F.count("*").alias("n"), F.min("claim_id").alias("first"))
    r = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("n"), "first"))
    return votes.withColumn("r", r).filter("r = 1").select("subject", "verdict")


@query("a34_noisy_or", "SELECT subject, round(1 - product(1 - 0.5 * confidence), 6) AS score FROM claims GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return g.claims.groupBy("subject").agg(F.round(noisy_or(0.5 * F.col("confidence")), 6).alias("score"))


@query(
    "a35_corroboration",
    """SELECT subject, round(1 - product(1 - 0.7 * confidence), 6) AS score, count(DISTINCT object) AS n_sources,
    CASE WHEN count(DISTINCT object) >= 2 AND round(1 - product(1 - 0.7 * confidence), 6) >= 0.85 THEN 'first_class' ELSE 'provisional' END AS status FROM claims WHERE verdict <> 'REFUTED' GROUP BY 1""",
)
def _(g: Graph) -> DataFrame:
    from loomgraph.operators.claims import corroborate

    return corroborate(g.claims.filter("verdict <> 'REFUTED'"), "subject", "object", F.lit(0.7) * F.col("confidence"))


@query("a36_centroids", "SELECT label, pos::INT AS pos, round(avg(v::DOUBLE), 5) AS mean FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2")
def _(g: Graph) -> DataFrame:
    from loomgraph.operators.retrieval import centroids

    return centroids(g.table("embeddings"), "label", "embedding").select("label", "pos", F.round("mean", 5).alias("mean"))


@query("a44_compression_ratio", "SELECT document_id, round(sum(amount) / nullif(count(DISTINCT subject) + count(*), 0), 6) AS ratio FROM claims GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return g.claims.groupBy("document_id").agg(F.round(F.try_divide(F.sum("amount"), F.countDistinct("subject") + F.count("*")), 6).alias("ratio"))


@query("a46_rank_buckets", "SELECT CASE WHEN r = 1 THEN 'top1' WHEN r <= 5 THEN 'top5' WHEN r <= 10 THEN 'top10' ELSE 'tail' END AS bucket, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY module ORDER BY confidence DESC, claim_id) AS r FROM claims) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    numbered = running_within(g.claims.select("module", "confidence", "claim_id"), ["module"], [F.desc("confidence"), F.col("claim_id")])
    bucket = F.when(F.col("r") == 1, "top1").when(F.col("r") <= 5, "top5").when(F.col("r") <= 10, "top10").otherwise("tail")
    return numbered.withColumnRenamed("row_number", "r").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("a48_strongest_per_type", "SELECT predicate, max(confidence) AS strongest, min(claim_id) AS claim_id FROM claims c WHERE confidence = (SELECT max(confidence) FROM claims d WHERE d.predicate = c.predicate) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    best = g.claims.groupBy("predicate").agg(F.max("confidence").alias("strongest"))
    return g.claims.join(best, ["predicate"]).filter("confidence = strongest").groupBy("predicate", "strongest").agg(F.min("claim_id").alias("claim_id"))


@query(
    "a49_folder_summary",
    "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS folder, count(*) AS n, sum(length(html))::BIGINT AS size, min(page_id) AS first_page, max(page_id) AS last_page FROM pages GROUP BY 1",
)
def _(g: Graph) -> DataFrame:
    folder = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return g.table("pages").groupBy(folder.alias("folder")).agg(
        F.count("*").alias("n"), F.sum(F.length("html")).alias("size"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page")
    )


@query("a50_status_durations", "SELECT user_id, event_type, sum(d)::BIGINT AS seconds FROM (SELECT user_id, event_type, date_diff('second', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM (SELECT user_id, event_type, date_trunc('second', ts) AS ts, event_id FROM events)) WHERE d IS NOT NULL GROUP BY 1, 2")
def _(g: Graph) -> DataFrame:
    events = g.table("events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    spent = F.unix_timestamp(after) - F.unix_timestamp("ts")
    return events.withColumn("d", spent).filter("d IS NOT NULL").groupBy("user_id", "event_type").agg(F.sum("d").alias("seconds"))


@query("a58_recurrence", "SELECT predicate, module, count(DISTINCT document_id) AS recurrence FROM claims GROUP BY 1, 2")
def _(g: Graph) -> DataFrame:
    return g.claims.groupBy("predicate", "module").agg(F.countDistinct("document_id").alias("recurrence"))


@query("a60_state_counts", "SELECT coalesce(CASE WHEN turn = 0 THEN NULL ELSE 'triaged' END, 'untriaged') AS state, count(*) AS n, max(turn) AS max_cycle FROM messages GROUP BY 1")
def _(g: Graph) -> DataFrame:
    state = F.coalesce(F.when(F.col("turn") > 0, "triaged"), F.lit("untriaged"))
    return g.messages.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.max("turn").alias("max_cycle"))


@query(
    "a62_extraction_metrics",
    """SELECT module, count(*) AS n_claims, round(count(*) FILTER (status = 'accepted') / count(*), 6) AS parse_success, round(count(*) FILTER (predicate IN ('made_by', 'sold_by')) / count(*), 6) AS legal_rate,
    round((count(*) - count(DISTINCT subject || predicate || object)) / count(*), 6) AS duplicate_rate, round(avg(confidence), 6) AS mean_confidence FROM claims GROUP BY 1""",
)
def _(g: Graph) -> DataFrame:
    distinct = F.countDistinct(F.concat("subject", "predicate", "object"))
    return g.claims.groupBy("module").agg(
        F.count("*").alias("n_claims"),
        F.round(F.count_if(F.col("status") == "accepted") / F.count("*"), 6).alias("parse_success"),
        F.round(F.count_if(F.col("predicate").isin("made_by", "sold_by")) / F.count("*"), 6).alias("legal_rate"),
        F.round((F.count("*") - distinct) / F.count("*"), 6).alias("duplicate_rate"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )


@query(
    "a29_permission_report",
    "SELECT tag, count(*) AS n_rules, count(DISTINCT cluster) AS n_clusters, count(*) FILTER (denied) AS n_denied FROM (SELECT unnest(CASE WHEN n_nationkey % 4 = 0 THEN ['pii', 'legal'] WHEN n_nationkey % 4 = 1 THEN ['pii'] ELSE [] END) AS tag, n_regionkey AS cluster, n_nationkey % 3 = 0 AS denied FROM nation) GROUP BY 1",
)
def _(g: Graph) -> DataFrame:
    tags = F.when(F.col("n_nationkey") % 4 == 0, F.array(F.lit("pii"), F.lit("legal"))).when(F.col("n_nationkey") % 4 == 1, F.array(F.lit("pii")))
    rules = g.table("nation").select(F.explode(tags).alias("tag"), F.col("n_regionkey").alias("cluster"), (F.col("n_nationkey") % 3 == 0).alias("denied"))
    return rules.groupBy("tag").agg(F.count("*").alias("n_rules"), F.countDistinct("cluster").alias("n_clusters"), F.count_if("denied").alias("n_denied"))


def provenance_tag(passes: Column) -> Column:
    """The tag of an element found by these passes (an array; ``seed`` is one of them)."""
    seed, n = F.array_contains(passes, "seed"), F.size(F.filter(F.array_distinct(passes), lambda p: p != "seed"))
    return (
        F.when(seed & (n >= 3), "seed+3pass").when(seed & (n == 2), "seed+2pass").when(seed & (n == 1), "seed+1pass").when(seed, "seed_only")
        .when(n >= 3, "3pass_novel").when(n == 2, "2pass_novel").otherwise("1pass_only")
    )


def agreement_confidence(passes: Column) -> Column:
    """1 for three passes, 0.67 for two, 0.33 for fewer; 0.1 more with the seed, 1 at most."""
    n = F.size(F.filter(F.array_distinct(passes), lambda p: p != "seed"))
    base = F.when(n >= 3, 1.0).when(n == 2, 0.67).otherwise(0.33)
    return F.round(F.least(F.lit(1.0), base + F.when(F.array_contains(passes, "seed"), 0.1).otherwise(0.0)), 2)


def schema_element_counts(schema: Column) -> tuple[Column, Column]:
    """Entity and relationship types of a schema in JSON: keys of ``entity_types``, or of ``$defs`` without those, and of ``relationships``."""
    keys = lambda path: F.json_object_keys(F.get_json_object(schema, path))
    return F.size(F.coalesce(keys("$.entity_types"), keys("$['$defs']"), F.array())), F.size(F.coalesce(keys("$.relationships"), F.array()))


@query(
    "a39_provenance_agreement",
    """SELECT subject, CASE WHEN s AND n >= 3 THEN 'seed+3pass' WHEN s AND n = 2 THEN 'seed+2pass' WHEN s AND n = 1 THEN 'seed+1pass' WHEN s THEN 'seed_only' WHEN n >= 3 THEN '3pass_novel' WHEN n = 2 THEN '2pass_novel' ELSE '1pass_only' END AS provenance,
    round(least(1.0::DOUBLE, CASE WHEN n >= 3 THEN 1.0 WHEN n = 2 THEN 0.67 ELSE 0.33 END + CASE WHEN s THEN 0.1 ELSE 0 END), 2) AS confidence
    FROM (SELECT subject, bool_or(module = 'm0') AS s, count(DISTINCT predicate) FILTER (module <> 'm0') AS n FROM claims GROUP BY 1)""",
)
def _(g: Graph) -> DataFrame:
    passes = F.collect_set(F.when(F.col("module") == "m0", "seed").otherwise(F.col("predicate")))
    found = g.claims.groupBy("subject").agg(passes.alias("p"))
    return found.select("subject", provenance_tag(F.col("p")).alias("provenance"), agreement_confidence(F.col("p")).alias("confidence"))


@query("a52_schema_element_counts", "SELECT p_brand AS brand, count(DISTINCT p_type) AS entity_types, CASE WHEN p_brand LIKE '%1' THEN 0 ELSE count(DISTINCT p_size) END AS relationship_types FROM part GROUP BY 1")
def _(g: Graph) -> DataFrame:
    listed = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(F.collect_set(c), lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('": {}'))), ", "), F.lit("}"))
    parts = g.table("part").groupBy(F.col("p_brand").alias("brand")).agg(listed("p_type").alias("t"), listed("p_size").alias("r"))
    whole = F.concat(F.lit('{"entity_types": '), "t", F.lit(', "relationships": '), "r", F.lit("}"))
    schema = F.when(F.col("brand").endswith("1"), F.concat(F.lit('{"$defs": '), "t", F.lit("}"))).otherwise(whole)
    entities, relations = schema_element_counts(F.col("schema"))
    return parts.withColumn("schema", schema).select("brand", entities.cast("long").alias("entity_types"), relations.cast("long").alias("relationship_types"))


@query("a38_agreement_tier", "SELECT subject, CASE count(DISTINCT predicate) WHEN 3 THEN 'full' WHEN 2 THEN 'majority' ELSE 'single' END AS tier FROM claims GROUP BY 1")
def _(g: Graph) -> DataFrame:
    n = F.size(F.collect_set("predicate"))
    return g.claims.groupBy("subject").agg(F.when(n == 3, "full").when(n == 2, "majority").otherwise("single").alias("tier"))


@query("a40_coverage_matrix", "SELECT v.entity_id, CASE WHEN count(c.claim_id) = 0 THEN 'uncovered' WHEN bool_and(c.status = 'accepted') THEN 'covered' ELSE 'partial' END AS coverage FROM vertices v LEFT JOIN claims c ON c.subject = v.entity_id WHERE v.entity_type = 'part' GROUP BY 1")
def _(g: Graph) -> DataFrame:
    parts = g.vertices.filter("entity_type = 'part'").select("entity_id")
    joined = parts.join(g.claims.select(F.col("subject").alias("entity_id"), "claim_id", "status"), "entity_id", "left")
    coverage = F.when(F.count("claim_id") == 0, "uncovered").when(F.bool_and(F.col("status") == "accepted"), "covered").otherwise("partial")
    return joined.groupBy("entity_id").agg(coverage.alias("coverage"))


@query("a42_relationship_merge", "SELECT document, rel_type, count(*) AS n, count(DISTINCT source) AS sources, max(confidence) AS confidence FROM edges GROUP BY 1, 2")
def _(g: Graph) -> DataFrame:
    return g.edges.groupBy("document", "rel_type").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.max("confidence").alias("confidence"))


@query("a43_retention", "SELECT document_id, round(avg(CASE WHEN verdict = 'SUPPORTED' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS retention FROM claims GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return g.claims.groupBy("document_id").agg(F.round(F.avg((F.col("verdict") == "SUPPORTED").cast("double")), 6).alias("retention"))


@query("a45_strategy_contributions", "SELECT strategy, count(*) AS n FROM (SELECT unnest(CASE WHEN confidence > 0.5 AND amount > 25 THEN ['graph', 'vector'] WHEN confidence > 0.5 THEN ['graph'] ELSE ['lexical'] END) AS strategy FROM claims) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    graph = F.col("confidence") > 0.5
    used = F.when(graph & (F.col("amount") > 25), F.array(F.lit("graph"), F.lit("vector"))).when(graph, F.array(F.lit("graph"))).otherwise(F.array(F.lit("lexical")))
    return g.claims.select(F.explode(used).alias("strategy")).groupBy("strategy").agg(F.count("*").alias("n"))


@query("a47_multi_hop_proxy", "SELECT module, round(avg(CASE WHEN ordinal >= 2 THEN 1.0::DOUBLE ELSE 0 END + 0.5 * CASE WHEN amount >= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS score FROM claims GROUP BY 1")
def _(g: Graph) -> DataFrame:
    score = (F.col("ordinal") >= 2).cast("double") + 0.5 * (F.col("amount") >= 2).cast("double")
    return g.claims.groupBy("module").agg(F.round(F.avg(score), 6).alias("score"))


@query("a51_signal_combinations", "SELECT array_to_string(list_sort(list(DISTINCT predicate)), '+') AS combination, count(*) AS n_rows FROM claims GROUP BY document_id".replace("SELECT array", "SELECT combination, count(*) AS n FROM (SELECT array").replace("GROUP BY document_id", "GROUP BY document_id) GROUP BY 1"))
def _(g: Graph) -> DataFrame:
    per = g.claims.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("predicate")), "+").alias("combination"))
    return per.groupBy("combination").agg(F.count("*").alias("n"))


@query("a53_queue_depth", "SELECT CASE WHEN confidence >= 0.8 THEN 1 WHEN confidence >= 0.5 THEN 2 ELSE 3 END AS tier, count(*) AS depth FROM claims WHERE status = 'quarantined' GROUP BY 1")
def _(g: Graph) -> DataFrame:
    tier = F.when(F.col("confidence") >= 0.8, 1).when(F.col("confidence") >= 0.5, 2).otherwise(3)
    return g.claims.filter("status = 'quarantined'").groupBy(tier.alias("tier")).agg(F.count("*").alias("depth"))


@query("a54_distribution_check", "SELECT lang, round(count(*) / sum(count(*)) OVER (), 6) AS share, abs(count(*) / sum(count(*)) OVER () - 0.25) <= 0.05 AS balanced FROM documents GROUP BY 1")
def _(g: Graph) -> DataFrame:
    counted = g.table("documents").groupBy("lang").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counted.withColumn("s", share).select("lang", F.round("s", 6).alias("share"), (F.abs(F.col("s") - 0.25) <= 0.05).alias("balanced"))


@query("a61_coverage_rate", "SELECT module, round(avg(CASE WHEN predicate IN ('made_by') OR subject_type IN ('supplier') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS coverage FROM claims GROUP BY 1")
def _(g: Graph) -> DataFrame:
    covered = F.arrays_overlap(F.array("subject_type"), F.array(F.lit("supplier"))) | F.arrays_overlap(F.array("predicate"), F.array(F.lit("made_by")))
    return g.claims.groupBy("module").agg(F.round(F.avg(covered.cast("double")), 6).alias("coverage"))


@query("a63_cluster_summary", "SELECT label, count(*) AS size, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return g.table("embeddings").groupBy("label").agg(F.count("*").alias("size"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))
