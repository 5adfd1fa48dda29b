"""Window functions, ordered analytics, top-k, paging and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph_reads import live
from loomgraph.operators.joins import latest_per
from loomgraph.plans.model import Graph
from loomgraph.plans.registry import query
from loomgraph.session import durable


#: Rows, about, that one task sorts to number them.
ROWS_IN_RANGE = 1 << 20


def keep_newest(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbours: key, run number, value, first and last position and length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    flagged = df.withColumn("__c", changed).withColumn("run", F.sum("__c").over(w))
    return flagged.groupBy(*keys, "run", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length"))


def velocity(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Change per day since the row before; less than a day counts as one."""
    w = Window.partitionBy(*keys).orderBy(at)
    days = F.greatest(F.lit(1.0), F.datediff(F.col(at), F.lag(at).over(w)).cast("double"))
    return df.withColumn("velocity", (F.col(value) - F.lag(value).over(w)) / days)


def moving_type_token_ratio(words: Column, width: int = 50) -> Column:
    """Mean over all windows of the share of distinct words; short texts use the whole, empty ones give 0."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))
    shares = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(words, i, width))) / F.lit(float(width)))
    mean = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / F.size(shares)
    return F.when(n == 0, 0.0).when(n < width, F.size(F.array_distinct(words)) / n).otherwise(mean)


def mann_kendall(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Mann-Kendall S, tie-corrected variance, z and trend per key.

    Series are short (days of a signal); values are compared inside an array per key.
    """
    pairs = lambda xs: F.aggregate(
        F.transform(xs, lambda x, i: F.aggregate(F.slice(xs, i + 2, F.size(xs)), F.lit(0.0), lambda a, y: a + F.signum(y - x))), F.lit(0.0), lambda a, s: a + s
    )
    series = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("__s"))
    xs = F.transform("__s", lambda r: r[value].cast("double"))
    series = series.withColumn("__x", xs).withColumn("n", F.size("__x").cast("long")).withColumn("s", pairs(F.col("__x")))
    sizes = F.transform(F.array_distinct("__x"), lambda x: F.size(F.filter("__x", lambda y: y == x)).cast("double"))
    ties = F.aggregate(sizes, F.lit(0.0), lambda a, t: a + t * (t - 1) * (2 * t + 5))
    n = F.col("n").cast("double")
    series = series.withColumn("variance", (n * (n - 1) * (2 * n + 5) - ties) / 18)
    z = F.when((F.col("s") == 0) | (F.col("variance") <= 0), 0.0).otherwise((F.col("s") - F.signum("s")) / F.sqrt("variance"))
    trend = F.when(F.col("z") > 1.959964, "increasing").when(F.col("z") < -1.959964, "decreasing").otherwise("no trend")
    return series.withColumn("z", z).withColumn("trend", trend).drop("__s", "__x")


def share_capped_top(df: DataFrame, keys: list[str], capped: Column, k: int, share: float, *order) -> DataFrame:
    """The best k rows per key of which at most ceil(k * share) are capped; places left are filled with the rest."""
    import math

    cap = math.ceil(k * share)
    ranked = df.withColumn("__capped", capped).withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__capped").orderBy(*order)))
    # none after the first k of its kind is among the best k, so tasks keep k of each before anything is shuffled
    ranked = ranked.filter(F.col("__n") <= k)
    late = F.when(F.col("__capped") & (F.col("__n") > cap), 1).otherwise(0)
    chosen = ranked.withColumn("__late", late)
    r = F.row_number().over(Window.partitionBy(*keys).orderBy("__late", *order))
    return chosen.withColumn("position", r).filter(F.col("position") <= k).drop("__capped", "__n", "__late")


def page_after(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """Keyset paging: the next ``size`` rows after a key."""
    return (df.filter(F.col(key) > F.lit(after)) if after is not None else df).orderBy(key).limit(size)


def global_row_number(df: DataFrame, *order) -> DataFrame:
    """``row_number`` over all rows without one task seeing them all: ranges are numbered and shifted by the
    sizes of the ranges before them (one small row per range)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    shifts = F.broadcast(sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__shift")))  # a row per shuffle partition
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__local", local).join(shifts, "__range").withColumn("row_number", F.col("__local") + F.col("__shift")).drop("__range", "__local", "__shift")


def running_within(df: DataFrame, keys: list[str], order: list, value: Column | None = None) -> DataFrame:
    """Per key in the given order ``row_number``, ``dense_rank``, ``n`` (rows of the key) and ``before`` (sum of ``value`` over the rows before; null
    values add nothing), whatever the size of a key: ranges of all rows, about ROWS_IN_RANGE each, are counted on their own and shifted by those before them."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_IN_RANGE))
    valued = df.withColumn("__v", F.coalesce(value, F.lit(0)) if value is not None else F.lit(0))
    ranged = durable(valued.repartitionByRange(n, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    local = Window.partitionBy("__range", *keys).orderBy(*order)
    ranked = ranged.repartition(n, "__range", *keys).withColumns({"__d": F.dense_rank().over(local), "__r": F.row_number().over(local), "__b": F.coalesce(F.sum("__v").over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    # equal places of the order share a range, so distinct ones add up
    sizes = ranked.groupBy("__range", *keys).agg(F.count("*").alias("__n"), F.max("__d").alias("__nd"), F.sum("__v").alias("__s"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        F.col("__range").alias("__at"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.sum("__n").over(Window.partitionBy(*keys)).alias("n"),
        *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("__n", "__nd", "__s")),
    )
    same = F.col("__range") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    met = ranked.join(shifts, same)
    added = {"row_number": F.col("__r") + F.col("__n"), "dense_rank": F.col("__d") + F.col("__nd"), "before": F.col("__b") + F.col("__s")}
    return met.withColumns(added).select(*df.columns, "row_number", "dense_rank", "n", "before")


def balanced_groups(df: DataFrame, size: str, key: str, n_groups: int) -> DataFrame:
    """Round-robin over the rows from largest to smallest."""
    numbered = global_row_number(df, F.desc(size), F.col(key))
    return numbered.withColumn("group", ((F.col("row_number") - 1) % n_groups).cast("int")).drop("row_number")


@query("w01_keep_newest", "SELECT subject, claim_id FROM (SELECT subject, claim_id, row_number() OVER (PARTITION BY subject ORDER BY created_on DESC, claim_id) AS r FROM claims) WHERE r <= 3")
def _(g: Graph) -> DataFrame:
    return keep_newest(g.claims, ["subject"], 3, F.desc("created_on"), "claim_id").select("subject", "claim_id")


@query("w02_distinct_on", "SELECT DISTINCT ON (object) object, claim_id FROM claims ORDER BY object, created_on DESC, claim_id")
def _(g: Graph) -> DataFrame:
    return latest_per(g.claims, ["object"], F.desc("created_on"), "claim_id").select("object", "claim_id")


@query("w03_rank_per_strategy", "SELECT predicate, claim_id, row_number() OVER (PARTITION BY predicate ORDER BY confidence DESC, claim_id)::INT AS rank FROM claims")
def _(g: Graph) -> DataFrame:
    placed = running_within(g.claims.select("predicate", "claim_id", "confidence"), ["predicate"], [F.desc("confidence"), F.col("claim_id")])
    return placed.select("predicate", "claim_id", F.col("row_number").cast("int").alias("rank"))


@query("w04_thread_position", "SELECT message_id, (row_number() OVER (PARTITION BY thread ORDER BY sent_s NULLS LAST, message_id) - 1)::INT AS position FROM messages")
def _(g: Graph) -> DataFrame:
    w = Window.partitionBy("thread").orderBy(F.asc_nulls_last("sent_s"), "message_id")
    return g.messages.select("message_id", (F.row_number().over(w) - 1).alias("position"))


@query("w05_final_assertion", "SELECT claim_id, last_value(verdict) OVER (PARTITION BY subject ORDER BY created_on, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_verdict FROM claims")
def _(g: Graph) -> DataFrame:
    w = Window.partitionBy("subject").orderBy("created_on", "claim_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return g.claims.select("claim_id", F.last("verdict").over(w).alias("final_verdict"))


@query("w06_velocity", "SELECT metric, day, round((n - lag(n) OVER w) / greatest(1.0::DOUBLE, (day - lag(day) OVER w)::DOUBLE), 6) AS velocity FROM (SELECT metric, day, count(*) AS n FROM samples GROUP BY 1, 2) WINDOW w AS (PARTITION BY metric ORDER BY day)")
def _(g: Graph) -> DataFrame:
    daily = g.samples.groupBy("metric", "day").agg(F.count("*").alias("n"))
    return velocity(daily, ["metric"], "day", "n").select("metric", "day", F.round("velocity", 6).alias("velocity"))


@query(
    "w08_moving_type_token_ratio",
    """SELECT message_id, round(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 50 THEN len(list_distinct(w)) / len(w)
    ELSE list_avg(list_transform(range(1, len(w) - 48), lambda i: len(list_distinct(w[i:i + 49])) / 50.0::DOUBLE)) END, 6) AS ratio
    FROM (SELECT message_id, list_filter(string_split(lower(body), ' '), lambda x: x <> '') AS w FROM messages)""",
)
def _(g: Graph) -> DataFrame:
    words = F.filter(F.split(F.lower("body"), " "), lambda x: x != "")
    return g.messages.withColumn("w", words).select("message_id", F.round(moving_type_token_ratio(F.col("w")), 6).alias("ratio"))


@query(
    "w09_mann_kendall",
    """WITH d AS (SELECT metric, day, count(*) AS n FROM samples GROUP BY 1, 2),
    s AS (SELECT a.metric, sum(sign(b.n - a.n)) AS s FROM d a JOIN d b ON a.metric = b.metric AND a.day < b.day GROUP BY 1),
    t AS (SELECT metric, sum(k)::BIGINT AS n, sum(k * (k - 1) * (2 * k + 5)) AS ties FROM (SELECT metric, n, count(*) AS k FROM d GROUP BY 1, 2) GROUP BY 1)
    SELECT metric, t.n, s.s::DOUBLE AS s, round((t.n * (t.n - 1) * (2 * t.n + 5) - ties) / 18.0::DOUBLE, 6) AS variance FROM s JOIN t USING (metric)""",
)
def _(g: Graph) -> DataFrame:
    daily = g.samples.groupBy("metric", "day").agg(F.count("*").alias("n"))
    found = mann_kendall(daily.withColumnRenamed("n", "y"), ["metric"], "day", "y")
    return found.select("metric", "n", "s", F.round("variance", 6).alias("variance"))


@query(
    "w10_adjacent_merge",
    """SELECT user_id, event_type, count(*) AS length FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS grp FROM events)
    GROUP BY user_id, event_type, grp""",
)
def _(g: Graph) -> DataFrame:
    return islands(g.table("events"), ["user_id"], ["event_id"], "event_type").select("user_id", "event_type", "length")


@query("w11_response_gap", "SELECT message_id, sent_s - lag(sent_s) OVER (PARTITION BY thread ORDER BY sent_s, message_id) AS gap FROM messages")
def _(g: Graph) -> DataFrame:
    before = F.lag("sent_s").over(Window.partitionBy("thread").orderBy("sent_s", "message_id"))
    return g.messages.select("message_id", (F.col("sent_s") - before).alias("gap"))


@query("w12_ranks_and_frames", "SELECT claim_id, dense_rank() OVER w AS d, ntile(4) OVER w AS q, round(sum(amount) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS moving FROM claims WINDOW w AS (PARTITION BY module ORDER BY confidence, claim_id, amount, subject, object)")
def _(g: Graph) -> DataFrame:
    order = [F.col(c) for c in ("confidence", "claim_id", "amount", "subject", "object")]
    placed = durable(running_within(g.claims.select("module", "confidence", "claim_id", "amount", "subject", "object"), ["module"], order), "placed")
    # a row gives its amount to itself and the three rows after it
    given = placed.select("module", F.explode(F.sequence(F.col("row_number"), F.col("row_number") + 3)).alias("row_number"), "amount")
    moving = given.groupBy("module", "row_number").agg(F.round(F.sum("amount"), 4).alias("moving"))
    r, small, rest = F.col("row_number") - 1, F.floor(F.col("n") / 4), F.col("n") % 4
    tile = F.when(r < rest * (small + 1), F.floor(r / (small + 1))).otherwise(rest + F.floor((r - rest * (small + 1)) / F.greatest(small, F.lit(1)))) + 1
    return placed.join(moving, ["module", "row_number"]).select("claim_id", F.col("dense_rank").cast("long").alias("d"), tile.cast("long").alias("q"), "moving")


@query("w13_balanced_groups", "SELECT g AS grp, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT n_chars, ((row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) % 8)::INT AS g FROM documents) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    grouped = balanced_groups(g.table("documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 8)
    return grouped.groupBy(F.col("group").alias("grp")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("t01_sort_limit", "SELECT claim_id, amount FROM claims ORDER BY amount DESC, claim_id LIMIT 20")
def _(g: Graph) -> DataFrame:
    return g.claims.orderBy(F.desc("amount"), "claim_id").limit(20).select("claim_id", "amount")


@query("t02_top_k_by_score", "SELECT module, claim_id FROM (SELECT module, claim_id, row_number() OVER (PARTITION BY module ORDER BY confidence DESC, claim_id) AS r FROM claims WHERE confidence > 0) WHERE r <= 10")
def _(g: Graph) -> DataFrame:
    return keep_newest(g.claims.filter("confidence > 0"), ["module"], 10, F.desc("confidence"), "claim_id").select("module", "claim_id")


@query("t03_offset_paging", "SELECT entity_id FROM vertices WHERE entity_type = 'part' ORDER BY entity_id LIMIT 26 OFFSET 50")
def _(g: Graph) -> DataFrame:
    return g.vertices.filter("entity_type = 'part'").select("entity_id").orderBy("entity_id").offset(50).limit(26)


@query("t04_keyset_paging", "SELECT entity_id FROM vertices WHERE entity_id > 'nation:2' ORDER BY entity_id LIMIT 25")
def _(g: Graph) -> DataFrame:
    return page_after(g.vertices.select("entity_id"), "entity_id", "nation:2", 25)


@query("t05_nulls_last", "SELECT entity_id, valid_to FROM vertices WHERE entity_type = 'nation' ORDER BY valid_to ASC NULLS LAST, entity_id LIMIT 30")
def _(g: Graph) -> DataFrame:
    return g.vertices.filter("entity_type = 'nation'").select("entity_id", "valid_to").orderBy(F.asc_nulls_last("valid_to"), "entity_id").limit(30)


@query("t06_argmax_with_tiebreak", "SELECT object, min(claim_id) AS claim_id FROM claims c WHERE amount = (SELECT max(amount) FROM claims d WHERE d.object = c.object) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return latest_per(g.claims, ["object"], F.desc("amount"), "claim_id").select("object", "claim_id")


@query(
    "t07_share_capped_selection",
    """WITH r AS (SELECT module, claim_id, confidence, predicate = 'made_by' AS chunk, row_number() OVER (PARTITION BY module, predicate = 'made_by' ORDER BY confidence DESC, claim_id) AS n FROM claims)
    SELECT module, claim_id FROM (SELECT module, claim_id, row_number() OVER (PARTITION BY module ORDER BY CASE WHEN chunk AND n > 5 THEN 1 ELSE 0 END, confidence DESC, claim_id) AS p FROM r) WHERE p <= 10""",
)
def _(g: Graph) -> DataFrame:
    return share_capped_top(g.claims, ["module"], F.col("predicate") == "made_by", 10, 0.5, F.desc("confidence"), "claim_id").select("module", "claim_id")


@query("t08_per_bucket_cap", "SELECT module, name, n FROM (SELECT module, subject AS name, count(*) AS n, row_number() OVER (PARTITION BY module ORDER BY count(*) DESC, subject) AS r FROM claims GROUP BY 1, 2) WHERE r <= 20")
def _(g: Graph) -> DataFrame:
    counted = g.claims.groupBy("module", F.col("subject").alias("name")).agg(F.count("*").alias("n"))
    return keep_newest(counted, ["module"], 20, F.desc("n"), "name")


@query("t10_head_middle_tail_excerpts", "SELECT doc_id, substr(text, 1, 40) AS head, substr(text, greatest(n // 2 - 20, 0) + 1, 40) AS middle, substr(text, greatest(n - 40, 0) + 1, 40) AS tail FROM (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL)")
def _(g: Graph) -> DataFrame:
    n = F.length("text")
    at = lambda start: F.substring(F.col("text"), F.greatest(start, F.lit(0)) + 1, F.lit(40))
    return g.table("documents").filter("text IS NOT NULL").select(
        "doc_id", at(F.lit(0)).alias("head"), at(F.floor(n / 2).cast("int") - 20).alias("middle"), at(n - 40).alias("tail")
    )


@query("u01_neighbour_union", "SELECT target AS neighbour FROM edges WHERE source = 'nation:3' UNION SELECT source FROM edges WHERE target = 'nation:3'")
def _(g: Graph) -> DataFrame:
    out = g.edges.filter("source = 'nation:3'").select(F.col("target").alias("neighbour"))
    return out.union(g.edges.filter("target = 'nation:3'").select("source")).distinct()


@query("u02_round_concat", "SELECT claim_id, count(*) AS times FROM (SELECT claim_id FROM claims WHERE confidence > 0.9 UNION ALL SELECT claim_id FROM claims WHERE amount > 48) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    both = g.claims.filter("confidence > 0.9").select("claim_id").unionAll(g.claims.filter("amount > 48").select("claim_id"))
    return both.groupBy("claim_id").agg(F.count("*").alias("times"))


@query("u03_set_diff", "SELECT 'added' AS change, subject FROM (SELECT subject FROM claims WHERE status = 'accepted' EXCEPT SELECT subject FROM claims WHERE status = 'quarantined') UNION ALL SELECT 'removed', subject FROM (SELECT subject FROM claims WHERE status = 'quarantined' EXCEPT SELECT subject FROM claims WHERE status = 'accepted')")
def _(g: Graph) -> DataFrame:
    a = g.claims.filter("status = 'accepted'").select("subject").distinct()
    b = g.claims.filter("status = 'quarantined'").select("subject").distinct()
    added = a.join(b, "subject", "left_anti").select(F.lit("added").alias("change"), "subject")
    return added.union(b.join(a, "subject", "left_anti").select(F.lit("removed").alias("change"), "subject"))


@query("u04_scope_intersection", "SELECT module FROM claims WHERE confidence > 0.5 INTERSECT SELECT module FROM claims WHERE predicate = 'made_by'")
def _(g: Graph) -> DataFrame:
    # distinct on both sides first, so that tasks send each value once
    of = lambda c: g.claims.filter(c).select("module").distinct()
    return of("confidence > 0.5").intersect(of("predicate = 'made_by'"))


@query("u05_forbidden_vocabulary", "SELECT DISTINCT module FROM vertices EXCEPT SELECT module FROM vertices WHERE entity_type = 'part'")
def _(g: Graph) -> DataFrame:
    return g.vertices.select("module").distinct().subtract(g.vertices.filter("entity_type = 'part'").select("module").distinct())


@query("u06_text_dedup_minus_existing", "SELECT md5(lower(trim(body))) AS h, min(message_id) AS message_id FROM messages WHERE md5(lower(trim(body))) NOT IN (SELECT md5(lower(trim(text))) FROM benchmark WHERE text IS NOT NULL) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    digest = lambda c: F.md5(F.lower(F.trim(c)).cast("binary"))
    known = g.table("benchmark").select(digest(F.col("text")).alias("h"))
    return g.messages.withColumn("h", digest(F.col("body"))).join(known, "h", "left_anti").groupBy("h").agg(F.min("message_id").alias("message_id"))


@query("u08_recursive_lineage", "WITH RECURSIVE up AS (SELECT message_id, in_reply_to, 0 AS depth FROM messages WHERE in_reply_to IS NULL UNION ALL SELECT m.message_id, m.in_reply_to, up.depth + 1 FROM messages m JOIN up ON m.in_reply_to = up.message_id) SELECT message_id, depth FROM up")
def _(g: Graph) -> DataFrame:
    from loomgraph.operators.graph_algorithms import lineage_depth

    return lineage_depth(g.messages.select(F.col("message_id").alias("id"), F.col("in_reply_to").alias("parent"))).select(F.col("id").alias("message_id"), "depth")


@query("u09_intersect_except", "SELECT subject FROM claims WHERE verdict = 'SUPPORTED' INTERSECT SELECT subject FROM claims WHERE verdict = 'REFUTED' EXCEPT SELECT subject FROM claims WHERE amount > 49")
def _(g: Graph) -> DataFrame:
    of = lambda c: g.claims.filter(c).select("subject").distinct()
    return of("verdict = 'SUPPORTED'").intersect(of("verdict = 'REFUTED'")).subtract(of("amount > 49"))
