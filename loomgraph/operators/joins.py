"""Joins: patterns, incident and internal edges, co-occurrence, anti joins, ranges, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph_reads import incidence, live, overlaps
from loomgraph.plans.model import Graph
from loomgraph.plans.registry import query
from loomgraph.session import durable


def incident_edges(edges: DataFrame, ids: DataFrame, cap: int) -> DataFrame:
    """Distinct edges with an end in ``ids`` (entity_id); those with both ends first, ``cap`` at most."""
    marked = ids.select("entity_id").distinct()
    one = edges.join(marked.select(F.col("entity_id").alias("source"), F.lit(1).alias("s")), "source", "left")
    both = one.join(marked.select(F.col("entity_id").alias("target"), F.lit(1).alias("t")), "target", "left")
    hits = F.coalesce("s", F.lit(0)) + F.coalesce("t", F.lit(0))
    found = both.withColumn("relevance", hits).filter("relevance > 0").dropDuplicates(["rel_type", "source", "target"])
    return found.orderBy(F.desc("relevance"), "rel_type", "source", "target").limit(cap).drop("s", "t")


def internal_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids``; either side is read once."""
    edges, marked = durable(edges, "edges"), durable(ids.select("entity_id").distinct(), "ids")
    inner = edges.join(marked.withColumnRenamed("entity_id", "source"), "source", "left_semi")
    return inner.join(marked.withColumnRenamed("entity_id", "target"), "target", "left_semi")


def dealt_by(rows: DataFrame, keys: list[str], tasks: int | None) -> DataFrame:
    """``rows`` dealt by their keys, so that a distinct and a join of each key need no shuffle of their own."""
    return rows.repartition(*map(F.col, keys)) if tasks is None else rows.repartition(tasks, *keys)


def cooccurring_pairs(mentions: DataFrame, group: list[str], name: str, tasks: int | None = None) -> DataFrame:
    """Unordered pairs of names in the same group, with the number of groups that hold them."""
    one = dealt_by(mentions.select(*group, F.col(name).alias("a")), group, tasks).distinct()
    two = one.withColumnRenamed("a", "b")
    return one.join(two, group).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def attach_either_way(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs (a, b) left-joined to relations (source, target) in either direction, duplicates kept."""
    both = relations.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit(True).alias("related"))
    back = relations.select(F.col("target").alias("a"), F.col("source").alias("b"), F.lit(True).alias("related"))
    return pairs.join(both.union(back), ["a", "b"], "left")


def latest_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row per key in the given order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Each left row with the ``value`` of the last right row of its key strictly before it.

    Both sides are one sorted stream per key, so the join costs one shuffle and no pairs are formed.
    """
    a = left.withColumns({"__side": F.lit(1), "__value": F.lit(None).cast(dict(right.dtypes)[value])})
    b = right.select(*keys, at, F.col(value).alias("__value"), F.lit(0).alias("__side"))
    stream = a.unionByName(b, allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    last = F.last("__value", ignorenulls=True).over(before)
    return stream.withColumn(f"prior_{value}", last).filter("__side = 1").drop("__side", "__value")


@query("j01_pattern_join", "SELECT a.name AS customer, b.name AS nation FROM edges e JOIN vertices a ON e.source = a.entity_id JOIN vertices b ON e.target = b.entity_id WHERE e.rel_type = 'located_in' AND a.entity_type = 'customer' AND a.deprecated = false")
def _(g: Graph) -> DataFrame:
    a = live(g.vertices).filter("entity_type = 'customer'").select(F.col("entity_id").alias("source"), F.col("name").alias("customer"))
    b = g.vertices.select(F.col("entity_id").alias("target"), F.col("name").alias("nation"))
    return g.edges.filter("rel_type = 'located_in'").join(a, "source").join(b, "target").select("customer", "nation")


@query(
    "j02_incident_edges",
    """WITH s AS (SELECT entity_id FROM vertices WHERE entity_type IN ('nation', 'supplier') AND entity_key % 3 = 0)
    SELECT DISTINCT rel_type, source, target, (source IN (SELECT entity_id FROM s))::INT + (target IN (SELECT entity_id FROM s))::INT AS relevance FROM edges
    WHERE source IN (SELECT entity_id FROM s) OR target IN (SELECT entity_id FROM s) ORDER BY relevance DESC, rel_type, source, target LIMIT 400""",
)
def _(g: Graph) -> DataFrame:
    ids = g.vertices.filter("entity_type IN ('nation', 'supplier') AND entity_key % 3 = 0")
    return incident_edges(g.edges, ids, 400).select("rel_type", "source", "target", "relevance")


@query(
    "j03_internal_edges",
    """WITH s AS (SELECT entity_id FROM vertices WHERE (valid_from IS NULL OR valid_from <= DATE '2020-09-01') AND (valid_to IS NULL OR valid_to >= DATE '2020-06-01'))
    SELECT rel_type, count(*) AS n FROM edges WHERE source IN (SELECT entity_id FROM s) AND target IN (SELECT entity_id FROM s) GROUP BY 1""",
)
def _(g: Graph) -> DataFrame:
    inside = overlaps(F.col("valid_from"), F.col("valid_to"), F.expr("DATE '2020-06-01'"), F.expr("DATE '2020-09-01'"))
    return internal_edges(g.edges.select("rel_type", "source", "target"), g.vertices.filter(inside)).groupBy("rel_type").agg(F.count("*").alias("n"))


@query("j04_cooccurring_pairs", "SELECT a.object AS a, b.object AS b, count(*) AS n FROM (SELECT DISTINCT chunk_id, module, object FROM claims) a JOIN (SELECT DISTINCT chunk_id, module, object FROM claims) b ON a.chunk_id = b.chunk_id AND a.module = b.module AND a.object < b.object GROUP BY 1, 2")
def _(g: Graph) -> DataFrame:
    return cooccurring_pairs(g.claims, ["chunk_id", "module"], "object")


@query(
    "j05_pairs_left_join_either_way",
    """WITH p AS (SELECT a.object AS a, b.subject AS b, count(*) AS n FROM claims a JOIN claims b ON a.chunk_id = b.chunk_id AND a.ordinal < b.ordinal GROUP BY 1, 2)
    SELECT p.a, p.b, p.n, r.source IS NOT NULL AS related FROM p LEFT JOIN (SELECT DISTINCT source, target FROM edges WHERE rel_type = 'supplies') r
    ON (p.a = r.source AND p.b = r.target) OR (p.b = r.source AND p.a = r.target)""",
)
def _(g: Graph) -> DataFrame:
    one = g.claims.select("chunk_id", F.col("ordinal").alias("i"), F.col("object").alias("a"))
    two = g.claims.select("chunk_id", F.col("ordinal").alias("j"), F.col("subject").alias("b"))
    pairs = one.join(two, "chunk_id").filter("i < j").groupBy("a", "b").agg(F.count("*").alias("n"))
    relations = g.edges.filter("rel_type = 'supplies'").select("source", "target").distinct()
    return attach_either_way(pairs, relations).withColumn("related", F.coalesce("related", F.lit(False)))


@query("j06_name_duplicates", "SELECT a.entity_id AS a, b.entity_id AS b, a.name FROM vertices a JOIN vertices b ON a.entity_type = b.entity_type AND a.name = b.name AND a.entity_id < b.entity_id WHERE a.entity_type = 'part' AND a.deprecated = false AND b.deprecated = false")
def _(g: Graph) -> DataFrame:
    from loomgraph.operators.resolution import exact_duplicates

    return exact_duplicates(live(g.vertices).filter("entity_type = 'part'"))


@query("j08_latest_claim_per_subject", "SELECT subject, claim_id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY created_on DESC, claim_id DESC) AS r FROM claims WHERE status = 'accepted') WHERE r = 1")
def _(g: Graph) -> DataFrame:
    return latest_per(g.claims.filter("status = 'accepted'"), ["subject"], F.desc("created_on"), F.desc("claim_id")).select("subject", "claim_id", "verdict")


@query("j09_attach_with_fallback_key", "SELECT m.message_id, t.n FROM messages m LEFT JOIN (SELECT CAST(thread AS STRING) AS k, count(*) AS n FROM messages GROUP BY 1) t ON t.k = coalesce(CASE WHEN m.turn > 0 THEN CAST(m.thread AS STRING) END, m.message_id)")
def _(g: Graph) -> DataFrame:
    threads = g.messages.groupBy(F.col("thread").cast("string").alias("k")).agg(F.count("*").alias("n"))
    key = F.coalesce(F.when(F.col("turn") > 0, F.col("thread").cast("string")), F.col("message_id"))
    return g.messages.withColumn("k", key).join(threads, "k", "left").select("message_id", "n")


@query("j10_lateral_unnest", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(subject, ' ')) AS word FROM messages) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return g.messages.select(F.explode_outer(F.split("subject", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("j11_expression_join", "SELECT c.claim_id, o.o_orderstatus AS order_status FROM claims c JOIN orders o ON c.document_id = 'doc:' || CAST(o.o_orderkey AS STRING)")
def _(g: Graph) -> DataFrame:
    orders = g.table("orders").select(F.concat(F.lit("doc:"), F.col("o_orderkey").cast("string")).alias("document_id"), F.col("o_orderstatus").alias("order_status"))
    return g.claims.join(orders, "document_id").select("claim_id", "order_status")


@query("j12_provenance_chain", "SELECT v.name, count(DISTINCT o.o_custkey) AS n_senders FROM claims c JOIN vertices v ON c.subject = v.entity_id JOIN orders o ON o.o_orderkey = c.unit GROUP BY 1")
def _(g: Graph) -> DataFrame:
    named = g.vertices.select(F.col("entity_id").alias("subject"), "name")
    orders = g.table("orders").select(F.col("o_orderkey").alias("unit"), "o_custkey")
    return g.claims.select("subject", "unit").join(named, "subject").join(orders, "unit").groupBy("name").agg(F.countDistinct("o_custkey").alias("n_senders"))


@query("j13_set_membership", "SELECT count(*) AS n FROM claims WHERE object IN (SELECT 'supplier:' || CAST(s_suppkey AS STRING) FROM supplier WHERE s_acctbal > 5000)")
def _(g: Graph) -> DataFrame:
    rich = g.table("supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("object"))
    return g.claims.join(rich, "object", "left_semi").agg(F.count("*").alias("n"))


@query("j14_unapproved_types", "SELECT entity_type, count(*) AS n FROM vertices WHERE entity_type NOT IN ('region', 'nation', 'part') GROUP BY 1 ORDER BY n DESC, entity_type LIMIT 20")
def _(g: Graph) -> DataFrame:
    approved = g.spark.createDataFrame([("region",), ("nation",), ("part",)], "entity_type string")
    counts = g.vertices.groupBy("entity_type").agg(F.count("*").alias("n"))
    return counts.join(approved, "entity_type", "left_anti").orderBy(F.desc("n"), "entity_type").limit(20)


@query("j15_orphans", "SELECT entity_id FROM vertices WHERE deprecated = false AND entity_id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)")
def _(g: Graph) -> DataFrame:
    return incidence(g.vertices, g.edges).filter("n_live > 0 AND n_ends = 0").select("entity_id")


@query("j16_missing_embedding", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(g: Graph) -> DataFrame:
    return g.table("documents").join(g.table("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


@query("j17_full_outer_diff", "SELECT coalesce(a.k, b.k) AS module, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.n <> b.n THEN 'modified' ELSE 'unchanged' END AS change FROM (SELECT module AS k, count(*) AS n FROM vertices WHERE entity_type = 'part' AND entity_key % 3 > 0 GROUP BY 1) a FULL JOIN (SELECT module AS k, count(*) AS n FROM vertices WHERE entity_key % 5 > 0 GROUP BY 1) b ON a.k = b.k")
def _(g: Graph) -> DataFrame:
    from loomgraph.operators.ontology import diff

    a = g.vertices.filter("entity_type = 'part' AND entity_key % 3 > 0").groupBy("module").agg(F.count("*").alias("n"))
    b = g.vertices.filter("entity_key % 5 > 0").groupBy("module").agg(F.count("*").alias("n"))
    return diff(a, b, ["module"], ["n"]).select("module", "change")


@query("j18_unambiguous_names", "SELECT name, min(entity_id) AS entity_id FROM vertices WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) = 1")
def _(g: Graph) -> DataFrame:
    return g.vertices.filter("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id")).filter("n = 1").drop("n")


@query(
    "j21_as_of_join",
    """SELECT s.event_id, (SELECT max_by(p.value, p.ts) FROM (SELECT user_id, date_trunc('second', ts) AS ts, max(value) AS value FROM samples WHERE metric = 'view' GROUP BY 1, 2) p
    WHERE p.user_id = s.user_id AND p.ts < date_trunc('second', s.ts)) AS prior_value FROM samples s WHERE s.metric = 'purchase'""",
)
def _(g: Graph) -> DataFrame:
    seconds = g.samples.withColumn("s", F.unix_timestamp(F.date_trunc("second", "ts")))
    right = seconds.filter("metric = 'view'").groupBy("user_id", "s").agg(F.max("value").alias("value"))
    left = seconds.filter("metric = 'purchase'").select("event_id", "user_id", "s")
    return as_of_join(left, right, ["user_id"], "s", "value").select("event_id", "prior_value")


@query(
    "j22_interval_overlap_self_join",
    """SELECT a.claim_id AS a, b.claim_id AS b FROM claims a JOIN claims b ON a.subject = b.subject AND a.object = b.object AND a.predicate = b.predicate AND a.claim_id < b.claim_id
    WHERE a.created_on <= b.created_on + 30 AND b.created_on <= a.created_on + 30""",
)
def _(g: Graph) -> DataFrame:
    from loomgraph.operators.claims import overlapping_claims

    return overlapping_claims(g.claims, 30)


@query("j23_as_of_slice", "SELECT entity_type, count(*) AS n FROM vertices WHERE valid_from <= DATE '2020-08-01' AND (valid_to IS NULL OR valid_to > DATE '2020-08-01') GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return g.vertices.filter("valid_from <= DATE '2020-08-01' AND (valid_to IS NULL OR valid_to > DATE '2020-08-01')").groupBy("entity_type").agg(F.count("*").alias("n"))


@query("j25_latest_version_dimension", "SELECT s.event_id, d.value AS latest FROM samples s JOIN (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM samples WHERE metric = 'login') d ON s.user_id = d.user_id AND d.r = 1 WHERE s.metric = 'purchase'")
def _(g: Graph) -> DataFrame:
    newest = latest_per(g.samples.filter("metric = 'login'"), ["user_id"], F.desc("event_id")).select("user_id", F.col("value").alias("latest"))
    return g.samples.filter("metric = 'purchase'").join(newest, "user_id").select("event_id", "latest")
