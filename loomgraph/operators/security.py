"""Row-level security: rules, scopes, forbidden tags, scrubbing, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.model import Graph
from loomgraph.plans.registry import query


def secure(df: DataFrame, modules: list[str], forbidden: list[str], tags: str) -> DataFrame:
    """Rows of allowed modules without any forbidden tag in their bar-form tags; filters reach the scan."""
    out = df.filter(F.col("module").isin(modules))
    for tag in forbidden:
        out = out.filter(~F.coalesce(F.col(tags), F.lit("")).contains(f"|{tag}|"))
    return out


def decide(requests: DataFrame, memberships: DataFrame, rules: DataFrame, default: str = "deny") -> DataFrame:
    """Tiered decision per request: exact label before kind before wildcard; deny wins within a tier.

    ``requests`` (request_id, person, kind, label, action), ``memberships`` (person, cluster),
    ``rules`` (cluster, kind, label, action, decision), '*' for any. Rules meet requests by three equi-joins.
    """
    asked = requests.join(memberships, "person").select("request_id", "cluster", "kind", "label", "action")
    tiers = [
        (1, asked, ["cluster", "kind", "label", "action"]),
        (2, asked.withColumn("label", F.lit("*")), ["cluster", "kind", "label", "action"]),
        (3, asked.withColumn("label", F.lit("*")).withColumn("kind", F.lit("*")), ["cluster", "kind", "label", "action"]),
    ]
    met = None
    for tier, rows, keys in tiers:
        part = rows.join(rules, keys).select("request_id", F.lit(tier).alias("tier"), (F.col("decision") == "deny").alias("denied"))
        met = part if met is None else met.union(part)
    per = met.groupBy("request_id", "tier").agg(F.bool_or("denied").alias("denied"))
    first = per.groupBy("request_id").agg(F.min(F.struct("tier", "denied")).alias("m"))
    decided = first.select("request_id", "m.tier", F.when(F.col("m.denied"), "deny").otherwise("allow").alias("decision"))
    return requests.join(decided, "request_id", "left").withColumn("decision", F.coalesce("decision", F.lit(default)))


def forbidden_tags(vocabulary: DataFrame, visible: DataFrame) -> DataFrame:
    """Tags of the vocabulary that a principal's clusters do not show."""
    return vocabulary.select("tag").distinct().join(visible.select("tag").distinct(), "tag", "left_anti")


def drop_tagged(rows: DataFrame, own: Column, fetched: Column, forbidden: list[str]) -> DataFrame:
    """Without rows whose own or fetched tags hold a forbidden one."""
    tags = F.array_union(F.coalesce(own, F.array().cast("array<string>")), F.coalesce(fetched, F.array().cast("array<string>")))
    return rows.filter(~F.arrays_overlap(tags, F.array(*map(F.lit, forbidden))))


def scrub(lines: DataFrame, text: str, names: DataFrame, max_names: int = 10_000) -> DataFrame:
    """Without lines that contain a dropped name of three characters and more; the names are bounded and checked."""
    wanted = names.filter(F.length("name") >= 3).select("name").distinct()
    if wanted.limit(max_names + 1).count() > max_names:
        raise ValueError(f"at most {max_names} dropped names; scrub in blocks")
    return lines.join(F.broadcast(wanted), F.col(text).contains(F.col("name")), "left_anti")


_RULES = """SELECT 'c' || CAST(n_regionkey AS STRING) AS cluster, 'vertex' AS kind, n_name AS label, 'read' AS action, CASE WHEN n_nationkey % 3 = 0 THEN 'deny' ELSE 'allow' END AS decision FROM nation
    UNION ALL SELECT 'c' || CAST(r_regionkey AS STRING), 'vertex', '*', 'read', CASE WHEN r_regionkey % 2 = 0 THEN 'deny' ELSE 'allow' END FROM region WHERE r_regionkey < 3
    UNION ALL SELECT 'c3', '*', '*', 'read', 'allow' FROM region WHERE r_regionkey = 0"""
_MEMBERS = "SELECT c_custkey AS person, 'c' || CAST(c_custkey % 5 AS STRING) AS cluster FROM customer UNION ALL SELECT c_custkey, 'c' || CAST((c_custkey + 1) % 5 AS STRING) FROM customer WHERE c_custkey % 4 = 0"
_REQUESTS = "SELECT c_custkey AS request_id, c_custkey AS person, 'vertex' AS kind, n_name AS label, CASE WHEN c_custkey % 50 = 7 THEN 'write' ELSE 'read' END AS action FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _sql(g: Graph, text: str) -> DataFrame:
    for t in ("nation", "region", "customer"):
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return g.spark.sql(text, **{t: g.table(t) for t in ("nation", "region", "customer") if f"{{{t}}}" in text})


@query(
    "sec01_tiered_decision",
    f"""WITH rules AS ({_RULES}), mem AS ({_MEMBERS}), req AS ({_REQUESTS}), met AS (SELECT q.request_id, CASE WHEN r.label <> '*' THEN 1 WHEN r.kind <> '*' THEN 2 ELSE 3 END AS tier, r.decision = 'deny' AS denied
      FROM req q JOIN mem m ON q.person = m.person JOIN rules r ON r.cluster = m.cluster AND r.action = q.action AND (r.kind = q.kind OR r.kind = '*') AND (r.label = q.label OR r.label = '*')),
    b AS (SELECT request_id, tier, bool_or(denied) AS denied FROM met GROUP BY 1, 2), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY tier) = 1)
    SELECT req.request_id, f.tier, CASE WHEN f.tier IS NULL OR f.denied THEN 'deny' ELSE 'allow' END AS decision FROM req LEFT JOIN f ON req.request_id = f.request_id""",
)
def _(g: Graph) -> DataFrame:
    return decide(_sql(g, _REQUESTS), _sql(g, _MEMBERS), _sql(g, _RULES)).select("request_id", "tier", "decision")


@query("sec02_scope_intersection", "SELECT module FROM vertices WHERE entity_type = 'customer' INTERSECT SELECT module FROM vertices WHERE entity_key % 7 = 1")
def _(g: Graph) -> DataFrame:
    agent = g.vertices.filter("entity_key % 7 = 1").select("module")
    return g.vertices.filter("entity_type = 'customer'").select("module").distinct().join(agent, "module", "left_semi")


@query("sec03_forbidden_tags", "SELECT DISTINCT module AS tag FROM vertices EXCEPT SELECT module FROM claims JOIN vertices v ON v.entity_id = claims.subject GROUP BY 1".replace("SELECT module FROM claims JOIN", "SELECT v.module FROM claims JOIN"))
def _(g: Graph) -> DataFrame:
    seen = g.claims.select(F.col("subject").alias("entity_id")).join(g.vertices.select("entity_id", F.col("module").alias("tag")), "entity_id").select("tag")
    return forbidden_tags(g.vertices.select(F.col("module").alias("tag")), seen)


@query("sec05_tagged_subset", "SELECT tag, count(*) AS n FROM (SELECT unnest([module, verdict]) AS tag FROM claims) WHERE tag IN ('m1', 'REFUTED') GROUP BY 1")
def _(g: Graph) -> DataFrame:
    tagged = g.claims.select(F.explode(F.array("module", "verdict")).alias("tag"))
    return tagged.filter(F.col("tag").isin("m1", "REFUTED")).groupBy("tag").agg(F.count("*").alias("n"))


@query("sec06_audit_trail", "SELECT claim_id, created_on FROM claims WHERE module = 'm2' AND verdict = 'REFUTED' ORDER BY created_on DESC, claim_id LIMIT 40 OFFSET 40")
def _(g: Graph) -> DataFrame:
    return g.claims.filter("module = 'm2' AND verdict = 'REFUTED'").orderBy(F.desc("created_on"), "claim_id").offset(40).limit(40).select("claim_id", "created_on")


@query("sec07_visibility_modes", "SELECT CASE WHEN entity_key % 3 = 0 THEN 'hidden' WHEN module = 'geo' THEN 'summary' ELSE 'full' END AS mode, count(*) AS n FROM vertices GROUP BY 1")
def _(g: Graph) -> DataFrame:
    mode = F.when(F.col("entity_key") % 3 == 0, "hidden").when(F.col("module") == "geo", "summary").otherwise("full")
    return g.vertices.groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


@query("sec08_result_drop", "SELECT c.claim_id FROM claims c JOIN vertices v ON c.subject = v.entity_id WHERE NOT (c.module = 'm1' OR v.module = 'Brand#11')")
def _(g: Graph) -> DataFrame:
    fetched = g.vertices.select(F.col("entity_id").alias("subject"), F.array("module").alias("fetched"))
    joined = g.claims.join(fetched, "subject")
    return drop_tagged(joined, F.array("module"), F.col("fetched"), ["m1", "Brand#11"]).select("claim_id")


@query("sec09_context_scrub", "SELECT claim_id FROM claims WHERE NOT EXISTS (SELECT 1 FROM nation WHERE contains(subject || ' ' || object, 'r:1' || CAST(n_nationkey AS STRING)) AND n_nationkey < 5) AND confidence > 0.9")
def _(g: Graph) -> DataFrame:
    names = g.table("nation").filter("n_nationkey < 5").select(F.concat(F.lit("r:1"), F.col("n_nationkey").cast("string")).alias("name"))
    lines = g.claims.filter("confidence > 0.9").withColumn("line", F.concat_ws(" ", "subject", "object"))
    return scrub(lines, "line", names).select("claim_id")
