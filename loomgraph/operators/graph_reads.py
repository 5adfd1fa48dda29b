"""Scans, lookups, filters and projections over vertices and edges."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.model import Graph
from loomgraph.plans.registry import query

#: Longest name prefix first decides a namespace.
INTERNAL_PROPERTIES = ("confidence", "deprecated")


def incidence(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Per id of a vertex or of an edge's end: its vertices, live and deprecated ones, its edge ends, and the edges (and
    deprecated ones) that start there. Vertices and edges are read once and meet in one aggregate, without a join."""
    one = lambda c: c.cast("int")
    deprecated = one(F.coalesce("deprecated", F.lit(False)))
    live_one = one(F.coalesce(~F.col("deprecated"), F.lit(False)))
    zero = F.lit(0)
    names = ("n_vertices", "n_live", "deprecated_vertices", "n_ends", "n_edges", "deprecated_edges")

    def signs(*values):
        return [v.alias(n) for v, n in zip(values, names)]

    of_vertices = vertices.select("entity_id", *signs(F.lit(1), live_one, deprecated, zero, zero, zero))
    ends = F.array(
        F.struct(F.col("source").alias("entity_id"), *signs(zero, zero, zero, F.lit(1), F.lit(1), deprecated)),
        F.struct(F.col("target").alias("entity_id"), *signs(zero, zero, zero, F.lit(1), zero, zero)),
    )
    of_edges = edges.select(F.explode(ends).alias("end")).select("end.*")
    return of_vertices.unionByName(of_edges).groupBy("entity_id").agg(*(F.sum(n).alias(n) for n in names))


def live(df: DataFrame) -> DataFrame:
    """Rows not soft-deleted; a null flag is not ``false`` and so is left out."""
    return df.filter(F.col("deprecated") == F.lit(False))


def of_types(df: DataFrame, types: Iterable[str]) -> DataFrame:
    return df.filter(F.col("entity_type").isin(list(types)))


def by_id(vertices: DataFrame, entity_id: str) -> DataFrame:
    return vertices.filter(F.col("entity_id") == entity_id).limit(1)


def canonical_lookup(vertices: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (entity_type, name) joined to the live vertex of that type and case-folded name with the least id."""
    keyed = live(vertices).groupBy("entity_type", F.lower(F.trim("name")).alias("name_key")).agg(F.min("entity_id").alias("entity_id"))
    return wanted.withColumn("name_key", F.lower(F.trim("name"))).join(keyed, ["entity_type", "name_key"], "left")


def with_endpoints(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with name and type of both ends (inner)."""
    ends = vertices.select("entity_id", "name", "entity_type")
    source = ends.toDF("source", "source_name", "source_type")
    target = ends.toDF("target", "target_name", "target_type")
    return edges.join(source, "source").join(target, "target")


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Valid time meets [low, high]; a null bound is open."""
    return (start.isNull() | (start <= high)) & (end.isNull() | (end >= low))


def covers(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Valid time contains [low, high]; a null bound is open."""
    return (start.isNull() | (start <= low)) & (end.isNull() | (end >= high))


def name_contains(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.col("name").contains(text))


def name_edge_token(df: DataFrame, token: str) -> DataFrame:
    """The token opens or closes the name."""
    name = F.lower("name")
    return df.filter(name.startswith(token + " ") | name.endswith(" " + token))


def band(value: Column, edges: list[tuple[float, str]], below: str) -> Column:
    """The label of the first edge that ``value`` reaches (edges from high to low); null stays null."""
    out = F.when(value.isNull(), None)
    for edge, label in edges:
        out = out.when(value >= edge, F.lit(label))
    return out.otherwise(F.lit(below))


def tags_to_bar(tags: Column) -> Column:
    """Array of tags to '|a|b|', sorted and distinct; empty stays empty."""
    joined = F.array_join(F.array_sort(F.array_distinct(tags)), "|")
    return F.when(F.size(tags) == 0, "").otherwise(F.concat(F.lit("|"), joined, F.lit("|")))


def has_tag(bar: Column, tag: str) -> Column:
    return bar.contains(f"|{tag}|")


def keep_properties(props: Column, names: Iterable[str]) -> Column:
    wanted = list(names)
    return F.map_filter(props, lambda k, _: k.isin(wanted))


def drop_properties(props: Column, names: Iterable[str]) -> Column:
    unwanted = list(names)
    return F.map_filter(props, lambda k, _: ~k.isin(unwanted))


def properties(vertices: DataFrame) -> DataFrame:
    """Vertices with their columns as a map of strings."""
    pairs = [F.lit("name"), F.col("name"), F.lit("module"), F.col("module"), F.lit("confidence"), F.col("confidence").cast("string"), F.lit("deprecated"), F.col("deprecated").cast("string")]
    return vertices.withColumn("props", F.create_map(*pairs))


@query("s01_label_scan", "SELECT entity_id, name, module FROM vertices WHERE entity_type = 'supplier' AND deprecated = false")
def _(g: Graph) -> DataFrame:
    return of_types(live(g.vertices), ["supplier"]).select("entity_id", "name", "module")


@query("s02_vertex_scan", "SELECT entity_id, entity_type, name FROM vertices WHERE deprecated = false")
def _(g: Graph) -> DataFrame:
    return live(g.vertices).select("entity_id", "entity_type", "name")


@query(
    "s03_edge_scan_with_endpoints",
    """SELECT e.rel_type, e.source, e.target, a.name AS source_name, a.entity_type AS source_type, b.name AS target_name, b.entity_type AS target_type
    FROM edges e JOIN vertices a ON e.source = a.entity_id JOIN vertices b ON e.target = b.entity_id WHERE e.deprecated = false AND e.rel_type <> 'contains'""",
)
def _(g: Graph) -> DataFrame:
    return with_endpoints(live(g.edges).filter("rel_type <> 'contains'"), g.vertices).select(
        "rel_type", "source", "target", "source_name", "source_type", "target_name", "target_type"
    )


@query("s04_catalog_scan", "SELECT 'vertex' AS kind, entity_type AS type, count(*) AS n FROM vertices GROUP BY 2 UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY 2")
def _(g: Graph) -> DataFrame:
    v = g.vertices.groupBy(F.col("entity_type").alias("type")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("vertex"))
    e = g.edges.groupBy(F.col("rel_type").alias("type")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge"))
    return v.unionByName(e).select("kind", "type", "n")


@query("s05_keyed_lookup", "SELECT entity_id, entity_type, name, module FROM vertices WHERE entity_id = 'customer:42' LIMIT 1")
def _(g: Graph) -> DataFrame:
    return by_id(g.vertices, "customer:42").select("entity_id", "entity_type", "name", "module")


@query(
    "s06_canonical_lookup",
    """SELECT w.entity_type, w.name, v.entity_id FROM (SELECT entity_type, upper(name) AS name FROM vertices) w
    LEFT JOIN (SELECT entity_type, lower(trim(name)) AS k, min(entity_id) AS entity_id FROM vertices WHERE deprecated = false GROUP BY 1, 2) v
    ON w.entity_type = v.entity_type AND lower(trim(w.name)) = v.k""",
)
def _(g: Graph) -> DataFrame:
    wanted = g.vertices.select("entity_type", F.upper("name").alias("name"))
    return canonical_lookup(g.vertices, wanted).select("entity_type", "name", "entity_id")


@query("p01_soft_delete_filter", "SELECT entity_type, count(*) AS n FROM vertices WHERE deprecated = false GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return live(g.vertices).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("p02_module_filter", "SELECT entity_id, name FROM vertices WHERE module = 'BUILDING' AND deprecated = false")
def _(g: Graph) -> DataFrame:
    return live(g.vertices).filter(F.col("module") == "BUILDING").select("entity_id", "name")


@query("p03_type_in_list", "SELECT entity_id, entity_type FROM vertices WHERE entity_type IN ('nation', 'region', 'supplier')")
def _(g: Graph) -> DataFrame:
    return of_types(g.vertices, ["nation", "region", "supplier"]).select("entity_id", "entity_type")


@query("p04_substring_search", "SELECT entity_id, name FROM vertices WHERE contains(name, '00001') AND deprecated = false")
def _(g: Graph) -> DataFrame:
    return name_contains(live(g.vertices), "00001").select("entity_id", "name")


@query("p05_token_prefix_suffix", "SELECT entity_id, name FROM vertices WHERE starts_with(lower(name), 'order ') OR ends_with(lower(name), ' order')")
def _(g: Graph) -> DataFrame:
    return name_edge_token(g.vertices, "order").select("entity_id", "name")


_LOW, _HIGH = "DATE '2020-06-01'", "DATE '2020-09-01'"


@query(
    "p06_interval_predicates",
    f"""SELECT entity_type, sum(CASE WHEN (valid_from IS NULL OR valid_from <= {_HIGH}) AND (valid_to IS NULL OR valid_to >= {_LOW}) THEN 1 ELSE 0 END)::BIGINT AS n_overlap,
    sum(CASE WHEN (valid_from IS NULL OR valid_from <= {_LOW}) AND (valid_to IS NULL OR valid_to >= {_HIGH}) THEN 1 ELSE 0 END)::BIGINT AS n_cover FROM vertices GROUP BY 1""",
)
def _(g: Graph) -> DataFrame:
    low, high = F.expr(_LOW), F.expr(_HIGH)
    start, end = F.col("valid_from"), F.col("valid_to")
    return g.vertices.groupBy("entity_type").agg(
        F.sum(overlaps(start, end, low, high).cast("long")).alias("n_overlap"), F.sum(covers(start, end, low, high).cast("long")).alias("n_cover")
    )


@query(
    "p07_violation_containment",
    "SELECT module, count(*) AS n FROM (SELECT module, CASE WHEN confidence < 0.2 THEN ['low_confidence', 'weak'] WHEN amount > 45 THEN ['range'] ELSE [] END AS rules FROM claims) WHERE list_contains(rules, 'low_confidence') GROUP BY 1",
)
def _(g: Graph) -> DataFrame:
    rules = F.when(F.col("confidence") < 0.2, F.array(F.lit("low_confidence"), F.lit("weak"))).when(F.col("amount") > 45, F.array(F.lit("range"))).otherwise(F.array().cast("array<string>"))
    violations = F.transform(rules, lambda r: F.struct(F.lit("warning").alias("severity"), r.alias("rule")))
    hit = F.exists("violations", lambda v: v["rule"] == "low_confidence")
    return g.claims.withColumn("violations", violations).filter(hit).groupBy("module").agg(F.count("*").alias("n"))


@query("p08_array_containment", "SELECT document, count(*) AS n FROM (SELECT document, list(DISTINCT rel_type) AS rels FROM edges GROUP BY document) WHERE list_contains(rels, 'part_of') GROUP BY 1")
def _(g: Graph) -> DataFrame:
    grouped = g.edges.groupBy("document").agg(F.collect_set("rel_type").alias("rels"))
    return grouped.filter(F.array_contains("rels", "part_of")).groupBy("document").agg(F.count("*").alias("n"))


@query(
    "p09_json_key_extract",
    "SELECT event_type, count(*) FILTER (json_exists(props, '$.page')) AS with_page, count(DISTINCT json_extract_string(props, '$.page')) AS pages FROM events GROUP BY 1",
)
def _(g: Graph) -> DataFrame:
    page = F.get_json_object("props", "$.page")
    return g.table("events").groupBy("event_type").agg(F.count(page).alias("with_page"), F.countDistinct(page).alias("pages"))


@query(
    "p10_bar_tags",
    "SELECT thread, '|' || array_to_string(list_sort(list(DISTINCT tag)), '|') || '|' AS tags FROM (SELECT thread, CASE WHEN turn % 2 = 0 THEN 'pii' ELSE 'internal' END AS tag FROM messages) GROUP BY thread HAVING list_contains(list(tag), 'internal')",
)
def _(g: Graph) -> DataFrame:
    tagged = g.messages.withColumn("tag", F.when(F.col("turn") % 2 == 0, "pii").otherwise("internal"))
    bars = tagged.groupBy("thread").agg(tags_to_bar(F.collect_list("tag")).alias("tags"))
    return bars.filter(has_tag(F.col("tags"), "internal"))


@query("p11_is_distinct_from", "SELECT entity_type, count(*) AS n FROM vertices WHERE deprecated IS DISTINCT FROM false GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return g.vertices.filter(~F.col("deprecated").eqNullSafe(False)).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("p12_order_not_null_guard", "SELECT entity_id, valid_to FROM vertices WHERE valid_to IS NOT NULL ORDER BY valid_to DESC, entity_id LIMIT 25")
def _(g: Graph) -> DataFrame:
    return g.vertices.filter(F.col("valid_to").isNotNull()).orderBy(F.desc("valid_to"), "entity_id").limit(25).select("entity_id", "valid_to")


@query("p13_intent_column_pruning", "SELECT entity_type, count(*) AS n, sum(2)::BIGINT AS omitted FROM vertices WHERE name IS NOT NULL AND module IS NOT NULL GROUP BY 1")
def _(g: Graph) -> DataFrame:
    props = properties(g.vertices.filter("name IS NOT NULL AND module IS NOT NULL"))
    pruned = props.withColumn("kept", keep_properties(F.col("props"), ["name", "module"]))
    omitted = F.size("props") - F.size("kept")
    return pruned.groupBy("entity_type").agg(F.count("*").alias("n"), F.sum(omitted.cast("long")).alias("omitted"))


@query("p14_internal_property_projection", "SELECT entity_id, 'module=' || module || ',name=' || name AS shown FROM vertices WHERE entity_type = 'supplier'")
def _(g: Graph) -> DataFrame:
    shown = drop_properties(F.col("props"), INTERNAL_PROPERTIES)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(shown)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return properties(of_types(g.vertices, ["supplier"])).select("entity_id", text.alias("shown"))


@query(
    "p15_layer_projection",
    "SELECT entity_id, layer, CASE layer WHEN 'provenance' THEN 1 WHEN 'governance' THEN 0 ELSE 4 END AS n_props FROM (SELECT entity_id, CASE entity_key % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'temporal' WHEN 2 THEN 'provenance' ELSE 'governance' END AS layer FROM vertices WHERE entity_type = 'part')",
)
def _(g: Graph) -> DataFrame:
    layer = F.element_at(F.array(*map(F.lit, ("domain", "temporal", "provenance", "governance"))), (F.col("entity_key") % 4 + 1).cast("int"))
    layered = properties(of_types(g.vertices, ["part"])).withColumn("layer", layer)
    surface = (
        F.when(F.col("layer").isin("domain", "temporal"), F.col("props"))
        .when(F.col("layer") == "provenance", keep_properties(F.col("props"), ["confidence", "source_document_id", "extracted_at", "evidence"]))
        .otherwise(F.map_filter("props", lambda k, v: F.lit(False)))
    )
    return layered.select("entity_id", "layer", F.size(surface).alias("n_props"))


@query(
    "p16_longest_prefix_namespace",
    """SELECT t.entity_type, p.prefix AS namespace FROM (SELECT DISTINCT entity_type FROM vertices) t
    LEFT JOIN (VALUES ('p'), ('pa'), ('part'), ('reg'), ('c'), ('ord')) p(prefix) ON starts_with(t.entity_type, p.prefix)
    QUALIFY row_number() OVER (PARTITION BY t.entity_type ORDER BY length(p.prefix) DESC NULLS LAST) = 1""",
)
def _(g: Graph) -> DataFrame:
    prefixes = g.spark.createDataFrame([(p,) for p in ("p", "pa", "part", "reg", "c", "ord")], "prefix string")
    types = g.vertices.select("entity_type").distinct()
    joined = types.join(F.broadcast(prefixes), F.col("entity_type").startswith(F.col("prefix")), "left")
    return joined.groupBy("entity_type").agg(F.max_by("prefix", F.length("prefix")).alias("namespace"))


@query("p17_permission_predicate", "SELECT entity_id FROM vertices WHERE module IN ('BUILDING', 'geo') AND NOT contains(name, '|secret|') AND deprecated = false")
def _(g: Graph) -> DataFrame:
    from loomgraph.operators.security import secure

    return live(g.vertices).transform(secure, ["BUILDING", "geo"], ["secret"], "name").select("entity_id")


@query("p18_redaction_posture", "SELECT entity_id, CASE WHEN entity_key % 3 = 1 THEN NULL ELSE name END AS name FROM vertices WHERE entity_type = 'customer' AND entity_key % 3 <> 0")
def _(g: Graph) -> DataFrame:
    posture = F.when(F.col("entity_key") % 3 == 0, "deny").when(F.col("entity_key") % 3 == 1, "partial").otherwise("full")
    shown = of_types(g.vertices, ["customer"]).withColumn("posture", posture).filter("posture <> 'deny'")
    return shown.select("entity_id", F.when(F.col("posture") == "full", F.col("name")).alias("name"))


@query("p19_filter_fingerprint", "SELECT entity_id, md5('type=nation;module=geo') AS fingerprint FROM vertices WHERE entity_type = 'nation' AND module = 'geo'")
def _(g: Graph) -> DataFrame:
    return of_types(g.vertices, ["nation"]).filter("module = 'geo'").select("entity_id", F.md5(F.lit("type=nation;module=geo").cast("binary")).alias("fingerprint"))


@query(
    "p20_threshold_bands",
    "SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.2 THEN 'low' ELSE 'insufficient' END AS band, count(*) AS n FROM claims GROUP BY 1",
)
def _(g: Graph) -> DataFrame:
    b = band(F.col("confidence"), [(0.8, "high"), (0.5, "medium"), (0.2, "low")], "insufficient")
    return g.claims.groupBy(b.alias("band")).agg(F.count("*").alias("n"))
