"""Ontology algebra: schema tables, diffs, change commands, ratification, mapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.model import Graph
from loomgraph.plans.registry import query


def diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison by key: added, removed, modified or unchanged."""
    a = old.select(*keys, F.struct(*values).alias("__old"))
    b = new.select(*keys, F.struct(*values).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "modified")
    return a.join(b, keys, "full").withColumn("change", change.otherwise("unchanged"))


def invert_command(command: Column) -> Column:
    """The inverse of the three commands that have one; null for all others."""
    name = F.regexp_extract(command, "'([^']+)'", 1)
    return (
        F.when(command.rlike(r"^create class '"), F.concat(F.lit("obsolete class '"), name, F.lit("'")))
        .when(command.rlike(r"^create relationship '"), F.concat(F.lit("obsolete relationship '"), name, F.lit("'")))
        .when(command.rlike(r"^add property '"), F.regexp_replace(F.regexp_replace(command, "^add property", "remove property"), " to class ", " from class "))
    )


def commands_from_diff(changes: DataFrame, key: str) -> DataFrame:
    """One change command per added or removed class."""
    verb = F.when(F.col("change") == "added", "create class '").when(F.col("change") == "removed", "obsolete class '")
    return changes.filter(F.col("change").isin("added", "removed")).select(key, F.concat(verb, F.col(key), F.lit("'")).alias("command"))


def apply_command(schema: DataFrame, kind: str, **args: str) -> DataFrame:
    """One edit of a schema table (class, property, type): classes and properties created, removed, renamed, changed."""
    if kind == "create class":
        return schema.union(schema.sparkSession.createDataFrame([(args["name"], None, None)], "class string, property string, type string"))
    if kind == "obsolete class":
        return schema.filter(F.col("class") != args["name"])
    if kind == "rename property":
        here = (F.col("class") == args["cls"]) & (F.col("property") == args["name"])
        return schema.withColumn("property", F.when(here, args["to"]).otherwise(F.col("property")))
    if kind == "change property":
        here = (F.col("class") == args["cls"]) & (F.col("property") == args["name"])
        return schema.withColumn("type", F.when(here, args["type"]).otherwise(F.col("type")))
    if kind == "add property":
        return schema.union(schema.sparkSession.createDataFrame([(args["cls"], args["name"], args["type"])], "class string, property string, type string"))
    if kind == "remove property":
        return schema.filter(~((F.col("class") == args["cls"]) & F.col("property").eqNullSafe(args["name"])))
    if kind == "split class":
        targets = args["into"].split(",")
        if len(targets) < 2:
            raise ValueError("a split needs two targets or more")
        moved = schema.filter(F.col("class") == args["name"]).withColumn("class", F.explode(F.array(*map(F.lit, targets))))
        return schema.filter(F.col("class") != args["name"]).union(moved)
    raise ValueError(f"unknown command {kind}")


def apply_commands(schema: DataFrame, commands: list[tuple[str, dict[str, str]]]) -> DataFrame:
    return reduce(lambda s, c: apply_command(s, c[0], **c[1]), commands, schema)


def ratify(types: DataFrame, relations: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types (name) after the latest decision each (name, decision, at, to), and the relations whose ends stay.

    No decision keeps; rejected and merged types go; renamed ones take their new name.
    """
    w = Window.partitionBy("name").orderBy(F.desc("at"))
    latest = decisions.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("name", "decision", "to")
    joined = types.join(latest, "name", "left").filter("decision IS NULL OR decision NOT IN ('reject', 'merge')")
    kept = joined.select("name", F.when(F.col("decision") == "rename", F.col("to")).otherwise(F.col("name")).alias("final"))
    ends = kept.select("name")
    rel = relations.join(ends.withColumnRenamed("name", "source_type"), "source_type", "left_semi").join(ends.withColumnRenamed("name", "target_type"), "target_type", "left_semi")
    return kept, rel


def extension_faults(mother: DataFrame, child: DataFrame) -> DataFrame:
    """Properties (class, property, type) of the mother that the child lacks or types otherwise."""
    c = child.select("class", "property", F.col("type").alias("child_type"))
    joined = mother.join(c, ["class", "property"], "left")
    fault = F.when(F.col("child_type").isNull(), "missing").when(F.col("child_type") != F.col("type"), "type_change")
    return joined.withColumn("fault", fault).filter("fault IS NOT NULL").select("class", "property", "fault")


def compile_type(ontology_type: Column) -> Column:
    """Ontology types as Spark types; unknown ones are strings."""
    names = {"string": "string", "text": "string", "reference": "string", "integer": "int", "long": "bigint", "float": "double", "double": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp", "list": "array<string>"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(ontology_type)), F.lit("string"))


_SCHEMA = "SELECT p_brand AS class, p_type AS property, CASE p_size % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' ELSE 'geo' END AS type FROM part"


def _schema(g: Graph) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "string").when(F.col("p_size") % 3 == 1, "integer").otherwise("geo")
    rows = g.table("part").select(F.col("p_brand").alias("class"), F.col("p_type").alias("property"), kind.alias("type"))
    return rows.groupBy("class", "property").agg(F.min("type").alias("type"))


_S = f"s AS (SELECT class, property, min(type) AS type FROM ({_SCHEMA}) GROUP BY 1, 2)"


@query("o02_apply_commands", f"WITH {_S} SELECT class, count(*) AS n FROM (SELECT class, property FROM s WHERE class <> 'Brand#1' UNION ALL SELECT 'Extra', NULL) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    edited = apply_commands(_schema(g), [("create class", {"name": "Extra"}), ("obsolete class", {"name": "Brand#1"})])
    return edited.groupBy("class").agg(F.count("*").alias("n"))


@query("o03_invert_commands", "SELECT s_name, CASE s_suppkey % 3 WHEN 0 THEN 'obsolete class ''' || s_name || '''' WHEN 1 THEN 'remove property ''p'' from class ''' || s_name || '''' END AS inverse FROM supplier")
def _(g: Graph) -> DataFrame:
    name = F.concat(F.lit("'"), F.col("s_name"), F.lit("'"))
    k = F.col("s_suppkey") % 3
    command = F.when(k == 0, F.concat(F.lit("create class "), name)).when(k == 1, F.concat(F.lit("add property 'p' to class "), name)).otherwise(F.concat(F.lit("describe class "), name))
    return g.table("supplier").select("s_name", invert_command(command).alias("inverse"))


@query("o04_commands_from_diff", "WITH a AS (SELECT DISTINCT p_brand AS class FROM part WHERE p_size < 10), b AS (SELECT DISTINCT p_brand AS class FROM part WHERE p_size = 7) SELECT class, 'obsolete class ''' || class || '''' AS command FROM a WHERE class NOT IN (SELECT class FROM b) UNION ALL SELECT class, 'create class ''' || class || '''' FROM b WHERE class NOT IN (SELECT class FROM a)")
def _(g: Graph) -> DataFrame:
    classes = lambda cond: g.table("part").filter(cond).select(F.col("p_brand").alias("class")).distinct().withColumn("v", F.lit(1))
    return commands_from_diff(diff(classes("p_size < 10"), classes("p_size = 7"), ["class"], ["v"]), "class")


@query("o05_ratified_schema", "SELECT t.name, CASE WHEN k % 5 = 2 THEN t.name || '_v2' ELSE t.name END AS final FROM (SELECT DISTINCT p_brand AS name FROM part) t JOIN (SELECT DISTINCT p_brand AS name, length(p_brand) + ascii(right(p_brand, 1)) AS k FROM part) d ON t.name = d.name WHERE k % 5 NOT IN (0, 1)")
def _(g: Graph) -> DataFrame:
    types = g.table("part").select(F.col("p_brand").alias("name")).distinct()
    k = (F.length("name") + F.ascii(F.expr("right(name, 1)"))) % 5
    decision = F.when(k == 0, "reject").when(k == 1, "merge").when(k == 2, "rename").otherwise("accept")
    decisions = types.select("name", decision.alias("decision"), F.lit(1).alias("at"), F.concat("name", F.lit("_v2")).alias("to"))
    kept, _ = ratify(types, g.spark.createDataFrame([], "source_type string, target_type string"), decisions)
    return kept


@query("o07_module_partition", f"WITH {_S} SELECT type, count(DISTINCT class) AS classes, count(*) AS properties FROM s GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return _schema(g).groupBy("type").agg(F.countDistinct("class").alias("classes"), F.count("*").alias("properties"))


@query("o08_extension_faults", f"WITH {_S} SELECT class, property, 'missing' AS fault FROM s WHERE type = 'geo' UNION ALL SELECT class, property, 'type_change' FROM s WHERE type = 'integer'")
def _(g: Graph) -> DataFrame:
    mother = _schema(g)
    child = mother.filter("type <> 'geo'").withColumn("type", F.when(F.col("type") == "integer", "string").otherwise(F.col("type")))
    return extension_faults(mother, child)


@query("o09_version_hash_chain", "SELECT version, sha256(payload || coalesce(lag(payload) OVER (ORDER BY version), '')) AS chained FROM (SELECT n_regionkey AS version, sha256(string_agg(n_name, ',' ORDER BY n_name)) AS payload FROM nation GROUP BY 1)")
def _(g: Graph) -> DataFrame:
    names = F.array_join(F.array_sort(F.collect_list("n_name")), ",")
    versions = g.table("nation").groupBy(F.col("n_regionkey").alias("version")).agg(F.sha2(names, 256).alias("payload"))
    before = F.coalesce(F.lag("payload").over(Window.orderBy("version")), F.lit(""))
    return versions.select("version", F.sha2(F.concat("payload", before), 256).alias("chained"))


@query("o11_type_mapping", f"WITH {_S} SELECT DISTINCT type, CASE type WHEN 'integer' THEN 'int' ELSE 'string' END AS spark_type FROM s")
def _(g: Graph) -> DataFrame:
    return _schema(g).select("type", compile_type(F.col("type")).alias("spark_type")).distinct()


def map_source_schema(source: DataFrame, mapping: DataFrame, prefix: str) -> DataFrame:
    """Source properties (class, property, type) as a child schema: mapped names, string where no type is known."""
    m = mapping.select(F.col("from").alias("property"), F.col("to").alias("__to"))
    joined = source.join(m, "property", "left")
    return joined.select(F.concat(F.lit(prefix + "_"), "class").alias("class"), F.coalesce("__to", "property").alias("property"), F.coalesce("type", F.lit("string")).alias("type"))


@query("o06_impact_preview", "SELECT subject, bool_or(predicate <> 'made_by') AS still_covered FROM claims GROUP BY 1")
def _(g: Graph) -> DataFrame:
    left = g.claims.filter("predicate <> 'made_by'").select("subject", F.lit(True).alias("kept")).distinct()
    return g.claims.select("subject").distinct().join(left, "subject", "left").select("subject", F.coalesce("kept", F.lit(False)).alias("still_covered"))


@query("o10_incremental_ddl", "SELECT 'ALTER TABLE vertices ADD COLUMN ' || lower(replace(p, ' ', '_')) || ' string' AS ddl FROM (SELECT DISTINCT p_type AS p FROM part WHERE p_size >= 10 EXCEPT SELECT p_type FROM part WHERE p_size < 10)")
def _(g: Graph) -> DataFrame:
    of = lambda cond: g.table("part").filter(cond).select("p_type").distinct().withColumn("v", F.lit(1))
    added = diff(of("p_size < 10"), of("p_size >= 10"), ["p_type"], ["v"]).filter("change = 'added'")
    return added.select(F.concat(F.lit("ALTER TABLE vertices ADD COLUMN "), F.lower(F.regexp_replace("p_type", " ", "_")), F.lit(" string")).alias("ddl"))


@query("o12_source_mapping", f"WITH {_S} SELECT 'src_' || class AS class, CASE WHEN property = 'SMALL PLATED COPPER' THEN 'material' ELSE property END AS property, type FROM s")
def _(g: Graph) -> DataFrame:
    mapping = g.spark.createDataFrame([("SMALL PLATED COPPER", "material")], "from string, to string")
    return map_source_schema(_schema(g), mapping, "src")
