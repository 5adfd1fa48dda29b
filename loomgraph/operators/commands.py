"""Change commands read from text: a grammar of column expressions, short forms resolved by a join to the schema.

A command is a verb phrase and names in single quotes. Commands on a property may leave out their class; it is then the one
class of the schema that has such a property.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.ontology import _S, _schema
from loomgraph.plans.model import Graph
from loomgraph.plans.registry import query

NAME = r"'([^']+)'"
CLASS = r"(?:\s+(?:{0})\s+class\s+" + NAME + ")?"
#: Fixed forms: the kinds of commands, their patterns, and which field each quoted name (or word in brackets) fills.
FORMS: dict[str, tuple[str, tuple[str, ...]]] = {
    "create class": (rf"create\s+class\s+{NAME}", ("target",)),
    "obsolete class": (rf"obsolete\s+class\s+{NAME}", ("target",)),
    "change description": (rf"change\s+description\s+of\s+{NAME}", ("target",)),
    "create relationship": (rf"create\s+relationship\s+{NAME}", ("target",)),
    "obsolete relationship": (rf"obsolete\s+relationship\s+{NAME}", ("target",)),
    "change relationship": (rf"change\s+relationship\s+{NAME}", ("target",)),
    "add property": (rf"add\s+property\s+{NAME}\s+to\s+class\s+{NAME}", ("property", "target")),
    "remove property": (rf"remove\s+property\s+{NAME}{CLASS.format('from')}", ("property", "target")),
    "change property": (rf"change\s+property\s+{NAME}{CLASS.format('on|of')}", ("property", "target")),
    "add synonym": (rf"add\s+synonym\s+{NAME}\s+for\s+class\s+{NAME}", ("new_name", "target")),
    "rename property": (rf"rename\s+property\s+{NAME}\s+to\s+{NAME}{CLASS.format('on|of')}", ("property", "new_name", "target")),
    "split class": (rf"split\s+class\s+{NAME}\s+into((?:\s+{NAME.replace('(', '(?:')}){{2,}})", ("target", "into")),
    "move class": (rf"move\s+class\s+{NAME}\s+from\s+{NAME}\s+to\s+{NAME}", ("target", "old_name", "new_name")),
    "change domain or range": (rf"change\s+(domain|range)\s+of\s+{NAME}\s+to\s+{NAME}", ("side", "target", "new_name")),
}
#: Kinds whose class may be left out.
SHORT = ("remove property", "change property", "rename property")
FIELDS = ("target", "property", "old_name", "new_name", "side", "into")


def parsed(line: Column) -> Column:
    """A struct kind, FIELDS and error of a command; error says what is wrong, and the rest is null then (``into`` is an array)."""
    text = F.trim(line)

    def form(kind: str) -> Column:
        pattern, fields = FORMS[kind]
        whole = rf"^(?i:{pattern})\s*$"
        values = {f: F.nullif(F.regexp_extract(text, whole, k), F.lit("")) for k, f in enumerate(fields, 1)}
        into = F.regexp_extract_all(values.pop("into"), F.lit(NAME), 1) if "into" in values else F.lit(None).cast("array<string>")
        columns = [(F.lower(values[f]) if f == "side" else values[f]) if f in values else F.lit(None).cast("string") for f in FIELDS[:-1]]
        return F.when(text.rlike(whole), F.struct(F.lit(kind).alias("kind"), *(c.alias(f) for c, f in zip(columns, FIELDS)), into.alias("into"), F.lit(None).cast("string").alias("error")))

    verbs = {kind: r"change\s+(domain|range)\b" if kind == "change domain or range" else kind.replace(" ", r"\s+") + r"\b" for kind in FORMS}
    begun = F.coalesce(*(F.when(text.rlike(f"^(?i:{v})"), F.lit(f"malformed {k}")) for k, v in verbs.items()), F.lit("unknown command"))
    error = F.when(F.coalesce(text, F.lit("")) == "", "empty command").when((F.length(text) - F.length(F.replace(text, F.lit("'"), F.lit("")))) % 2 == 1, "open quote").otherwise(begun)
    nothing = F.struct(F.lit(None).cast("string").alias("kind"), *(F.lit(None).cast("string").alias(f) for f in FIELDS[:-1]), F.lit(None).cast("array<string>").alias("into"), error.alias("error"))
    return F.coalesce(*map(form, FORMS), nothing)


def read_commands(lines: DataFrame, column: str, schema: DataFrame) -> DataFrame:
    """``lines`` with kind, the fields and error of the command in ``column``; ``schema`` (class, property) resolves commands
    that leave out their class: none has the property: ``not found``; several: ``ambiguous``."""
    read = lines.withColumn("__c", parsed(F.col(column))).select(*lines.columns, "__c.*")
    short = F.col("target").isNull() & F.col("kind").isin(*SHORT)
    owners = schema.filter("property is not null").groupBy(F.col("property").alias("__p")).agg(F.min("class").alias("__first"), F.max("class").alias("__last"))
    # rows that need no owner have no key, and are not gathered by one
    keyed = read.withColumn("__key", F.when(short, F.col("property")))
    met = keyed.join(owners, F.col("__key") == F.col("__p"), "left")
    fault = F.when(short & F.col("__p").isNull(), "not found").when(short & (F.col("__first") != F.col("__last")), "ambiguous")
    found = F.when(short & fault.isNull(), F.col("__first")).otherwise(F.col("target"))
    return met.withColumns({"target": found, "error": F.coalesce("error", fault)}).drop("__key", "__p", "__first", "__last")


@query(
    "o01_change_commands",
    f"""WITH {_S}, o AS (SELECT property, min(class) AS a, max(class) AS b FROM s GROUP BY 1)
    SELECT class, property, 'remove property' AS kind, class AS target, NULL AS error, 'long' AS form FROM s
    UNION ALL SELECT class, s.property, 'rename property', CASE WHEN a = b THEN a END, CASE WHEN a <> b THEN 'ambiguous' END, 'short' FROM s JOIN o ON s.property = o.property
    UNION ALL SELECT class, property, NULL, NULL, 'malformed add property', 'broken' FROM s
    UNION ALL SELECT class, property, 'change property', NULL, 'not found', 'foreign' FROM s""",
)
def _(g: Graph) -> DataFrame:
    s = _schema(g)
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    texts = {
        "long": F.concat(F.lit("remove property "), quoted("property"), F.lit(" from class "), quoted("class")),
        "short": F.concat(F.lit("Rename  property "), quoted("property"), F.lit(" to 'x'")),
        "broken": F.concat(F.lit("add property "), quoted("property"), F.lit(" class "), quoted("class")),
        "foreign": F.concat(F.lit("change property 'no "), F.col("property"), F.lit("'")),
    }
    rows = s.select("class", "property", F.explode(F.array(*(F.struct(F.lit(k).alias("form"), t.alias("line")) for k, t in texts.items()))).alias("x")).select("class", F.col("property").alias("of"), "x.*")
    found = read_commands(rows, "line", s)
    return found.select("class", F.col("of").alias("property"), "kind", "target", "error", "form")
