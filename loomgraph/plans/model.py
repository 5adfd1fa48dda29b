"""The property graph and its companions as views over the star-schema tables.

Each view is one SELECT that Spark and DuckDB read alike, so a query and its SQL check start from the
same rows. Libraries that hold real vertices and edges pass their own DataFrames instead.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from loomgraph.session import tasks_for

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _vertex(kind: str, table: str, key: str, name: str, module: str, origin: str) -> str:
    return f"""SELECT '{kind}:' || CAST({key} AS STRING) AS entity_id, '{kind}' AS entity_type, {name} AS name, {module} AS module,
      CAST({key} % 100 AS DOUBLE) / 100 AS confidence, CASE WHEN {key} % 29 = 3 THEN NULL ELSE {key} % 17 = 5 END AS deprecated,
      CAST('2020-01-01' AS DATE) + CAST({key} % 700 AS INT) AS valid_from,
      CASE WHEN {key} % 5 = 0 THEN NULL ELSE CAST('2020-01-01' AS DATE) + CAST({key} % 700 + 100 + {key} % 400 AS INT) END AS valid_to,
      {origin} AS origin, CAST({key} AS BIGINT) AS entity_key FROM {table}"""


_ORIGIN = "CASE WHEN {k} % 3 = 0 THEN 'document' WHEN {k} % 3 = 1 THEN 'communication' ELSE NULL END"

VIEWS: dict[str, str] = {
    "vertices": " UNION ALL ".join(
        [
            _vertex("region", "region", "r_regionkey", "r_name", "'geo'", "'document'"),
            _vertex("nation", "nation", "n_nationkey", "n_name", "'geo'", "'document'"),
            _vertex("customer", "customer", "c_custkey", "c_name", "c_mktsegment", _ORIGIN.format(k="c_custkey")),
            _vertex("supplier", "supplier", "s_suppkey", "s_name", "'supply'", _ORIGIN.format(k="s_suppkey")),
            _vertex("part", "part", "p_partkey", "p_name", "p_brand", _ORIGIN.format(k="p_partkey")),
            _vertex("order", "orders", "o_orderkey", "'Order ' || CAST(o_orderkey AS STRING)", "o_orderpriority", _ORIGIN.format(k="o_orderkey")),
        ]
    ),
    "edges": """
      SELECT 'located_in' AS rel_type, 'customer:' || CAST(c_custkey AS STRING) AS source, 'nation:' || CAST(c_nationkey AS STRING) AS target,
        CAST(c_custkey % 10 AS DOUBLE) / 10 AS confidence, c_custkey % 23 = 0 AS deprecated, 'doc:' || CAST(c_custkey % 50 AS STRING) AS document FROM customer
      UNION ALL SELECT 'located_in', 'supplier:' || CAST(s_suppkey AS STRING), 'nation:' || CAST(s_nationkey AS STRING),
        CAST(s_suppkey % 10 AS DOUBLE) / 10, s_suppkey % 23 = 0, 'doc:' || CAST(s_suppkey % 50 AS STRING) FROM supplier
      UNION ALL SELECT 'part_of', 'nation:' || CAST(n_nationkey AS STRING), 'region:' || CAST(n_regionkey AS STRING), CAST(1 AS DOUBLE), false, 'doc:0' FROM nation
      UNION ALL SELECT 'placed', 'customer:' || CAST(o_custkey AS STRING), 'order:' || CAST(o_orderkey AS STRING),
        CAST(o_orderkey % 10 AS DOUBLE) / 10, o_orderkey % 23 = 0, 'doc:' || CAST(o_orderkey % 50 AS STRING) FROM orders
      UNION ALL SELECT 'contains', 'order:' || CAST(l_orderkey AS STRING), 'part:' || CAST(l_partkey AS STRING),
        CAST(l_linenumber AS DOUBLE) / 10, l_linenumber = 7, 'doc:' || CAST(l_orderkey % 50 AS STRING) FROM lineitem
      UNION ALL SELECT 'supplies', 'supplier:' || CAST(l_suppkey AS STRING), 'part:' || CAST(l_partkey AS STRING), CAST(1 AS DOUBLE), false, 'doc:1'
        FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) s""",
    "claims": """
      SELECT CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) AS claim_id, 'doc:' || CAST(l_orderkey AS STRING) AS document_id,
        'chunk:' || CAST(l_orderkey AS STRING) AS chunk_id, 'part:' || CAST(l_partkey AS STRING) AS subject, 'part' AS subject_type,
        CASE l_linenumber % 3 WHEN 0 THEN 'made_by' WHEN 1 THEN 'sold_by' ELSE 'shipped_by' END AS predicate,
        'supplier:' || CAST(l_suppkey AS STRING) AS object, 'supplier' AS object_type,
        CASE l_returnflag WHEN 'A' THEN 'SUPPORTED' WHEN 'N' THEN 'INSUFFICIENT' ELSE 'REFUTED' END AS verdict,
        CASE WHEN l_linestatus = 'O' THEN 'accepted' ELSE 'quarantined' END AS status,
        CAST(l_orderkey % 100 AS DOUBLE) / 100 AS confidence, CAST(l_shipdate AS DATE) AS created_on, 'm' || CAST(l_suppkey % 5 AS STRING) AS module,
        CAST(l_quantity AS DOUBLE) AS amount, CAST(l_orderkey AS BIGINT) AS unit, CAST(l_linenumber AS INT) AS ordinal FROM lineitem""",
    "messages": """
      SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS message_id, CAST(conv_id AS BIGINT) AS thread, CAST(turn AS INT) AS turn,
        role || CAST(conv_id % 20 AS STRING) || CASE WHEN conv_id % 3 = 0 THEN '@inside.example' ELSE '@outside.example' END AS sender,
        CASE conv_id % 4 WHEN 0 THEN 'Re: ' WHEN 1 THEN 'Fwd: ' WHEN 2 THEN 're: FW: ' ELSE '' END || 'Topic ' || CAST(conv_id % 30 AS STRING) AS subject,
        CASE WHEN turn > 0 THEN CAST(conv_id AS STRING) || '-' || CAST(turn - 1 AS STRING) END AS in_reply_to,
        CAST(CAST('2024-01-01' AS DATE) + CAST(conv_id % 28 AS INT) AS TIMESTAMP) AS day_start,
        CAST(conv_id % 28 AS BIGINT) * 86400 + CAST(conv_id % 600 AS BIGINT) * 60 + CAST(turn AS BIGINT) * (90 + conv_id % 50) AS sent_s,
        coalesce(text, '') AS body FROM conversations""",
    "samples": """
      SELECT event_type AS metric, CAST(user_id % 10 AS STRING) AS label, user_id, CAST(ts AS TIMESTAMP) AS ts, CAST(ts AS DATE) AS day,
        CAST(value AS DOUBLE) AS value, event_id FROM events""",
}


def with_views(sql: str) -> str:
    """The SELECT with the views it names put before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, re.I):
                need(body)
                needed.append(name)

    need(sql)
    if not needed:
        return sql
    parts = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {parts}, {body[len('WITH RECURSIVE'):]}"
    if re.match(r"WITH\b", body, re.I):
        return f"WITH {parts}, {body[len('WITH'):]}"
    return f"WITH {parts} {body}"


#: As a view has it, with its table bound.
SUPPLIES = "SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}"


class Graph:
    """The views of one data folder, read when used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        body = VIEWS[name]
        used = [t for t in TABLES if re.search(rf"\bFROM\s+{t}\b", body)]
        # names are bound as arguments, so two graphs never share a temporary view
        bound = {t: self.table(t) for t in used}
        body = re.sub(r"\bFROM\s+(\w+)", r"FROM {\1}", body)
        if SUPPLIES in body:
            # a task of a distinct holds its share of the pairs, so their number sets the tasks
            pairs = ["l_suppkey", "l_partkey"]
            bound["dealt"] = self.table("lineitem").select(*pairs).repartition(self.tasks("lineitem"), *pairs)
            body = body.replace(SUPPLIES, SUPPLIES.replace("{lineitem}", "{dealt}"))
        return self.spark.sql(body, **bound)

    def tasks(self, *tables: str) -> int:
        """Tasks for work whose rows are about as many as the tables have, which Parquet's footers tell."""
        return tasks_for(self.spark, sum(self.table(t).count() for t in tables))

    @cached_property
    def vertices(self) -> DataFrame:
        return self.view("vertices")

    @cached_property
    def edges(self) -> DataFrame:
        return self.view("edges")

    @cached_property
    def claims(self) -> DataFrame:
        return self.view("claims")

    @cached_property
    def messages(self) -> DataFrame:
        return self.view("messages")

    @cached_property
    def samples(self) -> DataFrame:
        return self.view("samples")
