"""Sources and sinks: mail files, file inventories, configured formats, fill-only merges, snapshots."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.model import Graph
from loomgraph.plans.registry import query

MESSAGE_SCHEMA = "path string, message_id string, sender string, recipients array<string>, subject string, sent_at string, in_reply_to string, references array<string>, body string"


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size, time and suffix of all files below a folder, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime", F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("suffix"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Listed paths of a JSON-lines manifest."""
    return spark.read.schema("path string").json(path)


def parse_message(raw: bytes) -> tuple:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    body = message.get_body(preferencelist=("plain", "html"))
    people = [a.addr_spec for h in ("to", "cc") for field in message.get_all(h, []) for a in getattr(field, "addresses", ())]
    text = body.get_content() if body is not None else ""
    refs = str(message.get("references", "")).split()
    sender = message.get("from")
    addresses = getattr(sender, "addresses", ())
    return (
        message.get("message-id"),
        addresses[0].addr_spec if addresses else None,
        people,
        message.get("subject"),
        message.get("date"),
        message.get("in-reply-to"),
        refs,
        text,
    )


def read_mail(spark: SparkSession, path: str, mailbox: bool = False) -> DataFrame:
    """Messages of .eml files, or of mbox files (messages begin at lines that open with 'From ')."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MESSAGE_SCHEMA.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
        for batch in batches:
            rows = []
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                parts = [b"From " + p for p in (b"\n" + content).split(b"\nFrom ")[1:]] if mailbox else [content]
                for part in parts:
                    raw = part.split(b"\n", 1)[1] if mailbox and b"\n" in part else part
                    rows.append((where, *(str(x) if x is not None and not isinstance(x, list) else x for x in parse_message(raw))))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return files.mapInArrow(parse, MESSAGE_SCHEMA)


def read_triples(lines: DataFrame, column: str = "value") -> DataFrame:
    """N-Triples lines as subject, predicate, object; comments and blank lines are left out."""
    pattern = r'^\s*(\S+)\s+(\S+)\s+(.+?)\s*\.\s*$'
    parts = [F.regexp_extract(column, pattern, k).alias(n) for k, n in ((1, "subject"), (2, "predicate"), (3, "object"))]
    return lines.filter(~F.col(column).startswith("#")).select(*parts).filter("subject <> ''")


def fill_only_merge(existing: DataFrame, incoming: DataFrame, keys: list[str], properties: list[str]) -> DataFrame:
    """Upsert that never overwrites: existing values stay, nulls are filled, new keys are added."""
    new = incoming.groupBy(*keys).agg(*(F.first(p, ignorenulls=True).alias(f"__{p}") for p in properties))
    joined = existing.join(new, keys, "full")
    return joined.select(*keys, *(F.coalesce(p, f"__{p}").alias(p) for p in properties))


def upsert_latest(current: DataFrame, changes: DataFrame, keys: list[str], *order) -> DataFrame:
    """Latest row per key of both sides (a snapshot to overwrite with)."""
    both = current.unionByName(changes)
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def split_valid(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Bulk insert with partial success: the rows that pass, and those that do not (null counts as not)."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def to_turtle(edges: DataFrame, prefix: str = "g") -> Column:
    """A triple per edge in Turtle."""
    local = lambda c: F.concat(F.lit(prefix + ":"), F.regexp_replace(c, "[^A-Za-z0-9]", "_"))
    return F.concat_ws(" ", local(F.col("source")), local(F.col("rel_type")), local(F.col("target")), F.lit("."))


def append_events(df: DataFrame, path: str) -> None:
    """Append-only event sink."""
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


@query("s07_instant_query", "SELECT metric, count(*) AS n, round(sum(value), 4) AS total FROM samples WHERE ts > TIMESTAMP '2024-01-14 00:00:00' AND ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def _(g: Graph) -> DataFrame:
    window = g.samples.filter("ts > TIMESTAMP '2024-01-14 00:00:00' AND ts <= TIMESTAMP '2024-01-15 00:00:00'")
    return window.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s08_range_query", "SELECT d.day::DATE AS day, count(s.event_id) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)) AS day) d LEFT JOIN samples s ON s.day = d.day::DATE AND s.metric = 'purchase' GROUP BY 1")
def _(g: Graph) -> DataFrame:
    days = g.spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)) AS day")
    counted = g.samples.filter("metric = 'purchase'").groupBy("day").agg(F.count("*").alias("n"))
    return days.join(counted, "day", "left").na.fill(0, ["n"])


@query("s15_incremental_load", "SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def _(g: Graph) -> DataFrame:
    return g.table("events").filter(F.col("ts") > F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id", "event_type")


@query("s16_triple_classes", "SELECT 'g:' || p_brand AS subject, count(*) AS n FROM part GROUP BY 1")
def _(g: Graph) -> DataFrame:
    line = F.concat(F.lit("g:"), F.col("p_brand"), F.lit(" rdf:type g:Part_"), F.col("p_partkey").cast("string"), F.lit(" ."))
    triples = read_triples(g.table("part").select(line.alias("value")))
    return triples.filter("predicate = 'rdf:type'").groupBy("subject").agg(F.count("*").alias("n"))


@query("s18_fill_only_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'new' END AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'seg' END AS segment FROM customer")
def _(g: Graph) -> DataFrame:
    old = g.table("customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("segment"))
    new = g.table("customer").select("c_custkey", F.lit("new").alias("name"), F.lit("seg").alias("segment"))
    return fill_only_merge(old, new, ["c_custkey"], ["name", "segment"])


@query("s19_edge_upsert", "SELECT rel_type, source, target, count(DISTINCT document) AS documents FROM edges WHERE rel_type <> 'placed' GROUP BY 1, 2, 3")
def _(g: Graph) -> DataFrame:
    grouped = g.edges.filter("rel_type <> 'placed'").groupBy("rel_type", "source", "target").agg(F.collect_set("document").alias("docs"))
    return grouped.select("rel_type", "source", "target", F.size("docs").cast("long").alias("documents"))


@query("s20_partial_success", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN confidence >= 0.1 AND length(name) > 3 THEN 'written' ELSE 'rejected' END AS status FROM vertices) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    good, bad = split_valid(g.vertices, (F.col("confidence") >= 0.1) & (F.length("name") > 3))
    return good.withColumn("status", F.lit("written")).union(bad.withColumn("status", F.lit("rejected"))).groupBy("status").agg(F.count("*").alias("n"))


@query("s22_idempotent_upsert", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def _(g: Graph) -> DataFrame:
    events = g.table("events").select("user_id", "event_id")
    old, new = events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")
    return upsert_latest(old, new, ["user_id"], F.desc("event_id"))


@query("s24_turtle_lines", "SELECT 'g:' || regexp_replace(source, '[^A-Za-z0-9]', '_', 'g') || ' g:' || rel_type || ' g:' || regexp_replace(target, '[^A-Za-z0-9]', '_', 'g') || ' .' AS line FROM edges WHERE rel_type IN ('located_in', 'part_of')")
def _(g: Graph) -> DataFrame:
    edges = g.edges.filter("rel_type IN ('located_in', 'part_of')")
    return edges.select(to_turtle(edges).alias("line"))
