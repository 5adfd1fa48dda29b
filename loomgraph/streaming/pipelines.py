"""Structured Streaming: ingest, deduplication, triage, windows, sessions, tag propagation.

Every transformation takes a streaming or a batch DataFrame; ``drain`` runs a stream over what is there and
returns what it wrote, which must equal the batch result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import ascii_edges, pii_count
from loomgraph.plans.model import Graph
from loomgraph.plans.registry import query
from loomgraph.session import shared_path


def read_stream(g: Graph, table: str) -> DataFrame:
    """A file stream over a table's Parquet files, whether the table is one file or a folder of them."""
    path = g.spark._jvm.org.apache.hadoop.fs.Path(f"{g.sf_dir}/{table}.parquet")
    stream = g.spark.readStream.schema(g.table(table).schema)
    if path.getFileSystem(g.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream.parquet(f"{g.sf_dir}/{table}.parquet")
    return stream.option("pathGlobFilter", f"{table}.parquet").parquet(g.sf_dir)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream to the end of what is there, writing each micro-batch once, and reads it back."""
    spark = stream.sparkSession
    out, checkpoint = shared_path(spark, "stream"), shared_path(spark, "stream-checkpoint")
    epochs = []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # a repeated epoch replaces itself
        epochs.append(epoch)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(write).start().awaitTermination()
    if not epochs:  # nothing there to stream
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(out + "/epoch=*")


def deduplicate(messages: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return messages.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def triage(body: Column, sender: Column) -> Column:
    """First matching rule decides, in this order."""
    low = F.lower(body)
    return F.coalesce(
        F.when(F.length(F.trim(body)) == 0, "filtered_empty"),
        F.when(sender.startswith("system"), "filtered_system"),
        F.when(low.rlike(ascii_edges(r"\bunsubscribe\b|\bnewsletter\b")), "filtered_bulk"),
        F.when(F.length(body) < 40, "filtered_short"),
        F.when(pii_count(body) > 0, "review_pii"),
        F.lit("passed"),
    )


def tumbling(events: DataFrame, at: str, size: str, key: str, delay: str = "10 minutes") -> DataFrame:
    grouped = events.withWatermark(at, delay).groupBy(F.window(at, size), key)
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, key: str) -> DataFrame:
    grouped = events.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("start"), "n")


def since(df: DataFrame, at: str, high_water: str) -> DataFrame:
    """Rows after a high-water mark."""
    return df.filter(F.col(at) > F.lit(high_water).cast("timestamp"))


def _events(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


_TRIAGE = """CASE WHEN length(trim(body)) = 0 THEN 'filtered_empty' WHEN starts_with(sender, 'system') THEN 'filtered_system' WHEN regexp_matches(lower(body), '\\bunsubscribe\\b|\\bnewsletter\\b') THEN 'filtered_bulk'
    WHEN length(body) < 40 THEN 'filtered_short' WHEN regexp_matches(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') OR regexp_matches(body, '\\b\\d{3}[-.]\\d{3}[-.]\\d{4}\\b') OR regexp_matches(body, '\\b\\d{3}-\\d{2}-\\d{4}\\b') OR regexp_matches(body, '\\b\\d{9}\\b') THEN 'review_pii' ELSE 'passed' END"""


@query("st01_incremental_ingest", "SELECT event_id, event_type FROM events")
def _(g: Graph) -> DataFrame:
    return drain(read_stream(g, "events").select("event_id", "event_type"))


@query("st02_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(g: Graph) -> DataFrame:
    stream = _events(read_stream(g, "events")).withColumn("k", F.concat_ws("|", "user_id", "event_type"))
    return drain(deduplicate(stream, "k", "ts", "60 days").select("user_id", "event_type"))


@query("st03_triage_rules", f"SELECT message_id, {_TRIAGE} AS outcome FROM messages")
def _(g: Graph) -> DataFrame:
    return g.messages.select("message_id", triage(F.col("body"), F.col("sender")).alias("outcome"))


@query("st04_stream_static_join", "SELECT e.event_id, c.c_mktsegment AS segment FROM events e JOIN customer c ON e.user_id = c.c_custkey")
def _(g: Graph) -> DataFrame:
    static = g.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return drain(read_stream(g, "events").select("event_id", "user_id").join(static, "user_id").select("event_id", "segment"))


@query("st07_retriage", f"SELECT outcome, count(*) AS n FROM (SELECT {_TRIAGE} AS outcome FROM messages) WHERE starts_with(outcome, 'filtered_') GROUP BY 1")
def _(g: Graph) -> DataFrame:
    outcome = triage(F.col("body"), F.col("sender"))
    return g.messages.select(outcome.alias("outcome")).filter(F.col("outcome").startswith("filtered_")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("st08_high_water_mark", "SELECT count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-10 12:00:00'")
def _(g: Graph) -> DataFrame:
    return since(_events(g.table("events")), "ts", "2024-01-10 12:00:00").agg(F.count("*").alias("n"))


@query("st09_tag_propagation", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tags FROM events GROUP BY 1")
def _(g: Graph) -> DataFrame:
    grouped = read_stream(g, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("tags"))
    return drain(grouped, "complete")


@query("st10_tumbling_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(g: Graph) -> DataFrame:
    return drain(tumbling(_events(read_stream(g, "events")), "ts", "1 day", "event_type"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "st11_session_windows",
    "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts - p >= INTERVAL 6 HOUR GROUP BY 1",
)
def _(g: Graph) -> DataFrame:
    return sessions(_events(g.table("events")), "ts", "6 hours", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"))


def closed_sessions(events: DataFrame, at: str, gap: str, key: str, delay: str) -> DataFrame:
    """Sessions of a stream, each sent once when the watermark has passed its end; rows behind the watermark are left out."""
    return sessions(events.withWatermark(at, delay), at, gap, key)


@query(
    "st11_session_stream",
    "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts - p >= INTERVAL 6 HOUR GROUP BY 1",
)
def _(g: Graph) -> DataFrame:
    found = drain(sessions(_events(read_stream(g, "events")), "ts", "6 hours", "user_id"), "complete")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"))


@query(
    "st05_semantic_triage",
    """SELECT vec_id, CASE WHEN max(round(list_cosine_similarity(e, t), 6)) < 0.3 THEN 'filtered_semantic' ELSE 'passed' END AS outcome
    FROM (SELECT a.vec_id, a.embedding::DOUBLE[] AS e, b.embedding::DOUBLE[] AS t FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0) GROUP BY 1""",
)
def _(g: Graph) -> DataFrame:
    from loomgraph.operators.resolution import greatest_similarity

    e = g.table("embeddings")
    ontology = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("term"), F.col("embedding").alias("vector"))
    scored = greatest_similarity(e, "vec_id", "embedding", ontology, "term")
    return scored.select("vec_id", F.when(F.col("similarity") < 0.3, "filtered_semantic").otherwise("passed").alias("outcome"))


@query("st06_cost_budget", "SELECT message_id FROM (SELECT message_id, sum(length(body)) OVER (PARTITION BY thread ORDER BY turn, message_id ROWS UNBOUNDED PRECEDING) AS spent FROM messages) WHERE spent <= 1000")
def _(g: Graph) -> DataFrame:
    from pyspark.sql import Window

    spent = F.sum(F.length("body")).over(Window.partitionBy("thread").orderBy("turn", "message_id").rowsBetween(Window.unboundedPreceding, 0))
    return g.messages.withColumn("spent", spent).filter("spent <= 1000").select("message_id")
