"""Keyed state that ends: retriage of filtered messages, tags of a thread; and gauges beside a stream.

State is kept per key by ``transformWithState`` (RocksDB), has event-time timers, and is dropped when a key has
been quiet for its expiry. Rows behind the watermark are dropped by Spark; a restart goes on from the checkpoint.
"""

from __future__ import annotations

import datetime
from collections import deque
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from loomgraph.plans.model import Graph
from loomgraph.plans.registry import query
from loomgraph.streaming.pipelines import drain, read_stream, triage

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RETRIAGED = "message_id string, cycle long, state string, outcome string, at timestamp"
TAGGED = "thread string, message_id string, n_tags int, tags string"


class _Expiring(StatefulProcessor):
    """A processor whose key ends ``expiry_s`` seconds (of event time) after its last row."""

    def __init__(self, expiry_s: int):
        self.expiry_ms = expiry_s * 1000

    def postpone(self, last_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last_ms + self.expiry_ms)

    def close(self) -> None:
        pass


class Retriage(_Expiring):
    """States of one message only move on: filtered, still_filtered in later cycles, then passed (for good) or expired.

    A cycle that is not later than the last one seen is a repeat and changes nothing. A message keeps the outcome it was first filtered with until it passes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "cycle long, state string, outcome string, last_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        out = []
        known = tuple(self.state.get()) if self.state.exists() else None
        for r in sorted(rows, key=lambda r: (r.cycle, r.at)):
            if known is not None and (known[1] == "passed" or r.cycle <= known[0]):
                continue
            filtered = r.outcome.startswith("filtered_")
            outcome = (known[2] if known else r.outcome) if filtered else "passed_to_extraction"
            state = ("still_filtered" if known else "filtered") if filtered else "passed"
            known = (r.cycle, state, outcome, max(int(r.at.timestamp() * 1000), known[3] if known else 0))
            out.append(Row(message_id=key[0], cycle=r.cycle, state=state, outcome=outcome, at=r.at))
        if out:
            self.state.update(known)
            self.postpone(known[3])
        return iter(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        out = []
        if self.state.exists():
            cycle, state, outcome, _ = self.state.get()
            if state != "passed":
                at = datetime.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000)
                out.append(Row(message_id=key[0], cycle=cycle, state="expired", outcome=outcome, at=at))
            self.state.clear()
        return iter(out)


class ThreadTags(_Expiring):
    """The union of a thread's tags for each of its messages. A row that adds a tag sends all messages of the thread again, any other only itself;
    a repeated message that adds nothing sends nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tags = handle.getListState("tags", "tag string")
        self.messages = handle.getMapState("messages", "message_id string", "known boolean")
        self.last = handle.getValueState("last", "last_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        tags = {r[0] for r in self.tags.get()} if self.tags.exists() else set()
        # each access to the state is a message to the JVM: a new thread has no messages to look up or to read back
        known, before, new = self.last.exists(), len(tags), {}
        last = self.last.get()[0] if known else 0
        for r in rows:
            last = max(last, int(r.at.timestamp() * 1000))
            tags.update(t for t in r.tags or () if t is not None)
            if r.message_id not in new and not (known and self.messages.containsKey((r.message_id,))):
                self.messages.updateValue((r.message_id,), (True,))
                new[r.message_id] = True
        if len(tags) > before:
            self.tags.put([(t,) for t in sorted(tags)])
            if known:
                new = [k[0] for k in self.messages.keys()]
        self.last.update((last,))
        self.postpone(last)
        text = ",".join(sorted(tags))
        return iter([Row(thread=key[0], message_id=m, n_tags=len(tags), tags=text) for m in new])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        for state in (self.tags, self.messages, self.last):
            state.clear()
        return iter(())


def _stateful(rows: DataFrame, keys: str, processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    grouped = rows.withWatermark("at", delay).groupBy(keys)
    return grouped.transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def retriage(verdicts: DataFrame, expiry_s: int = 30 * 86400, delay: str = "1 day") -> DataFrame:
    """Changes of state from a stream of verdicts (message_id, cycle, outcome, at)."""
    return _stateful(verdicts.filter("message_id is not null and outcome is not null"), "message_id", Retriage(expiry_s), RETRIAGED, delay)


def thread_tags(messages: DataFrame, expiry_s: int = 30 * 86400, delay: str = "1 day") -> DataFrame:
    """Tags of each message of a thread whenever they change, from a stream (thread, message_id, tags, at)."""
    return _stateful(messages.filter("thread is not null and message_id is not null"), "thread", ThreadTags(expiry_s), TAGGED, delay)


class Gauges(StreamingQueryListener):
    """The observed metrics of every micro-batch: rows of (query, batch, name, metric, value), the last ``kept`` of them."""

    def __init__(self, kept: int = 10_000):
        self.rows: deque[tuple] = deque(maxlen=kept)

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        progress = event.progress
        for name, values in (progress.observedMetrics or {}).items():
            for metric, value in values.asDict().items():
                self.rows.append((str(progress.id), progress.batchId, name, metric, value))

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass


def with_gauges(rows: DataFrame, name: str, **gauges: Column) -> DataFrame:
    """``rows`` unchanged, with aggregates over each micro-batch (or the whole batch) on the side."""
    return rows.observe(name, *(c.alias(n) for n, c in gauges.items()))


def with_counters(rows: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """``rows`` unchanged and an observation of how many there are and meet each condition, filled by the first action."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("processed"), *(F.count_if(c).alias(n) for n, c in conditions.items())]
    return rows.observe(seen, *counts), seen


def _verdicts(g: Graph) -> DataFrame:
    """A stream of first verdicts, as conversations hold them; texts that were too short get a second look in cycle 1."""
    rows = read_stream(g, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"), triage(F.coalesce("text", F.lit("")), F.concat("role", (F.col("conv_id") % 20).cast("string"))).alias("outcome"),
        F.timestamp_seconds(1_704_067_200 + F.col("conv_id") % 28 * 86400).alias("at"), "conv_id",
    )
    again = F.when(F.col("conv_id") % 2 == 0, F.lit("passed")).otherwise(F.col("outcome"))
    looks = F.array(F.struct(F.lit(0).cast("long").alias("cycle"), "outcome"), F.struct(F.lit(1).cast("long").alias("cycle"), again.alias("outcome")))
    return rows.select("message_id", "at", F.explode(looks).alias("x")).select("message_id", "x.cycle", "x.outcome", "at")


_OUTCOME = """CASE WHEN length(trim(body)) = 0 THEN 'filtered_empty' WHEN starts_with(sender, 'system') THEN 'filtered_system' WHEN regexp_matches(lower(body), '\\bunsubscribe\\b|\\bnewsletter\\b') THEN 'filtered_bulk'
    WHEN length(body) < 40 THEN 'filtered_short' ELSE 'passed' END"""


@query(
    "st07_retriage_states",
    f"""WITH v AS (SELECT message_id, thread, {_OUTCOME} AS outcome FROM messages)
    SELECT message_id, CASE WHEN outcome = 'passed' OR thread % 2 = 0 THEN 'passed' ELSE 'still_filtered' END AS state,
    CASE WHEN outcome = 'passed' OR thread % 2 = 0 THEN 'passed_to_extraction' ELSE outcome END AS outcome, CASE WHEN outcome = 'passed' THEN 0 ELSE 1 END::BIGINT AS cycle FROM v""",
)
def _(g: Graph) -> DataFrame:
    changes = drain(retriage(_verdicts(g), 3650 * 86400, "3650 days"))
    return changes.groupBy("message_id").agg(F.max_by(F.struct("state", "outcome", "cycle"), "cycle").alias("x")).select("message_id", "x.state", "x.outcome", "x.cycle")


@query("st09_thread_tags", "SELECT CAST(event_id AS VARCHAR) AS message_id, t.tags FROM events e JOIN (SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tags FROM events GROUP BY 1) t ON e.user_id = t.user_id")
def _(g: Graph) -> DataFrame:
    stream = read_stream(g, "events").select(F.col("user_id").cast("string").alias("thread"), F.col("event_id").cast("string").alias("message_id"), F.array("event_type").alias("tags"), F.col("ts").cast("timestamp").alias("at"))
    return drain(thread_tags(stream, 3650 * 86400, "3650 days")).groupBy("message_id").agg(F.max_by("tags", "n_tags").alias("tags"))
