"""Keyed state, gauges and mailboxes: late and repeated events, restart, expiry, split sizes."""

from __future__ import annotations

import datetime
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomgraph.sources import mail
from loomgraph.sources.formats import MESSAGE_SCHEMA
from loomgraph.streaming import stateful

VERDICT = "message_id string, cycle long, outcome string, at timestamp"


def at(day: int, hour: int = 0) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=hour)


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")


def run(spark, folder, make, schema):
    """One run over what has come since the last one, with the same checkpoint; all rows sent so far."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"file://{folder}/in")

    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(f"file://{folder}/out/epoch={epoch}")

    make(source).writeStream.option("checkpointLocation", f"file://{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return sorted(tuple(x for k, x in r.asDict().items() if k not in ("at", "epoch")) for r in spark.read.parquet(f"file://{folder}/out").collect())


def test_retriage_moves_on_only(spark, tmp_path):
    make = lambda s: stateful.retriage(s, expiry_s=10 * 86400, delay="1 day")
    feed(spark, tmp_path, [("a", 0, "filtered_short", at(0)), ("b", 0, "passed", at(0)), ("c", 0, "filtered_bulk", at(0)), (None, 0, "passed", at(0))], VERDICT)
    first = run(spark, tmp_path, make, VERDICT)
    assert first == [("a", 0, "filtered", "filtered_short"), ("b", 0, "passed", "passed_to_extraction"), ("c", 0, "filtered", "filtered_bulk")]
    # a restart: repeats change nothing, a later cycle does, a passed message stays passed
    feed(spark, tmp_path, [("a", 0, "filtered_short", at(1)), ("a", 1, "filtered_other", at(1)), ("b", 1, "filtered_bulk", at(1)), ("a", 2, "passed", at(1, 1))], VERDICT)
    feed(spark, tmp_path, [("a", 3, "filtered_short", at(2)), ("a", 1, "passed", at(2))], VERDICT)
    second = run(spark, tmp_path, make, VERDICT)
    assert [r for r in second if r not in first] == [("a", 1, "still_filtered", "filtered_short"), ("a", 2, "passed", "passed_to_extraction")]
    # event time goes on: c expires, and a row far behind the watermark is dropped
    feed(spark, tmp_path, [("d", 0, "passed", at(30))], VERDICT)
    run(spark, tmp_path, make, VERDICT)
    feed(spark, tmp_path, [("d", 1, "passed", at(31)), ("late", 0, "filtered_short", at(3))], VERDICT)
    last = run(spark, tmp_path, make, VERDICT)
    assert [r for r in last if r not in second] == [("c", 0, "expired", "filtered_bulk"), ("d", 0, "passed", "passed_to_extraction")]


def test_thread_tags_grow_and_end(spark, tmp_path):
    schema = "thread string, message_id string, tags array<string>, at timestamp"
    make = lambda s: stateful.thread_tags(s, expiry_s=5 * 86400, delay="1 day")
    feed(spark, tmp_path, [("t", "1", ["x"], at(0)), ("t", "2", None, at(0)), ("u", "9", [], at(0))], schema)
    assert run(spark, tmp_path, make, schema) == [("t", "1", 1, "x"), ("t", "2", 1, "x"), ("u", "9", 0, "")]
    feed(spark, tmp_path, [("t", "2", ["x"], at(0)), ("t", "3", ["a"], at(1))], schema)
    again = run(spark, tmp_path, make, schema)
    assert [r for r in again if r[2] == 2] == [("t", m, 2, "a,x") for m in "123"] and len(again) == 6
    feed(spark, tmp_path, [("v", "7", [], at(40))], schema)
    run(spark, tmp_path, make, schema)
    feed(spark, tmp_path, [("t", "4", ["n"], at(41))], schema)  # the thread's state has ended by now
    assert ("t", "4", 1, "n") in run(spark, tmp_path, make, schema)


def test_gauges_equal_a_recount(spark, tmp_path):
    gauges = stateful.Gauges()
    spark.streams.addListener(gauges)
    try:
        for k in range(3):
            feed(spark, tmp_path, [(f"m{k}{i}", k, "passed" if i % 2 else "filtered_x", at(k)) for i in range(4 + k)], VERDICT)
        observed = lambda s: stateful.with_gauges(s, "triage", seen=F.count(F.lit(1)), passed=F.count_if(F.col("outcome") == "passed"))
        rows = run(spark, tmp_path, observed, VERDICT)
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(30_000)
        total = {m: sum(r[4] for r in gauges.rows if r[2] == "triage" and r[3] == m) for m in ("seen", "passed")}
    finally:
        spark.streams.removeListener(gauges)
    assert total == {"seen": len(rows), "passed": sum(r[2] == "passed" for r in rows)} and len({r[1] for r in gauges.rows}) == 3
    counted, seen = stateful.with_counters(spark.range(100).withColumn("x", F.col("id") % 10), low=F.col("x") < 3, none=F.col("x").isNull())
    counted.write.format("noop").mode("overwrite").save()
    assert seen.get == {"processed": 100, "low": 30, "none": 0}


def letter(k: int) -> bytes:
    body = f"Body {k}\n>From here on\n" + "line\n" * (k * 7 % 50)
    return f"From x{k}@y.org Mon Jan  1\nFrom: A{k} <a{k}@x.org>\nTo: b@y.org\nSubject: s{k} From \nMessage-ID: <{k}@x>\n\n{body}\n".encode()


@pytest.fixture
def box(tmp_path):
    folder = tmp_path / "box"
    folder.mkdir()
    (folder / "one.mbox").write_bytes(b"".join(letter(k) for k in range(60)))
    (folder / "two.mbox").write_bytes(b"no message yet\n" + b"".join(letter(k) for k in range(60, 64)))
    (folder / "none.mbox").write_bytes(b"")
    return folder


def test_mailboxes_are_the_same_for_any_split(spark, box):
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in ("128m", "3000", "401"):
            spark.conf.set(key, size)
            rows = mail.read_mailboxes(spark, str(box)).collect()
            found.append(sorted((r.message_id, r.sender, r.subject, r.body) for r in rows))
    finally:
        spark.conf.set(key, old)
    assert len(found[0]) == 64 and found[0] == found[1] == found[2]
    assert next(r for r in found[0] if r[0] == "<1@x>")[3].startswith("Body 1\nFrom here on\n")


@pytest.mark.parametrize("size", [1, 100, 401, 10_000])
def test_ranges_of_a_mailbox(box, size):
    path = str(box / "one.mbox")
    whole = list(mail.borders(path, 0, 1 << 40))
    total = mail.settled_size(path)
    parts = range(0, total, size) if size > 1 else range(0, 3)
    got = [p for first in parts for p in mail.borders(path, first, min(first + size, total), chunk=64)]
    assert got == [p for p in whole if size > 1 or p < 3] and len(whole) == 60


def test_a_growing_mailbox_is_read_once(spark, box, tmp_path):
    spark.dataSource.register(mail.MailboxSource)
    out, name = tmp_path / "out", uuid.uuid4().hex

    def go():
        stream = spark.readStream.format("mailbox").option("partBytes", "700").load(str(box))
        stream.writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.message_id for r in spark.read.schema(MESSAGE_SCHEMA).parquet(f"file://{out}").collect())

    assert go() == sorted(f"<{k}@x>" for k in range(64))
    with open(box / "one.mbox", "ab") as f:
        f.write(letter(64) + letter(65)[:-30])  # the second is not whole yet
    (box / "three.mbox").write_bytes(letter(66))
    assert go() == sorted(f"<{k}@x>" for k in [*range(65), 66])
    with open(box / "one.mbox", "ab") as f:
        f.write(letter(65)[-30:])
    assert go() == sorted(f"<{k}@x>" for k in range(67))


def test_sessions_close_behind_the_watermark_and_late_rows_are_left_out(spark, tmp_path):
    from loomgraph.streaming.pipelines import closed_sessions

    schema = "user_id long, at timestamp"
    make = lambda s: closed_sessions(s, "at", "2 hours", "user_id", "1 hour").select("user_id", "n")
    feed(spark, tmp_path, [(1, at(0, 0)), (1, at(0, 1)), (2, at(0, 1))], schema)
    assert run(spark, tmp_path, make, schema) == []  # all still open
    feed(spark, tmp_path, [(1, at(1, 0)), (1, at(1, 1))], schema)
    run(spark, tmp_path, make, schema)
    feed(spark, tmp_path, [(1, at(0, 2)), (3, at(2, 0))], schema)  # the first row comes a day too late
    run(spark, tmp_path, make, schema)
    feed(spark, tmp_path, [(3, at(3, 0))], schema)
    assert run(spark, tmp_path, make, schema) == [(1, 2), (1, 2), (2, 1), (3, 1)]


def test_tables_in_folders_stream_like_single_files(spark, small_dir, tmp_path):
    from loomgraph.plans.model import Graph
    from loomgraph.streaming.pipelines import drain, read_stream

    spark.read.parquet(f"{small_dir}/conversations.parquet").repartition(3).write.parquet(f"file://{tmp_path}/conversations.parquet")
    whole = spark.read.parquet(f"{small_dir}/conversations.parquet")
    for folder in (small_dir, str(tmp_path)):
        g = Graph(spark, folder)
        assert drain(read_stream(g, "conversations").select("conv_id", "turn")).exceptAll(whole.select("conv_id", "turn")).isEmpty()
        assert drain(read_stream(g, "conversations").select("conv_id")).count() == whole.count()
        assert drain(stateful.retriage(stateful._verdicts(g), 3650 * 86400, "3650 days")).select("message_id").distinct().count() == whole.count()


def test_a_new_thread_looks_up_no_messages():
    class State(dict):
        looked = 0

        def exists(self):
            return bool(self)

        def get(self):
            return self["x"]

        def update(self, value):
            self["x"] = value

        put = update

        def containsKey(self, key):
            self.looked += 1
            return key in self

        def updateValue(self, key, value):
            self[key] = value

    class Handle:
        def listTimers(self):
            return iter(())

        def registerTimer(self, at):
            pass

    tags = stateful.ThreadTags(60)
    tags.handle, tags.tags, tags.messages, tags.last = Handle(), State(), State(), State()
    at = datetime.datetime(2024, 1, 1)
    rows = [Row(message_id=m, tags=[t], at=at) for m, t in (("a", "x"), ("b", "y"), ("a", "x"))]
    sent = lambda rows: [(r.message_id, r.tags) for r in tags.handleInputRows(("t",), iter(rows), None)]
    assert sent(rows) == [("a", "x,y"), ("b", "x,y")] and tags.messages.looked == 0
    assert sent(rows[:1]) == [] and tags.messages.looked == 1
    assert sorted(sent([Row(message_id="c", tags=["z"], at=at)])) == [(m, "x,y,z") for m in "abc"]
