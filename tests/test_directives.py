"""Directive snapshots, standing still, coverage; sentence spans of whole tables."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import functions as F

from loomgraph.operators import directives
from loomgraph.plans import registry
from loomgraph.plans.model import Graph

NOW = datetime.datetime(2024, 5, 1)


def at():
    return F.lit(str(NOW)).cast("timestamp")


def ago(days: float) -> datetime.datetime:
    return NOW - datetime.timedelta(days=days)


def test_snapshots_of_both_tiers(spark):
    known = spark.createDataFrame(
        [("s", "Strategic_Initiative", "active"), ("o", "Operational_Adjustment", "active"), ("none", "Operational_Adjustment", "active"), ("bare", "Strategic_Initiative", "active"), ("x", "Strategic_Initiative", "closed")],
        "directive_id string, tier string, status string",
    )
    results = spark.createDataFrame(
        [("s", "1", 3, None, ago(1)), ("s", "2", 0, None, ago(1)), ("o", "3", 2, 2, ago(3)), ("o", "4", 9, 5, ago(2)), ("o", "5", None, 7, ago(9)), ("x", "6", 1, 1, ago(1))],
        "directive_id string, criterion_id string, n_rows long, n_samples long, executed_at timestamp",
    )
    before = spark.createDataFrame([("s", ago(4), 0.1, None), ("s", ago(9), 0.9, None), ("o", ago(0.25), 1.0, 0.0)], "directive_id string, snapshot_at timestamp, progress double, velocity double")
    rows = {r.directive_id: r for r in directives.realization_snapshots(known, results, before, at()).collect()}
    assert set(rows) == {"s", "o", "none", "bare"}
    s, o = rows["s"], rows["o"]
    assert (s.progress, round(s.velocity, 6), s.evidence_consistent, s.evidence_counter, s.all_satisfied) == (0.5, 0.1, 1, None, False)
    assert (round(o.progress, 6), round(o.velocity, 6), o.evidence_counter, o.first_evidence_at, o.last_counter_evidence_at, o.all_satisfied) == (0.666667, -0.333333, 7, ago(3), ago(2), None)
    assert (rows["none"].progress, rows["none"].evidence_counter) == (None, None) and (rows["bare"].progress, rows["bare"].all_satisfied) == (0.0, False)


def test_what_stands_still(spark):
    series = {"flat": [0.001, -0.001, 0.001, 0.0], "fast": [0.2, 0.1, 0.2, 0.1], "rising": [k / 1000 for k in range(1, 9)], "short": [0.0, 0.0], "new": [0.0] * 4, "closed": [0.0] * 4}
    snaps = spark.createDataFrame([(d, ago(20 - k), 0.5, v) for d, vs in series.items() for k, v in enumerate(vs)] + [("flat", ago(25), 0.1, None)], "directive_id string, snapshot_at timestamp, progress double, velocity double")
    known = spark.createDataFrame([(d, "closed" if d == "closed" else "active", ago(2 if d == "new" else 30)) for d in [*series, "unseen"]], "directive_id string, status string, status_at timestamp")
    assert {r.directive_id for r in directives.stalled(known, snaps, at()).collect() if r.is_stalled} == {"flat"}
    wide = known.withColumns({"tier": F.lit("t"), "segments": F.array(F.lit("a"), F.lit("a"), F.lit("b"))})
    segments = spark.createDataFrame([("a",), ("a",), ("z",)], "segment string")
    found = directives.covering_directives(segments, wide, snaps, F.col("directive_id") != "fast", at()).collect()
    assert {(r.segment, r.directive_id, r.is_stalled) for r in found} == {("a", d, {"flat": True, "unseen": None}.get(d, False)) for d in ("flat", "rising", "short", "new", "unseen")}
    assert len(found) == 5 and {r.directive_id: r.velocity_band for r in found} == {"flat": "stalled", "rising": "slowing", "short": "stalled", "new": "stalled", "unseen": None}


def test_sentence_spans_of_all_messages(spark, small_dir):
    found: dict = {}
    for r in registry.QUERIES["c02_sentence_spans"](spark, small_dir).collect():
        found.setdefault(r.message_id, []).append((r["index"], r.start, r.length))
    for r in Graph(spark, small_dir).messages.select("message_id", "body").collect():
        spans = sorted(found.pop(r.message_id, []))
        # sentences end at . ! ? before white space or at the end of the text
        want = [(k, m.start(), m.end() - m.start()) for k, m in enumerate(re.finditer(r"(?s).+?(?:[.!?](?=\s)|\Z)", r.body))]
        if all(ord(c) < 0x10000 for c in r.body) and not r.body.endswith("\n"):
            assert spans == want
        assert sum(n for _, _, n in spans) == len(r.body)
    assert not found
