"""Chain verification, bucket quantiles, sketches, the six patterns, numbers within keys: against definitions and scenarios."""

from __future__ import annotations

import datetime
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import aggregates, graph_algorithms, ordered, signals


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def chain(parents: dict[str, str | None]) -> dict[str, list]:
    rows: dict[str, list] = {}
    for k, p in parents.items():
        rows[k] = [p, f"payload {k}", sha(f"payload {k}" + (rows[p][2] if p in rows else ""))]
    return rows


TREE = {"r": None, "a": "r", "b": "r", "a1": "a", "a2": "a", "b1": "b", "a11": "a1", "lone": None}


def faults(spark, rows: dict[str, list]) -> dict[str, tuple]:
    df = spark.createDataFrame([(k, *v) for k, v in rows.items()], "id string, parent string, payload string, hash string")
    return {r.id: (r.fault, r.first_fault) for r in graph_algorithms.chain_faults(df, "id", "parent", "payload", "hash").collect()}


@pytest.mark.parametrize("tampered", [None, "r", "a", "a11"])
def test_chain_faults_reach_all_descendants(spark, tampered):
    rows = chain(TREE)
    if tampered:
        rows[tampered][1] += "!"
    found = faults(spark, rows)
    for k in TREE:
        path = [k]
        while TREE[path[-1]]:
            path.append(TREE[path[-1]])
        assert found[k] == ("hash" if k == tampered else None, tampered if tampered in path else None)


def test_missing_parents_and_cycles(spark):
    rows = chain(TREE)
    rows["b"][0] = "gone"
    rows |= {"x": ["y", "p", "h"], "y": ["x", "p", "h"], "z": ["y", "p", "h"], "self": ["self", "p", "h"]}
    found = faults(spark, rows)
    assert found["b"] == ("missing_parent", "b") and found["b1"] == (None, "b") and found["a11"] == (None, None)
    assert [found[k][0] for k in ("x", "y", "z")] == ["cycle"] * 3 and found["self"][0] == "hash"


def test_bucket_quantiles(spark):
    bounds = [0.0, 1.0, 2.0, 4.0]
    cases = {"inside": [0.5, 1.5, 1.5, 3.0], "above": [9.0, 9.0, 1.0], "low": [-3.0, -2.0], "none": [None], "edge": [1.0, 2.0], "one": [3.9]}
    df = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k string, v double")
    counted = aggregates.bucket_counts(df, ["k"], "v", bounds)
    found = {r.k: r.q for r in counted.select("k", aggregates.bucket_quantile(F.col("le"), bounds, 0.5).alias("q")).collect()}
    # ranks 2, 1.5, 1, 1, 0.5 of the cumulative counts
    assert found == pytest.approx({"inside": 1.5, "above": 4.0, "low": 0.0, "edge": 1.0, "one": 3.0})


def test_sketches_of_days_merge_within_their_error(spark):
    rng = np.random.default_rng(5)
    values = rng.gamma(2.0, 10.0, 20_000)
    rows = [("m", int(k % 7), float(v), int(u)) for k, (v, u) in enumerate(zip(values, rng.integers(0, 3000, len(values))))]
    df = spark.createDataFrame(rows, "metric string, day int, value double, user_id long")
    stored = aggregates.daily_sketches(df, ["metric"], "value", "user_id")
    for days in (range(7), range(2, 5)):
        r = aggregates.merged_sketches(stored.filter(F.col("day").isin(*days)), ["metric"], 0.95).first()
        kept = [x for x in rows if x[1] in days]
        assert r.n == len(kept)
        assert abs(np.mean([x[2] <= r.quantile for x in kept]) - 0.95) < 0.02  # rank error
        distinct = len({x[3] for x in kept})
        assert abs(r.n_distinct - distinct) < 0.05 * distinct


NOW = datetime.datetime(2024, 3, 15)


def diagnosed(spark, strengths: dict[tuple[str, str], float], series: dict[str, list[float]], throughput: list[float] = (), extra: tuple = ()) -> dict:
    rows = [(s, m, x, NOW - datetime.timedelta(hours=2), "success") for (s, m), x in strengths.items()]
    signal = spark.createDataFrame([*rows, *extra], "signal string, module string, strength double, detected_at timestamp, status string")
    points = [(name, "__global__", NOW - datetime.timedelta(hours=k), float(v)) for name, vs in series.items() for k, v in enumerate(reversed(vs))]
    points += [("throughput", "m", NOW - datetime.timedelta(days=k), float(v)) for k, v in enumerate(reversed(throughput))]
    found = signals.diagnoses(signal, spark.createDataFrame(points, "metric string, module string, at timestamp, value double"), str(NOW))
    return {(r.pattern, r.module): round(r.strength, 4) for r in found.collect()}


def hours(base: float, last: float) -> list[float]:
    """Thirteen days that swing a little around the base, and one day at ``last``."""
    return [base + (0.1 if k % 2 else -0.1) for k in range(13 * 24)] + [last] * 24


def test_patterns_of_modules(spark):
    found = diagnosed(spark, {("C", "m"): 0.6, ("D", "m"): 0.8, ("E", "m"): 0.5, ("B", "m"): 0.7, ("F", "m"): 0.9, ("C", "n"): 0.9, ("D", "n"): 0.4}, {"zero_results": hours(2, 2)})
    assert found == {("schema_drift_per_module", "m"): 0.7, ("ontology_constraint_conflict", "m"): 0.6, ("cq_regression_pre_extraction", "m"): 0.9}
    falling = diagnosed(spark, {("F", "m"): 0.9}, {}, throughput=list(range(14, 0, -1)))
    assert falling == {}
    assert diagnosed(spark, {("F", "m"): 0.9}, {}, throughput=[3, 2, 1]) == {("cq_regression_pre_extraction", "m"): 0.9}  # too few points


def test_patterns_with_changes(spark):
    series = {"zero_results": hours(2, 6), "retrieval": hours(8, 1), "latency_p95": hours(1, 1)}
    found = diagnosed(spark, {("A", "m"): 0.6, ("B", "m"): 0.5}, series)
    base = np.mean(series["zero_results"])
    down = np.mean(series["retrieval"])
    assert found == pytest.approx({("relationship_gap_propagation", "m"): round((0.5 + min(1, (6 - base) / base)) / 2, 4), ("extraction_quality_problem", "__global__"): round((0.6 + (down - 1) / down) / 2, 4)}, abs=1e-3)
    slow = {"latency_p95": hours(1, 3)}
    assert set(diagnosed(spark, {("A", "m"): 0.2}, slow)) == {("graph_or_index_problem", "__global__")}
    assert diagnosed(spark, {("A", "m"): 0.4}, slow) == {}  # a signal explains it


def test_only_fresh_successful_signals_count(spark):
    old = ("D", "m", 0.9, NOW - datetime.timedelta(hours=30), "success")
    failed = ("D", "m", 0.9, NOW - datetime.timedelta(hours=1), "failed")
    newer = ("C", "m", 0.1, NOW - datetime.timedelta(hours=1), "success")
    assert diagnosed(spark, {("C", "m"): 0.9}, {}, extra=(old, failed)) == {}
    assert diagnosed(spark, {("C", "m"): 0.9, ("D", "m"): 0.9}, {}, extra=(newer,)) == {}


def test_numbers_within_keys(spark):
    rng = np.random.default_rng(2)
    rows = [(("a", "b", None)[int(k)], int(x), int(v) if v else None) for k, x, v in zip(rng.integers(0, 3, 200), rng.integers(0, 40, 200), rng.integers(0, 9, 200))]
    df = spark.createDataFrame(rows, "k string, x long, v long").repartition(7)
    found = ordered.running_within(df, ["k"], [F.col("x"), F.col("v")], F.col("v")).collect()
    for key in ("a", "b", None):
        mine = sorted((r.row_number, r.x, r.v, r.dense_rank, r.n, r.before) for r in found if r.k == key)
        want = sorted(((x, v) for k, x, v in rows if k == key), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        assert [(r[1], r[2]) for r in mine] == want and [r[0] for r in mine] == list(range(1, len(want) + 1))
        places = {p: d for d, p in enumerate(dict.fromkeys(want), 1)}
        assert all(r[3] == places[r[1], r[2]] and r[4] == len(want) and r[5] == sum(v or 0 for _, v in want[: r[0] - 1]) for r in mine)


def test_first_values(spark):
    df = spark.createDataFrame([("a", k) for k in range(20)] + [(None, 3), (None, 1), ("b", None)], "k string, v long")
    assert {r.k: r.first for r in aggregates.first_of(df, "k", "v", 3).collect()} == {"a": "0,1,2", None: "1,3"}


def test_source_reliability_equals_the_loop(spark):
    from loomgraph.operators import claims

    rng = np.random.default_rng(9)
    pairs = {(int(e), int(s)) for e, s in zip(rng.integers(0, 12, 40), rng.integers(0, 6, 40))}
    trust = {s: 0.7 for _, s in pairs}
    for _ in range(10):
        score = {e: 1 - np.prod([1 - 0.5 * trust[s] for x, s in pairs if x == e]) for e, _ in pairs}
        new = {s: float(np.exp(np.mean([np.log(max(score[e], 1e-10)) for e, y in pairs if y == s]))) for s in trust}
        a, b = np.array([new[s] for s in trust]), np.array([trust[s] for s in trust])
        trust = new
        if 1 - a @ b / np.sqrt((a @ a) * (b @ b)) < 1e-3:
            break
    df = spark.createDataFrame([*pairs, *list(pairs)[:3]], "entity long, source long")
    assert {r.source: r.trust for r in claims.source_reliability(df, "entity", "source").collect()} == pytest.approx(trust)
