"""Tasks whose share does not grow with the tables, and matrices of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomgraph import session
from loomgraph.operators import aggregates, graph_algorithms, vectors
from loomgraph.plans.model import Graph
from loomgraph.plans.registry import QUERIES, load
from tests.test_at_scale import plan_of

load()


def test_degrees_and_coverage_are_dealt_to_tasks_by_rows(spark, small_dir, monkeypatch):
    monkeypatch.setattr(session, "ROWS_IN_TASK", 100)
    g = Graph(spark, small_dir)
    lines, orders = (g.table(t).count() for t in ("lineitem", "orders"))
    n = -(-(lines + orders) // 100)
    assert g.tasks("lineitem", "orders") == n and g.tasks("region") == spark.sparkContext.defaultParallelism
    assert f"{-(-lines // 100)}), REPARTITION_BY_NUM" in plan_of(g.edges)
    degrees, coverage = (plan_of(QUERIES[q](spark, small_dir)) for q in ("g10_degrees", "a04_relationship_coverage"))
    assert f", {n}), REPARTITION_BY_NUM" in degrees and coverage.count(f", {n}), REPARTITION_BY_NUM") >= 2
    assert sorted(map(tuple, graph_algorithms.degrees(g.edges, 3).collect())) == sorted(map(tuple, graph_algorithms.degrees(g.edges).collect()))


def test_coverage_counts_repeated_vertices_and_edges(spark):
    vertices = spark.createDataFrame([("a", "t", False), ("a", "t", False), ("b", "t", False), ("c", "u", False), ("d", "u", True), (None, "u", False)], "entity_id string, entity_type string, deprecated boolean")
    edges = spark.createDataFrame([("r", "a", False), ("r", "a", False), ("s", "b", False), ("s", "d", False), ("s", "c", True), ("r", None, False), (None, "c", False)], "rel_type string, source string, deprecated boolean")
    live = lambda df: df.filter("deprecated = false")
    joined = live(edges).join(live(vertices).withColumnRenamed("entity_id", "source").drop("deprecated"), "source")
    want = joined.groupBy("rel_type", "entity_type").agg(F.countDistinct("source"), F.count("*")).collect()
    for tasks in (None, 3):
        found = aggregates.relationship_coverage(vertices, edges, tasks).collect()
        assert {(r.rel_type, r.entity_type, r.covered, r.n_edges) for r in found} == set(map(tuple, want))
        assert {r.entity_type: r.total for r in found} == {"t": 3, "u": 2}


def test_scores_of_a_task_are_bounded():
    groups = [(np.arange(1000), np.arange(10_000)), (np.arange(3), np.arange(7)), (np.arange(2 * vectors.CELLS), np.arange(2))]
    parts = list(vectors.cut(groups))
    assert all(len(who) * len(rows) <= max(vectors.CELLS, len(who)) for who, rows in parts)
    for who, rows in groups:
        assert np.array_equal(np.concatenate([r for w, r in parts if w is who]), rows)


def test_mentions_are_dealt_once_before_they_are_paired(spark, small_dir, monkeypatch):
    monkeypatch.setattr(session, "ROWS_IN_TASK", 100)
    n = Graph(spark, small_dir).tasks("lineitem")
    for name, group in (("g06_ppmi", "chunk_id"), ("g08_coassociation_graph", "document_id")):
        lines = [line for line in plan_of(QUERIES[name](spark, small_dir)).splitlines() if "Exchange hashpartitioning" in line and group in line]
        assert lines and all(f", {n}), REPARTITION_BY_NUM" in line for line in lines)
