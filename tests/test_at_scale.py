"""What lets queries grow: hot keys in tiles, sketches before vectors, bounded matrices, ranges, rows kept before they are sent."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import density, ordered, resolution
from loomgraph.plans.model import Graph
from loomgraph.plans.registry import QUERIES, load

load()


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_pairs_of_a_hot_key_are_met_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(resolution, "TILE", 4)
    rows = [(f"e{k:03}", "x" if k < 30 else f"y{k % 7}", "t" if k % 10 else None) for k in range(60)] + [("n1", None, "t"), ("n2", None, "t")]
    found = resolution.exact_duplicates(spark.createDataFrame(rows, "entity_id string, name string, entity_type string"))
    want = sorted((a, b, n) for a, n, t in rows for b, m, u in rows if n is not None and t is not None and (n, t) == (m, u) and a < b)
    assert sorted(map(tuple, found.collect())) == want
    assert "tile" in plan_of(found)


def test_candidates_by_chance_fall_out_before_vectors_are_sent(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 32))
    x = np.concatenate([x, x + 0.55 * rng.standard_normal(x.shape)])
    sims = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>").withColumn("h", resolution.vector_sketch(32)("v"))
    met = rows.select(F.col("k").alias("a"), "h").crossJoin(rows.select(F.col("k").alias("b"), F.col("h").alias("g"))).filter(F.expr("a < b") & resolution.sketches_near("h", "g", 0.85))
    kept = {(r.a, r.b) for r in met.select("a", "b").collect()}
    linked = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if sims[a, b] >= 0.85}
    assert len(linked) > 50 and linked <= kept and len(kept) < 1000  # of 179,700 pairs


def test_greatest_similarity_takes_any_number_of_centres(spark, tmp_path):
    rng = np.random.default_rng(5)
    x, c = rng.standard_normal((40, 8)), rng.standard_normal((1100, 8))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(98, [0.0] * 8), (99, None)], "k long, v array<float>")
    centres = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(c)], "t long, vector array<float>")
    want = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T).max(axis=1)
    for at_once in (8192, 150):
        found = {r.k: r.similarity for r in resolution.greatest_similarity(rows, "k", "v", centres, "t", at_once).collect()}
        assert found[99] is None and found[98] == 0.0 and np.allclose([found[k] for k in range(40)], want, atol=2e-6)
    assert resolution.greatest_similarity(rows, "k", "v", centres.limit(0), "t").count() == 0
    # 1100 terms, more than the former bound
    spark.createDataFrame([(50 * k, v.tolist(), 0) for k, v in enumerate(c)], "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    assert {r.outcome for r in QUERIES["st05_semantic_triage"](spark, str(tmp_path)).collect()} == {"passed"}


def test_matrices_of_a_mixture_are_bounded_for_any_number_of_components():
    import pandas as pd

    vectors = pd.Series([np.full(3, float(k)) for k in range(5000)])
    for components in (1, 1000, 3 * density.CELLS):
        parts = list(density.slices(vectors[:50] if components > density.CELLS else vectors, components))
        assert all(len(p) * components <= max(density.CELLS, components) for p in parts)
        assert [r[0] for p in parts for r in p] == list(range(sum(map(len, parts))))


def test_ranks_and_selections_do_not_gather_a_key(spark, small_dir):
    g = Graph(spark, small_dir)
    assert "row_number() windowspecdefinition(predicate" not in plan_of(QUERIES["w03_rank_per_strategy"](spark, small_dir))
    chosen = ordered.share_capped_top(g.claims, ["module"], F.col("predicate") == "made_by", 10, 0.5, F.desc("confidence"), "claim_id")
    assert plan_of(chosen).count("row_number(), 10, Partial") == 2
    both = plan_of(QUERIES["u04_scope_intersection"](spark, small_dir))
    assert both.count("HashAggregate") >= 4


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_IN_RANGE", 10)
    rows = spark.createDataFrame([(k % 2, (k * 37) % 200) for k in range(200)], "key int, x int")
    placed = ordered.running_within(rows, ["key"], [F.col("x")], F.col("x"))
    found = {(r.key, r.x): (r.row_number, r.before, r.n) for r in placed.collect()}
    for key in (0, 1):
        xs = sorted(x for k, x in found if k == key)
        assert all(found[key, x] == (i + 1, sum(xs[:i]), len(xs)) for i, x in enumerate(xs))


def test_tiles_of_a_hot_key_are_sent_packed(spark, monkeypatch):
    monkeypatch.setattr(resolution, "TILE", 4)
    rows = [(f"e{k % 90:03}", f"Acme {k % 3} {'LLC' if k % 2 else 'llo'}", "t") for k in range(97)] + [(None, "Acme 0 LLC", "t"), ("z", None, "t"), ("y", "Acme 0 LLC", None)]
    frame = spark.createDataFrame(rows, "entity_id string, name string, entity_type string")
    pairs = [(a, b, n, m) for a, n, t in rows for b, m, u in rows if a and b and n and m and t == u and a < b]
    found = resolution.exact_duplicates(frame)
    assert sorted(map(tuple, found.collect())) == sorted((a, b, n) for a, b, n, m in pairs if n == m)
    # a row is sent to its tile and, in its tile's row, to others; it is not repeated for each tile of its key
    assert "/packed-" in plan_of(found) and "explode(twos" in plan_of(found)
    unlike = resolution.suffix_duplicates(frame).collect()
    assert sorted(map(tuple, unlike)) == sorted((a, b) for a, b, n, m in pairs if n != m and n[:6] == m[:6])


def test_linkage_keeps_sums_of_linked_clusters_only(spark, monkeypatch):
    x = np.vstack([np.eye(12), np.eye(12)[:2] + 0.01])
    rows = spark.createDataFrame([(0, k, v.tolist()) for k, v in enumerate(x)], "block int, item long, v array<double>")
    kept, store = [], resolution.durable

    def watched(df, name="step"):
        stored = store(df, name)
        if "total" in df.columns:
            kept.append(stored.count())
        return stored

    monkeypatch.setattr(resolution, "durable", watched)
    found = {r["item"]: r.cluster for r in resolution.average_linkage(rows, "block", "item", "v", 0.85).collect()}
    assert found == {k: k for k in range(12)} | {12: 0, 13: 1} and kept == [4, 0]
