"""Label propagation over links that are stored once: against plain loops, on both ways that labels travel."""

from __future__ import annotations

import itertools
import random

import pytest

from loomgraph.operators import graph_algorithms
from tests.test_at_scale import plan_of

SEEDS = [1, 2, 9]


def _graph():
    rng = random.Random(5)
    edges = [(f"x{a:02d}", f"x{b:02d}", rng.randint(1, 4)) for a in range(60) for b in range(a, 60) if rng.random() < (0.4 if a // 12 == b // 12 else 0.02)]
    return edges + [("x03", "x01", 2), ("x03", "x01", 1), (None, "x04", 3), ("q", None, 2), ("z1", "z2", None), ("y1", "y2", 1)]


def _tied(spark, names):
    rows = spark.createDataFrame([(s, x) for s in SEEDS for x in sorted(names)], "seed int, label string").selectExpr("seed", "label", "xxhash64(label, seed) AS tie")
    return {(r.seed, r.label): (r.tie, r.label) for r in rows.collect()}


def _propagated(edges, names, tied, seed, rounds):
    label = {x: x for x in names}
    for _ in range(rounds):
        votes = {x: {label[x]: 1} for x in names}
        for a, b, n in edges:
            for x, y in ((a, b), (b, a)):
                if x is not None and y is not None and n is not None:
                    votes[x][label[y]] = votes[x].get(label[y], 0) + n
        chosen = {x: max(v, key=lambda c: (v[c], tied[seed, c])) for x, v in votes.items()}
        if chosen == label:
            break
        label = chosen
    return label


@pytest.mark.parametrize("held, rounds", [(None, 10), (20, 2)])
def test_propagation_equals_plain_loops(spark, monkeypatch, held, rounds):
    if held:
        monkeypatch.setattr(graph_algorithms, "ROWS_IN_TASK", held)
    edges = _graph()
    names = {x for a, b, _ in edges for x in (a, b) if x is not None}
    tied = _tied(spark, names)
    want = {s: _propagated(edges, names, tied, s, rounds) for s in SEEDS}
    df = spark.createDataFrame(edges, "a string, b string, n long")
    rows = graph_algorithms.seeded_communities(df, SEEDS, rounds).collect()
    assert len(rows) == len(SEEDS) * len(names) and all(want[r.seed][r.node] == r.label for r in rows)

    links = [(a, b, n) for a, b, n in edges if n is not None]
    m = sum(n for _, _, n in links)
    rand = []
    for s, t in itertools.combinations(SEEDS, 2):
        alike = [(want[s][x] == want[s][y], want[t][x] == want[t][y]) for x, y in itertools.combinations(sorted(names), 2)]
        both, one, two, n = sum(x and y for x, y in alike), sum(x for x, _ in alike), sum(y for _, y in alike), len(alike)
        rand.append((both - one * two / n) / ((one + two) / 2 - one * two / n))
    for r in graph_algorithms.community_stability(df, SEEDS, rounds=rounds).collect():
        label, parts = want[r.seed], {}
        for a, b, n in links:
            for x in (a, b):
                if x is not None:
                    parts.setdefault(label[x], [0, 0])[1] += n
            if a is not None and b is not None and label[a] == label[b]:
                parts[label[a]][0] += n
        assert r.modularity == pytest.approx(sum(i / m - (d / (2 * m)) ** 2 for i, d in parts.values()))
        assert r.communities == len(set(label.values())) and r.mean_ari == pytest.approx(sum(rand) / len(rand))


def test_no_edges(spark):
    df = spark.createDataFrame([], "a string, b string, n long")
    assert graph_algorithms.seeded_communities(df, SEEDS).count() == 0 and graph_algorithms.community_stability(df, SEEDS).count() == 0


def test_weights_may_be_fractions(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (2, 3, 2.5), (3, 4, 0.25), (4, 5, 3.5)], "a long, b long, n double")
    found = {(r.node, r.label) for r in graph_algorithms.seeded_communities(df, SEEDS, 1).collect()}
    assert found == {(1, 1), (2, 3), (3, 2), (4, 5), (5, 4)}


@pytest.mark.parametrize("held", [None, 20])
def test_rounds_do_not_send_links_again(spark, monkeypatch, held):
    """Votes are not shuffled while labels can be broadcast, and else once, to tasks that follow the rows."""
    if held:
        monkeypatch.setattr(graph_algorithms, "ROWS_IN_TASK", held)
        monkeypatch.setattr("loomgraph.session.ROWS_IN_TASK", held)
    durable, rounds = graph_algorithms.durable, []

    def noted(df, name="step"):
        if name == "labels":
            rounds.append(plan_of(df))
        return durable(df, name)

    monkeypatch.setattr(graph_algorithms, "durable", noted)
    edges = _graph()
    graph_algorithms.community_stability(spark.createDataFrame(edges, "a string, b string, n long"), SEEDS)
    assert rounds
    for plan in rounds:
        if held:
            assert plan.count(f", {-(-2 * len(edges) // held)}), REPARTITION_BY_NUM") == 1
        else:
            assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan
