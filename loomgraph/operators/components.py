"""Connected components of an undirected graph, by alternating large and small stars.

Every round hooks each node's larger (then smaller) neighbours to the least node it sees; the edge
set shrinks to stars in O(log^2 n) rounds whatever the diameter. Minima are grouped aggregates with
map-side combine, and those of hubs are broadcast to their edges, so a hub's neighbours are never gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import durable


#: Nodes with more neighbours than this, and than one in MAX_HUBS of all edges, are hubs: MAX_HUBS * 2 at most.
MIN_HUB = 1000
MAX_HUBS = 1000


def hot_join(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined to ``values``, which has each key once with the number ``n`` of its rows. Values of hot keys are broadcast, so that
    the rows of a hot key stay where they are; there are fewer than MAX_HUBS of them, or MIN_HUB rows in all."""
    if total <= MIN_HUB:
        return rows.join(values.drop("n"), key)
    is_hot = F.col("n") > max(MIN_HUB, total // MAX_HUBS)
    hot = F.broadcast(values.filter(is_hot).drop("n"))  # see MAX_HUBS
    rest = rows.join(hot.select(key), key, "left_anti").join(values.filter(~is_hot).drop("n"), key)
    return rows.join(hot, key).unionByName(rest)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    return hot_join(both.filter("v > u"), least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hooked = hot_join(down, least, "u", total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` has ``u`` and ``v``; returns ``node, component`` (the least node) of all nodes with an edge.

    Null ends and self loops are ignored; repeated edges count once; no edges give no rows.
    """
    state = durable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = (state.count(), None)
    for _ in range(max_rounds):
        total = before[0]
        state = durable(_small_star(_large_star(state, total), total).filter("u <> v").distinct(), "cc")
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
