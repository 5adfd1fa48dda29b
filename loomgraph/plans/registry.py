"""Registered queries: a name, a DataFrame plan over a Graph, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans.model import Graph, with_views

#: Modules that register queries when they are imported.
MODULES = (
    "loomgraph.operators.graph_reads",
    "loomgraph.operators.aggregates",
    "loomgraph.operators.joins",
    "loomgraph.operators.ordered",
    "loomgraph.operators.graph_algorithms",
    "loomgraph.operators.communities",
    "loomgraph.operators.retrieval",
    "loomgraph.operators.resolution",
    "loomgraph.operators.vectors",
    "loomgraph.operators.density",
    "loomgraph.operators.claims",
    "loomgraph.operators.signals",
    "loomgraph.operators.directives",
    "loomgraph.operators.calibration",
    "loomgraph.operators.security",
    "loomgraph.operators.ontology",
    "loomgraph.operators.commands",
    "loomgraph.functions.text",
    "loomgraph.sources.formats",
    "loomgraph.streaming.pipelines",
    "loomgraph.streaming.stateful",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers ``plan(graph)`` under ``name``; ``sql`` may use the graph's views."""

    def register(plan: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plan(Graph(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return plan

    return register


def load() -> None:
    for module in MODULES:
        import_module(module)
