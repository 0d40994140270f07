"""Queries over nested records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinworks.operators.shred import TABLES, adjacency, children, entity_paths, entity_table, rest
from skeinworks.plans.nested_sql import ORACLES
from skeinworks.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return children(adjacency(table(spark, folder, "raw_trajectories")))


def p2_rest(spark: SparkSession, folder: str) -> DataFrame:
    nodes = adjacency(table(spark, folder, "raw_trajectories"))
    return rest(nodes, entity_paths(nodes))


def _flat(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        nodes = adjacency(table(spark, folder, "raw_trajectories"))
        return entity_table(nodes, entity_paths(nodes), *TABLES[name])

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, **{f"p2_{name}": _flat(name) for name in TABLES}, "p2_rest": p2_rest}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
