"""Batches that respect dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dependency_levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(node, level) of nodes(node) under needs(node, needs): level 0 needs nothing, others one more than what they need; nodes in cycles come last.

    Meant for plans of tasks: a recursive query over a small table, as deep as there are nodes.
    """
    deepest = max(100, nodes.count())
    placed = nodes.sparkSession.sql(
        f"""WITH RECURSIVE level(node, level) MAX RECURSION LEVEL {deepest} AS (
            SELECT n.node, 0 FROM {{nodes}} n LEFT ANTI JOIN {{needs}} d ON d.node = n.node
            UNION ALL SELECT d.node, l.level + 1 FROM level l JOIN {{needs}} d ON d.needs = l.node)
            SELECT node, max(level) AS level FROM level GROUP BY node""",
        nodes=nodes,
        needs=needs,
    )
    last = placed.agg((F.max("level") + 1).alias("last")).scalar()
    return nodes.join(placed, "node", "left").select("node", F.coalesce("level", last).alias("level"))
