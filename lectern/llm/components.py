"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b): the smallest node reachable.

    Labels fall to the least label among neighbours and then to the label of the label, so the rounds
    grow with the logarithm of a component's diameter; each round is cut off by a table in the
    shared folder. Only counts reach the driver.
    """
    sides = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    sides = written(sides.distinct())
    label = written(sides.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        near = sides.join(label.select(F.col("node").alias("other"), F.col("component").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        fell = label.join(near, "node").select("node", F.least("component", "theirs").alias("component"), (F.col("theirs") < F.col("component")).alias("moved"))
        fell = written(fell)
        discard(label)
        if fell.where("moved").isEmpty():
            discard(sides)
            return fell.select("node", "component")
        jump = fell.select(F.col("node").alias("component"), F.col("component").alias("further"))
        label = written(fell.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component")))
        discard(fell)
