"""Connected components by least labels, as a loop of joins whose state is written after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailglass.llm.common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node that stands in links (a, b).

    Each round, a node takes the least label around it and then that label's label, so chains shorten by half or better;
    aggregation before the shuffle keeps nodes with very many links cheap. Null ends and self-links say nothing.
    """
    both = links.filter("a != b")
    edges = cut(both.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(both.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("component"))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        step = cut(step.join(jump, "to", "left").select("node", "was", F.least("to", "further").alias("component")))
        if step.filter("was != component").isEmpty():
            return step.select("node", "component")
        labels = step.select("node", "component")
