"""Connected components of a table of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.runtime import write_table


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, component): the smallest node reachable from each linked node.

    Every round takes the smallest label among neighbours and then that label's own
    label, so paths shorten by doubling. Each round is written, which cuts lineage;
    rounds end when no label moves. Links with a null end and self-links are
    ignored; repeated links count once; without links the result is empty.
    """
    ends = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    edges = write_table(ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = write_table(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = write_table(lower.join(jump, "component", "left").select("node", "before", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.filter("component <> before").isEmpty():
            return labels
