"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected (a, b) edges; label is the least node reachable.

    Every round lowers labels to the least one among neighbours and then to that label's own label,
    so long chains take a logarithmic number of rounds or so. Rounds end when nothing changes.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        heard = heard.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("lower"))
        above = labels.select(F.col("node").alias("lower"), F.col("label").alias("jump"))
        lower = lower.join(above, "lower", "left")
        lower = cut_lineage(lower.select("node", F.col("label").alias("old"), F.least("lower", "jump").alias("label")))
        labels = lower.select("node", "label")
        if lower.where("old != label").isEmpty():
            return labels
