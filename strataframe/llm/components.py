"""Connected components of a graph in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.session import settle


def connected(edges: DataFrame) -> DataFrame:
    """`node, root` for every end of an edge (`a`, `b`): the least node that can be reached.

    Each round takes the least label around and then the label of that label, so that labels travel twice as far in every
    round. Rounds are cut by written tables; nothing but one count reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where(F.col("a") != F.col("b")).distinct()
    both = settle(both, "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("heard"))
        near = labels.join(heard, F.col("node") == F.col("a")).select(
            "node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        other = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = near.join(other, "root").select("node", F.least("root", "further").alias("root"), "old")
        moved = settle(moved, "labels")
        labels = moved.select("node", "root")
        if moved.where(F.col("root") != F.col("old")).isEmpty():
            return labels
