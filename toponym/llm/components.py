"""Connected components of links between nodes, as DataFrame iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of links: comp is the smallest node that links reach.

    Each round gives a node the smallest label of its neighbours and then the label of that label, so that rounds grow with the
    logarithm of the longest path. The state is a table in the shared folder; minima are taken before the shuffle.
    """
    both = written(links.select(F.col(a).alias("node"), F.col(b).alias("to")).union(links.select(F.col(b), F.col(a))).distinct())
    labels = written(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("comp").alias("near"))
        least = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = written(least.join(jump, "comp").select("node", F.least("comp", "next").alias("comp"), "old"))
        if new.where("comp <> old").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")
