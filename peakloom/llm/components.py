"""Connected components of a table of links, in rounds of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """node, root (the least node of its component) for every node of ``links`` (a, b).

    Each round takes the least label among a node and its neighbours, then that label's own label, until none changes:
    a chain's length halves in a round. Labels are written each round, so no lineage grows and a lost executor costs
    one round at most; only a flag comes to the driver. Joins are on written tables, so a node with very many links
    can be split by adaptive execution. ``files`` bounds the files of each written table.
    """
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links", files=files)
    labels = staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels", files=files)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        own = labels.select(F.col("node").alias("to"), F.col("root").alias("further"))
        fresh = staged(step.join(own, F.col("root") == F.col("to")).select("node", "old", F.least("root", "further").alias("root")), "labels", files=files)
        changed = fresh.where("root != old").limit(1).count()
        drop_staged(labels)
        labels = fresh.select("node", "root")
        if not changed:
            drop_staged(both)
            return labels
