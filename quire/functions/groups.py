"""Groups of linked things."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import saved


def linked_groups(links: DataFrame) -> DataFrame:
    """node, group (its smallest node) for every node of ``links(a, b)``; nodes are longs.

    Every round takes the smallest group among a node's neighbours, then that group's own group,
    so a chain takes rounds in the order of the logarithm of its length.
    """
    both = saved(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("group")), "groups")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "group"), "b").groupBy(F.col("a").alias("node")).agg(F.min("group").alias("low"))
        low = label.join(near, "node").select("node", F.col("group").alias("old"), F.least("group", "low").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("group").alias("up"))
        new = saved(low.join(up, "low").select("node", F.least("low", "up").alias("group"), (F.least("low", "up") != F.col("old")).alias("moved")), "groups")
        label = new.select("node", "group")
        if not new.where("moved").limit(1).count():
            return label
