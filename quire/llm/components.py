"""Connected components of a link table by contraction; nothing but tables of links is held."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import saved


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``links(a, b)``.

    Each round sends a node to the root of the forest of smallest neighbours and contracts the
    links to the roots, which at least halves the nodes that still have links.  Nodes without
    links, nulls and loops give no row.
    """
    links = links.where(F.col("a") != F.col("b")).select("a", "b")
    live = saved(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = None
    while live.limit(1).count():
        parent = saved(live.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "parents")
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            parent = saved(parent.join(up, "p").select("a", "q", (F.col("p") != F.col("q")).alias("moved")), "parents")
            moved = parent.where("moved").limit(1).count()
            parent = parent.select("a", F.col("q").alias("p"))
            if not moved:
                break
        step = parent.select(F.col("a").alias("component"), F.col("p").alias("root"))
        if label is None:
            label = parent.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            label = label.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        ends = live.join(parent.withColumnRenamed("p", "pa"), "a").join(parent.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        live = saved(ends.where(F.col("pa") != F.col("pb")).select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "links")
    if label is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return saved(label, "components")
