"""Connected components of a table of links by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from answerloom.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of ``links`` (a, b); the component is the smallest id reachable.

    Each round hooks every node to its smallest neighbour, halves the paths and contracts the links, so
    the rounds grow with the logarithm of a component's diameter. Every step is a join or a combine on
    keys, and each round is written to the shared folder. Empty links give an empty table; self links and
    repeated links change nothing.
    """
    links = saved(links.select("a", "b").where("a <> b").distinct(), "links")
    ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id")))
    labels = ends.distinct().withColumn("component", F.col("id"))
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        parent = saved(parent.select("node", F.least("node", "near").alias("up")), "parents")
        for _ in range(2):  # halves every path, twice
            over = parent.select(F.col("node").alias("up"), F.col("up").alias("over"))
            parent = parent.join(over, "up", "left").select("node", F.coalesce("over", "up").alias("up"))
        parent = saved(parent, "roots")
        of = lambda side, to: parent.select(F.col("node").alias(side), F.col("up").alias(to))
        labels = saved(labels.join(of("component", "up"), "component", "left").select("id", F.coalesce("up", "component").alias("component")), "labels")
        links = saved(
            links.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "links",
        )
    return labels
