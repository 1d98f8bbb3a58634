"""Connected components of an undirected graph whose links are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm._shared import persisted


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, root) where each root is a node itself and chains end in a node that is its own root."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("further"))
        jumped = persisted(parents.join(up, "root").select("node", F.col("root").alias("old"), F.col("further").alias("root")), "roots")
        parents = jumped.select("node", "root")
        if jumped.filter("old <> root").isEmpty():
            return parents


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that can be reached, for each node of a link.

    Rounds of contraction: each node points to its least neighbour if that is smaller
    (least values are combined before the shuffle), chains are shortened to their roots,
    and links between roots go into the next round, which has fewer of them each time.
    Joins give a row for each link or node at most. Each step is written to the shared
    folder, which cuts lineage and leaves plain exchanges that AQE can split where one
    root holds many rows. No links give no rows.
    """
    links = persisted(edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    found = None
    while True:
        ends = links.select(F.col("a").alias("node"), F.col("a").alias("root")).union(links.select(F.col("b").alias("node"), F.col("a").alias("root")))
        step = roots(persisted(ends.groupBy("node").agg(F.min("root").alias("root")), "parents"))
        if found is None:
            found = step
        else:
            new = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
            found = persisted(found.join(new, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "found")
        for side in ("a", "b"):
            links = links.join(step.select(F.col("node").alias(side), F.col("root").alias(f"to_{side}")), side)
        links = persisted(links.filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
        if links.isEmpty():
            return found.withColumnRenamed("root", "component")
