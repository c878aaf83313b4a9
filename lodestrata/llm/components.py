"""Connected components of a table of links, without gathering any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import store


def _settled(parent: DataFrame) -> DataFrame:
    """`parent` (node, to; to <= node) with each chain followed to its end, by doubling."""
    while True:
        up = parent.select(F.col("node").alias("to"), F.col("to").alias("_far"))
        longer = parent.join(up, "to", "left").select("node", F.coalesce("_far", "to").alias("far"), "to")
        longer = store.kept(longer.select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), "roots")
        store.drop(parent)
        parent = longer.select("node", "to")
        parent._kept_at = longer._kept_at
        if not longer.where("moved").limit(1).count():
            return parent


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of a link; the component is its smallest node.

    Every node points to its smallest neighbour (or itself), the pointers are
    followed to their ends by doubling, and the links between those ends make
    the next, smaller graph: a logarithmic number of rounds of aggregations and
    joins. Self-links count as nodes alone; null ends are left out.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    label = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_low"))
        parent = _settled(store.kept(parent.select("node", F.least("node", "_low").alias("to")), "parents"))
        before, last = label, edges
        if label is None:
            label = parent.withColumnRenamed("to", "component")
        else:
            step = parent.select(F.col("node").alias("component"), "to")
            label = label.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        up = parent.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        low = parent.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        edges = edges.join(up, "a").join(low, "b").where(F.col("_a") != F.col("_b"))
        edges = store.kept(edges.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "links")
        label = store.kept(label, "labels")
        store.drop(parent, last, *([before] if before is not None else []))
        if not edges.limit(1).count():
            return label
