"""Connected components as tables; nothing of the graph reaches the driver but whether a link is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node of links(a, b) with another end: label is the least node that it reaches.

    Each round moves every node to its least neighbour, if that is less, and on to where that one moves; then links
    are drawn anew between the places moved to. Those within one place go, so the graph shrinks by
    more than half of its linked places a round, and the rounds end when no link is left."""

    def drawn(a, b) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    edges = written(links.where("a <> b").select(*drawn("a", "b")).distinct(), f"{name}-links")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    first = True
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("old")).agg(F.min("b").alias("b")).select("old", F.least("old", "b").alias("to"))
        on = near.select(F.col("old").alias("of"), F.col("to").alias("new"))
        moved = written(near.join(on, near["to"] == on["of"]).select("old", "new"), f"{name}-moved")
        if first:
            labels, first = moved.select(F.col("old").alias("node"), F.col("new").alias("label")), False
        else:
            labels = written(labels.join(moved, labels["label"] == moved["old"], "left").select("node", F.coalesce("new", "label").alias("label")), name)
        one, two = (moved.select(F.col("old").alias(e), F.col("new").alias(f"to_{e}")) for e in ("a", "b"))
        edges = edges.join(one, "a").join(two, "b").where("to_a <> to_b").select(*drawn("to_a", "to_b"))
        edges = written(edges.distinct(), f"{name}-links")
    return labels
