"""Connected components of a link table, by contraction of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    Each round points every node of the contracted graph at its smallest neighbour, follows two pointers, and
    keeps the links that still join two groups. A long chain takes a number of rounds that is logarithmic in its
    length. Self links and null ends are ignored; no links give no rows. No list of nodes leaves the executors.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = stored(edges.distinct(), "links")
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        least = stored(least, "pointers")
        for _ in range(2):
            up = least.select(F.col("u").alias("w"), F.col("p").alias("q"))
            least = least.join(up, least["p"] == up["w"], "left").select("u", F.coalesce("q", "p").alias("p"))
        least = stored(least, "pointers")
        if labels is None:
            labels = least.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            moved = labels.join(least, labels["component"] == least["u"], "left")
            labels = stored(moved.select("node", F.coalesce("p", "component").alias("component")), "labels")
        left, right = least.toDF("u", "pu"), least.toDF("v", "pv")
        joined = edges.join(left, "u").join(right, "v").select(
            F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")
        )
        edges = stored(joined.where("u <> v").distinct(), "links")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
