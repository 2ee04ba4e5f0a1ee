"""Connected components by contraction, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgrain.llm.cluster import durable


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that a link (a, b) names; component: its smallest node.

    Each round points every node at its smallest neighbour, doubles these pointers until
    they end at roots, and replaces the ends of each link by their roots. At least half
    of a component's nodes go in a round, and chains of any length in the logarithm of
    it many steps.
    Aggregations combine before the shuffle; the joins are plain equi-joins, whose hot
    keys adaptive execution splits. Null ends and loops are left out; repeated links
    count once; no links give no rows.
    """
    a, b = F.col("a"), F.col("b")
    links = durable(links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    found = None
    while not links.isEmpty():
        both = links.unionByName(links.select(b.alias("a"), a.alias("b")))
        to = both.groupBy(a.alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        to = _at_roots(to)
        one = links.join(to, links.a == to.node).select(F.col("to").alias("a"), "b")
        two = one.join(to, one.b == to.node).select("a", F.col("to").alias("b"))
        links = durable(two.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
        step = to.select(F.col("node").alias("component"), "to")
        found = to.select("node", F.col("to").alias("component")) if found is None else found.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        found = durable(found)
    return found if found is not None else links.select(a.alias("node"), b.alias("component"))


def _at_roots(to: DataFrame) -> DataFrame:
    """(node, to) with pointers doubled until all point at a node that points at itself."""
    while True:
        to = durable(_follow(to))
        far = _follow(to).where("moved")
        if far.isEmpty():
            return to.select("node", "to")


def _follow(to: DataFrame) -> DataFrame:
    nxt = to.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
    return to.select("node", "to").join(nxt, "to").select("node", F.col("beyond").alias("to"), (F.col("to") != F.col("beyond")).alias("moved"))
