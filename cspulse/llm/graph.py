"""Connected components of an edge table, by alternating star contractions.

Each round shortens every path: the large star hangs each node's larger
neighbours under its smallest one, the small star hangs the smaller ones there
too.  A component ends as a star around its smallest node, after a number of
rounds that grows with the logarithm of the longest path.  Minima are
pre-aggregated before each shuffle and written before they are joined back, so
a node with very many neighbours meets a join whose large side Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def components(edges: DataFrame, scratch: Scratch, gather: bool = False) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b: long); component is its smallest node.

    Loops and repeated edges are ignored; an edge with a null end is dropped,
    as null names no node.  No edges give no rows.  ``gather`` is that of
    ``Scratch.table``.
    """
    stars = scratch.table(
        edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(),
        "edges", gather)
    before = None
    while True:
        state = stars.agg(F.count("*").alias("n"),
                          F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or state["n"] == 0:
            break
        before = state
        both = stars.select("a", "b").unionAll(stars.selectExpr("b AS a", "a AS b"))
        lowest = scratch.table(
            both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m"), "large", gather)
        large = scratch.table(
            both.join(lowest, "a").where("b > a").selectExpr("b AS a", "m AS b").distinct(), "hung", gather)
        least = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")), "small", gather)
        joined = large.join(least, "a")
        nxt = scratch.table(
            joined.selectExpr("explode(array(struct(b AS a, m AS b), struct(a AS a, m AS b))) AS e")
            .selectExpr("e.a AS a", "e.b AS b").where("a <> b").distinct(), "stars", gather)
        scratch.drop(stars, lowest, large, least)
        stars = nxt
    return stars.selectExpr("a AS node", "b AS component").unionAll(
        stars.selectExpr("b AS node", "b AS component").distinct())
