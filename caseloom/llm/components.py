"""Connected components of a table of edges, by rounds of star contraction.

Each round does a large-star and a small-star step (Kiveris et al., 2014), each as one aggregation and one join. What either
yields is a table in the shared folder, so that both sides of the join are plain exchanges and adaptive execution can split a hub
(or send a small side round). Only two sums per round come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _pointed(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each edge's second end, pointed at the least node that its first end knows."""
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    out = saved(_pointed(both.filter("b > a"), least).filter("a <> b").distinct(), "edges")
    dropped(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = saved(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    out = saved(_pointed(down, least).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
    dropped(least)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; a component is named by its least node."""
    stars = saved(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        large = _large_star(stars)
        dropped(stars)
        stars = _small_star(large)
        dropped(large)
        found = stars.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
        if (found["n"], found["h"]) == mark:
            break
        mark = (found["n"], found["h"])
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
