"""Connected components of a link table, without gathering any of it.

Each round every node points at its smallest neighbour (or itself), pointer
jumping turns those chains into stars, and the links are rewritten between the
stars' centres.  A round at least halves the nodes that still have links, so
the rounds, and the jumps in each, grow with the logarithm of the input.  Every
step is an aggregate with map-side combine or an equality join of two
stored tables, which adaptive execution can split where one node holds
very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)`` (two non-null
    columns of one orderable type); ``component`` is the smallest node reachable.
    Repeated, reversed and self links are harmless; no links give no rows."""
    edges = links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct()
    edges = stored(edges)
    found: DataFrame | None = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = stored(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")))
        if found is not None and parents.isEmpty():
            return found.select(F.col("u").alias("node"), F.col("p").alias("component"))
        while True:
            up = parents.select(F.col("u").alias("p"), F.col("p").alias("g"))
            jumped = stored(parents.join(up, "p").select("u", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved")))
            parents = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = parents
        else:
            step = parents.select(F.col("u").alias("p"), F.col("p").alias("root"))
            found = stored(found.join(step, "p", "left").select("u", F.coalesce("root", "p").alias("p")))
        left = parents.select("u", F.col("p").alias("pu"))
        right = parents.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = edges.join(left, "u").join(right, "v")
        edges = stored(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).where("u < v").distinct())
