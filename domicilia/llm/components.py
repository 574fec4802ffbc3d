"""Connected components of a graph of integer nodes, all of it as Spark joins.

Alternating star contraction: each round links the larger neighbours of a node to its
smallest neighbour (large star), then the smaller ones (small star), until every node
hangs on the smallest node of its component. Rounds grow with the logarithm of a
component's size. Each round is written to the shared folder, so that a lost executor
costs one round, and joins have plain shuffles on both sides, which adaptive execution
splits where a node holds very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domicilia.llm.tables import store


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"] or 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another one; component is the smallest node.

    NULL ends, loops and repeated links are ignored. No links: an empty frame.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges = store(edges)
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("nb")).union(edges.select("v", "u"))
        least = store(both.groupBy("node").agg(F.min("nb").alias("nb")).select("node", F.least("node", "nb").alias("least")))
        large = both.filter("nb > node").join(least, "node").select(F.col("nb").alias("u"), F.col("least").alias("v"))
        large = store(large.distinct())
        smallest = store(large.groupBy("u").agg(F.min("v").alias("least")))
        moved = large.join(smallest, "u").filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = store(moved.union(smallest).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
