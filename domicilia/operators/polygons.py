"""Polygon measures from a vertex table (poly_id, ring, seq, x, y).

Ring 0 is the outline, other rings are holes. `seq` counts the vertices of a ring
without gaps; the last vertex need not repeat the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(vertices: DataFrame) -> DataFrame:
    """Edges (x, y) -> (x2, y2), the closing one included.

    Neighbours meet in a join on the vertex number, so the vertices of one huge ring
    spread over all tasks; a window would order them in one.
    """
    ring = ["poly_id", "ring"]
    vertices = vertices.select(*ring, "seq", "x", "y")
    following = vertices.select(*ring, (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    inner = vertices.join(following, [*ring, "seq"]).drop("seq")
    point = F.struct("x", "y")
    closing = (
        vertices.groupBy(*ring)
        .agg(F.max_by(point, "seq").alias("p"), F.min_by(point, "seq").alias("q"))
        .select(*ring, "p.x", "p.y", F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))
    )
    return inner.unionByName(closing)


def centroids(vertices: DataFrame) -> DataFrame:
    """Area and centroid of each polygon, by the shoelace sums of its rings."""
    x, y, x2, y2 = (F.col(c) for c in ("x", "y", "x2", "y2"))
    cross = x * y2 - x2 * y
    rings = (
        edges(vertices)
        .groupBy("poly_id", "ring")
        .agg(F.sum(cross).alias("a"), F.sum((x + x2) * cross).alias("cx"), F.sum((y + y2) * cross).alias("cy"))
    )
    # Orientation does not matter: outlines count as positive, holes as negative.
    sign = F.signum("a") * F.when(F.col("ring") == 0, 1).otherwise(-1)
    polygons = rings.groupBy("poly_id").agg(*[F.sum(sign * F.col(c)).alias(c) for c in ("a", "cx", "cy")])
    return polygons.select(
        "poly_id",
        (F.col("a") / 2.0).alias("area"),
        F.try_divide("cx", F.lit(3.0) * F.col("a")).alias("x"),
        F.try_divide("cy", F.lit(3.0) * F.col("a")).alias("y"),
    )
