"""Dissolving polygons into regions, and repairing invalid ones, as joins over their edges.

Tables are those of `polygons`: (poly_id, ring, seq, x, y), ring 0 the outline, others holes.
Edges are directed with the inside on their left, so a border that two polygons of one region share
occurs once in each direction and cancels. What is left is chained into rings: each edge
finds its follower at its end point, and pointers are doubled until every edge knows its ring
and its place, both in one go. Rounds grow with the logarithm of the longest ring, and every round is stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domicilia.operators.joins import hot_keys, join_to_unique
from domicilia.operators.polygons import edges
from domicilia.session import materialize

POINTS = ["x", "y", "x2", "y2"]
# Rays are cast level after this shear, so that edges along the axes are crossed as well.
_SHEAR = 0.0003819660112501


def _cross(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    return x * y2 - x2 * y


def _reversed(when: Column) -> dict[str, Column]:
    """End points swapped where the condition holds."""
    swap = {"x": "x2", "y": "y2", "x2": "x", "y2": "y"}
    return {c: F.when(when, F.col(o)).otherwise(F.col(c)) for c, o in swap.items()}


def inside_left(vertices: DataFrame) -> DataFrame:
    """(poly_id, ring, x, y, x2, y2): edges of valid polygons, directed with the inside on the left."""
    found = edges(vertices).filter("x != x2 OR y != y2")
    area = F.sum(_cross(*[F.col(c) for c in POINTS])).alias("_area")
    rings = found.groupBy("poly_id", "ring").agg(area)
    joined = join_to_unique(found, rings, ["poly_id", "ring"], "inner", hot_keys(found, ["poly_id", "ring"]))
    wrong = (F.col("_area") < 0) == (F.col("ring") == 0)
    return joined.withColumns(_reversed(wrong)).drop("_area")


def inside_rings(rings: DataFrame) -> DataFrame:
    """Edges of rings that run with the inside on their left already, as `chain` gives them."""
    return edges(rings).filter("x != x2 OR y != y2")


def net_edges(directed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Edges that do not occur in both directions within their group; overlapping polygons are an error."""
    forward = (F.col("x") < F.col("x2")) | ((F.col("x") == F.col("x2")) & (F.col("y") < F.col("y2")))
    once = directed.withColumn("_way", F.when(forward, 1).otherwise(-1)).withColumns(_reversed(~forward))
    net = once.groupBy(*by, *POINTS).agg(F.sum("_way").alias("_way"))
    single = F.when(F.abs("_way") <= 1, F.col("_way")).otherwise(F.raise_error(F.lit("polygons of one group overlap; repair them first")))
    kept = net.withColumn("_way", single).filter("_way != 0")
    return kept.withColumns(_reversed(F.col("_way") < 0)).drop("_way")


def _followers(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """(id, next): at the end point of an edge, the first edge out of it, turning clockwise from the way back.

    So the inside stays on the left, and rings that touch in a point stay apart. Windows hold the
    edges of one point.
    """
    x, y, x2, y2 = (F.col(c) for c in POINTS)
    none = F.lit(None).cast("long")
    out = stored.select(*by, x.alias("px"), y.alias("py"), F.atan2(y2 - y, x2 - x).alias("_angle"), F.col("id").alias("_out"), none.alias("_in"))
    back = stored.select(*by, x2.alias("px"), y2.alias("py"), F.atan2(y - y2, x - x2).alias("_angle"), none.alias("_out"), F.col("id").alias("_in"))
    point = Window.partitionBy(*by, "px", "py").orderBy("_angle", F.col("_out").isNull().desc())
    before = F.last("_out", True).over(point.rowsBetween(Window.unboundedPreceding, -1))
    highest = F.last("_out", True).over(point.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    turned = out.unionByName(back).withColumn("_next", F.coalesce(before, highest)).filter("_in IS NOT NULL")
    closed = F.coalesce("_next", F.raise_error(F.lit("edges do not close to rings")).cast("long"))
    return turned.select(F.col("_in").alias("id"), closed.alias("next"))


def _doubled(state: DataFrame, other: Sequence[str]) -> DataFrame:
    """Each edge with the columns of the edge its pointer names, as `_name`."""
    named = state.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ["next", *other]])
    return state.join(named, F.col("next") == F.col("_id"), "left")


def chain(directed: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, ring, seq, x, y, hole): rings of edges that have the inside on their left.

    Each row is the start of an edge; `ring` is any number of its own, and holes run clockwise.
    """
    by = list(by)
    stored = materialize(directed.select(*by, *POINTS).withColumn("id", F.monotonically_increasing_id()))
    links = materialize(_followers(stored, by))
    # The least edge among the next `span`, and how far it is: once these go round, the ring and the way to its first edge.
    state, span, moved = links.withColumns({"least": F.col("id"), "away": F.lit(0).cast("long")}), 1, True
    while moved:
        step = _doubled(state, ["least", "away"])
        less = F.col("_least") < F.col("least")
        away = F.when(less, F.col("_away") + span).otherwise(F.col("away"))
        least = F.least("least", "_least")
        state = materialize(step.select("id", F.col("_next").alias("next"), least.alias("least"), away.alias("away"), less.alias("moved")))
        span, moved = 2 * span, state.agg(F.max("moved")).first()[0]
    placed = stored.join(state.select("id", F.col("least").alias("ring"), "away"), "id")
    sizes = placed.groupBy("ring").agg(F.count("*").alias("_edges"), F.sum(_cross(*[F.col(c) for c in POINTS])).alias("_area"))
    sized = join_to_unique(placed, sizes, ["ring"], "inner", hot_keys(placed, ["ring"]))
    seq = F.when(F.col("away") == 0, F.lit(0).cast("long")).otherwise(F.col("_edges") - F.col("away"))
    return sized.select(*by, "ring", seq.alias("seq"), "x", "y", (F.col("_area") < 0).alias("hole"))


def measures(directed: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, area, perimeter, n_edges) of edges that have the inside on their left."""
    x, y, x2, y2 = (F.col(c) for c in POINTS)
    length = F.hypot(x2 - x, y2 - y)
    return directed.groupBy(*by).agg(
        (F.sum(_cross(x, y, x2, y2)) / 2.0).alias("area"), F.sum(length).alias("perimeter"), F.count("*").alias("n_edges")
    )


def _regional(vertices: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    directed = inside_left(vertices)
    return directed.join(regions.select("poly_id", key), "poly_id").drop("poly_id", "ring")


def boundaries(vertices: DataFrame, regions: DataFrame, key: str, noded: bool = False) -> DataFrame:
    """(key, x, y, x2, y2): outer and inner borders of the regions that polygons belong to.

    `regions` has poly_id and the region. Polygons of one region may share borders but not overlap. With
    `noded` a border may be cut differently by its two neighbours; else its vertices must be the same.
    """
    directed = _regional(vertices, regions, key)
    return net_edges(split(directed, [key]) if noded else directed, [key])


def dissolve(vertices: DataFrame, regions: DataFrame, key: str, noded: bool = False) -> DataFrame:
    """Vertex table (key, ring, seq, x, y, hole) of the dissolved regions; see `boundaries`."""
    return chain(boundaries(vertices, regions, key, noded), [key])


# Cutting edges where they meet

# One edge passes about so many cells or strips at most, however much longer than the others it is.
_CELLS_OF_ONE = 100_000


def _typical(frame: DataFrame, length: Column) -> float | None:
    """Mean length, or more where one edge would pass too many cells of that size."""
    return frame.agg(F.greatest(F.avg(length), F.max(length) / _CELLS_OF_ONE)).first()[0]


def _cells(numbered: DataFrame, size: float) -> DataFrame:
    """Each edge once for every grid cell it passes, column by column; a little wider, against rounding."""
    slack = 1e-9
    low, high = F.least("x", "x2") / size - slack, F.greatest("x", "x2") / size + slack
    columns = numbered.withColumn("_i", F.explode(F.sequence(F.floor(low), F.floor(high))))
    x, y, x2, y2 = (F.col(c) for c in POINTS)
    slope = F.try_divide(y2 - y, x2 - x)
    at = lambda edge: y + (F.greatest(F.least(edge * size, F.greatest(x, x2)), F.least(x, x2)) - x) * slope
    one, other = F.when(x == x2, y).otherwise(at(F.col("_i"))), F.when(x == x2, y2).otherwise(at(F.col("_i") + 1))
    bottom, top = F.least(one, other) / size - 2 * slack, F.greatest(one, other) / size + 2 * slack
    return columns.withColumn("_j", F.explode(F.sequence(F.floor(bottom), F.floor(top))))


def _meeting_points(a: DataFrame, b: DataFrame, on: list[str], digits: int) -> DataFrame:
    """(a, b, point) of every pair of edges in one cell, and the points they share."""
    b = b.select(*on, *[F.col(c).alias(f"_{c}") for c in ["id", *POINTS]])
    pairs = a.join(b, on).filter("id < _id")
    x, y, x2, y2 = (F.col(c) for c in POINTS)
    u, v, u2, v2 = (F.col(f"_{c}") for c in POINTS)
    dx, dy, du, dv = x2 - x, y2 - y, u2 - u, v2 - v
    turn = dx * dv - dy * du
    near = 1e-12
    t = F.try_divide((u - x) * dv - (v - y) * du, turn)
    s = F.try_divide((u - x) * dy - (v - y) * dx, turn)
    struct = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    ends = F.when(F.abs(t) <= near, struct(x, y)).when(F.abs(t - 1) <= near, struct(x2, y2))
    ends = ends.when(F.abs(s) <= near, struct(u, v)).when(F.abs(s - 1) <= near, struct(u2, v2))
    inner = struct(F.round(x + t * dx, digits), F.round(y + t * dy, digits))
    met = (t >= -near) & (t <= 1 + near) & (s >= -near) & (s <= 1 + near)
    crossing = F.when(met, F.array(ends.otherwise(inner)))

    def on_edge(px: Column, py: Column, x: Column, y: Column, dx: Column, dy: Column) -> Column:
        along = (px - x) * dx + (py - y) * dy
        flat = (px - x) * dy - (py - y) * dx
        return F.when((flat == 0) & (along >= 0) & (along <= dx * dx + dy * dy), struct(px, py))

    lying = [on_edge(px, py, x, y, dx, dy) for px, py in ((u, v), (u2, v2))]
    lying += [on_edge(px, py, u, v, du, dv) for px, py in ((x, y), (x2, y2))]
    points = F.when(turn == 0, F.array(*lying)).otherwise(crossing)
    return pairs.select(*on, "id", "_id", F.explode(points).alias("p")).filter("p IS NOT NULL")


def split(directed: DataFrame, by: Sequence[str], digits: int = 6) -> DataFrame:
    """Edges cut at all points where they meet others of their group; their direction is kept.

    Edges meet in the cells of a grid about as wide as an edge is long; a point is reported in the one
    cell it lies in. Crossings are rounded to `digits` decimals; ends of edges stay as they are.
    """
    by = list(by)
    numbered = materialize(directed.withColumn("id", F.monotonically_increasing_id()))
    x, y, x2, y2 = (F.col(c) for c in POINTS)
    size = _typical(numbered, F.hypot(x2 - x, y2 - y))
    if not size:
        return directed
    cells = _cells(numbered, size)
    on = [*by, "_i", "_j"]
    met = _meeting_points(cells.select(*on, "id", *POINTS), cells, on, digits)
    here = (F.floor(F.col("p.x") / size) == F.col("_i")) & (F.floor(F.col("p.y") / size) == F.col("_j"))
    met = met.filter(here)
    cuts = met.select("id", "p").unionByName(met.select(F.col("_id").alias("id"), "p")).distinct()
    at = (F.col("p.x") - x) * (x2 - x) + (F.col("p.y") - y) * (y2 - y)
    placed = numbered.join(cuts, "id").withColumn("_at", at).filter(
        (F.col("_at") > 0) & (F.col("_at") < (x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))
    )
    whole = numbered.join(placed.select("id").distinct(), "id", "left_anti").drop("id")
    ends = placed.groupBy(*by, "id", *[c for c in numbered.columns if c not in (*by, "id")]).agg(
        F.array_sort(F.collect_set(F.struct("_at", "p"))).alias("_cuts")
    )
    start, stop = F.struct(x.alias("x"), y.alias("y")), F.struct(x2.alias("x"), y2.alias("y"))
    points = F.concat(F.array(start), F.col("_cuts.p"), F.array(stop))
    listed = ends.withColumn("_p", points).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_cuts") + 1)))
    one, other = F.element_at("_p", F.col("_k")), F.element_at("_p", F.col("_k") + 1)
    moved = {"x": one["x"], "y": one["y"], "x2": other["x"], "y2": other["y"]}
    parts = listed.withColumns(moved).select(whole.columns).filter("x != x2 OR y != y2")
    return whole.unionByName(parts)


# Repairing polygons


def _strips(frame: DataFrame, low: Column, high: Column, size: float) -> DataFrame:
    return frame.withColumn("_strip", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))


def repaired(vertices: DataFrame, digits: int = 6) -> DataFrame:
    """(poly_id, x, y, x2, y2): borders of polygons made valid, with the inside on the left.

    Inside is what the outline goes round, in either direction, and no hole does. So a self-crossing
    outline keeps all its lobes, a hole only takes away what it shares with the outline, and
    parts that are passed over twice count once. Edges are cut where they meet; each piece
    looks along a ray, within its strip of the polygon, for what goes round its two sides.
    """
    raw = materialize(edges(vertices).filter("x != x2 OR y != y2"))
    tilted = lambda x, y: F.col(y) + _SHEAR * F.col(x)
    forward = tilted("x", "y") < tilted("x2", "y2")
    pieces = split(raw.select("poly_id", *POINTS), ["poly_id"], digits=digits)
    pieces = pieces.withColumns(_reversed(~forward)).distinct().withColumn("_piece", F.monotonically_increasing_id())
    pieces = materialize(pieces)
    rise = _typical(raw, F.abs(tilted("x2", "y2") - tilted("x", "y")))
    if not rise:
        return pieces.drop("_piece")
    lines = raw.select("poly_id", "ring", *[F.col(c).alias(f"_{c}") for c in POINTS])
    lines = lines.withColumns({"_from": tilted("_x", "_y"), "_to": tilted("_x2", "_y2")})
    lines = _strips(lines, F.least("_from", "_to"), F.greatest("_from", "_to"), rise)
    middle = {"_mx": (F.col("x") + F.col("x2")) / 2, "_my": (tilted("x", "y") + tilted("x2", "y2")) / 2}
    marked = _strips(pieces.withColumns(middle).select("poly_id", "_piece", "_mx", "_my"), F.col("_my"), F.col("_my"), rise)
    spans = (F.least("_from", "_to") <= F.col("_my")) & (F.col("_my") < F.greatest("_from", "_to"))
    hit = marked.join(lines, ["poly_id", "_strip"]).filter(spans)
    share = (F.col("_my") - F.col("_from")) / (F.col("_to") - F.col("_from"))
    across = F.col("_x") + share * (F.col("_x2") - F.col("_x")) - F.col("_mx")
    near = 4.0 * 10.0**-digits
    way = F.when(F.col("_from") < F.col("_to"), 1).otherwise(-1)
    turns = hit.groupBy("_piece", "ring").agg(
        F.sum(F.when(across > -near, way).otherwise(0)).alias("_left"), F.sum(F.when(across > near, way).otherwise(0)).alias("_right")
    )

    def within(side: str) -> Column:
        outline = F.max(F.when(F.col("ring") == 0, F.col(side) != 0).otherwise(False))
        hole = F.max(F.when(F.col("ring") != 0, F.col(side) != 0).otherwise(False))
        return outline & ~hole

    sides = turns.groupBy("_piece").agg(within("_left").alias("_in_left"), within("_right").alias("_in_right"))
    border = pieces.join(sides.filter("_in_left != _in_right"), "_piece")
    return border.withColumns(_reversed(F.col("_in_right"))).select("poly_id", *POINTS)


def repair(vertices: DataFrame, digits: int = 6) -> DataFrame:
    """Vertex table (poly_id, ring, seq, x, y, hole) of polygons made valid; see `repaired`."""
    return chain(repaired(vertices, digits), ["poly_id"])
