"""Dissolved and repaired polygons against plain computations on small grids."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from domicilia.operators import dissolve as d
from domicilia.operators.polygons import centroids

VERTEX = "poly_id long, ring int, seq int, x double, y double"


def frame(spark, polygons):
    """`polygons`: id -> rings -> points."""
    rows = [(i, k, n, float(x), float(y)) for i, rings in polygons.items() for k, ring in enumerate(rings) for n, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, VERTEX).repartition(5)


def rings_of(table, key):
    """Rings as point lists, by group."""
    found = defaultdict(lambda: defaultdict(dict))
    holes = {}
    for r in table.collect():
        found[r[key]][r["ring"]][r["seq"]] = (r["x"], r["y"])
        holes[r["ring"]] = r["hole"]
    for rings in found.values():
        for points in rings.values():
            assert sorted(points) == list(range(len(points)))
    return {g: [([p for _, p in sorted(pts.items())], holes[k]) for k, pts in rings.items()] for g, rings in found.items()}


def area(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True)) / 2


def square(c, r, size=1, clockwise=False):
    points = [(c, r), (c + size, r), (c + size, r + size), (c, r + size)]
    return points[::-1] if clockwise else points


def components(cells, diagonal):
    left, n = set(cells), 0
    while left:
        n, todo = n + 1, [left.pop()]
        while todo:
            c, r = todo.pop()
            steps = [(dc, dr) for dc in (-1, 0, 1) for dr in (-1, 0, 1) if (dc or dr) and (diagonal or not (dc and dr))]
            near = {(c + dc, r + dr) for dc, dr in steps} & left
            left -= near
            todo += near
    return n


@pytest.mark.parametrize("noded", [False, True])
def test_random_cells(spark, noded):
    """Rings are as many as connected parts and enclosed gaps; cells that touch in a corner are apart."""
    rng = random.Random(3)
    cells = {(c, r): rng.randrange(2) for c in range(9) for r in range(9) if rng.random() < 0.85}
    polygons = {c * 100 + r: [square(c, r, clockwise=rng.random() < 0.5)] for c, r in cells}
    regions = spark.createDataFrame([(c * 100 + r, g) for (c, r), g in cells.items()], "poly_id long, g int")
    got = rings_of(d.dissolve(frame(spark, polygons), regions, "g", noded), "g")
    for g in (0, 1):
        own = {k for k, v in cells.items() if v == g}
        gap = {(c, r) for c in range(-1, 10) for r in range(-1, 10)} - own
        outlines = [p for p, hole in got[g] if not hole]
        holes = [p for p, hole in got[g] if hole]
        assert sum(area(p) for p, _ in got[g]) == len(own)
        assert len(outlines) == components(own, False) and len(holes) == components(gap, True) - 1
        assert all(area(p) > 0 for p in outlines) and all(area(p) < 0 for p in holes)


def test_borders_cut_differently(spark):
    """A wide polygon above two narrow ones: the middle vertex lies on its border."""
    polygons = {1: [[(0, 1), (2, 1), (2, 2), (0, 2)]], 2: [square(0, 0)], 3: [square(1, 0, clockwise=True)]}
    regions = spark.createDataFrame([(k, 7) for k in polygons], "poly_id long, g int")
    ((points, hole),) = rings_of(d.dissolve(frame(spark, polygons), regions, "g", noded=True), "g")[7]
    assert area(points) == 4 and not hole


def test_overlaps_are_refused(spark):
    polygons = {1: [square(0, 0)], 2: [square(0, 0)]}
    regions = spark.createDataFrame([(1, 7), (2, 7)], "poly_id long, g int")
    with pytest.raises(Exception, match="overlap"):
        d.boundaries(frame(spark, polygons), regions, "g").collect()


def test_long_ring(spark):
    """Many more steps than any edge can see."""
    n = 3000
    up = [(k, k % 2) for k in range(n)]
    ring = up + [(x, y + 5) for x, y in reversed(up)]
    ((points, hole),) = rings_of(d.chain(d.inside_left(frame(spark, {1: [ring]})), ["poly_id"]), "poly_id")[1]
    assert len(points) == 2 * n and not hole and area(points) == pytest.approx(abs(area(ring)))


BAD = {
    1: ([[(0, 0), (2, 2), (2, 0), (0, 2)]], 2.0, 2, 0),  # bow-tie
    2: ([square(0, 0, 4), [(3, 1), (5, 1), (5, 2), (3, 2)]], 15.0, 1, 0),  # hole sticks out
    3: ([square(0, 0, 4), square(1, 1)], 15.0, 2, 1),  # valid
    4: ([square(0, 0, 4) * 2], 16.0, 1, 0),  # passed over twice
    5: ([square(0, 0, 4), square(1, 1, 2), square(2, 2, 1, True)], 12.0, 2, 1),  # hole in a hole
    6: ([square(0, 0, 4), square(0, 0, 4)], 0.0, 0, 0),  # all hole
    7: ([[(0, 0), (4, 0), (4, 4), (2, 4), (2, 6), (2, 4), (0, 4)]], 16.0, 1, 0),  # spike
    8: ([[(0, 0), (6, 0), (6, 4), (2, 4), (2, -2), (4, -2), (4, 6), (0, 6)]], 36.0, None, None),  # overlaps itself
    9: ([[(0, 0), (1, 1), (2, 2)]], 0.0, 0, 0),  # no inside
}


def test_repair(spark):
    got = rings_of(d.repair(frame(spark, {k: rings for k, (rings, *_) in BAD.items()})), "poly_id")
    for k, (_, size, n, holes) in BAD.items():
        rings = got.get(k, [])
        if k != 8:
            assert sum(area(p) for p, _ in rings) == pytest.approx(size, abs=1e-9), k
            assert (len(rings), sum(h for _, h in rings)) == (n, holes), k
        else:
            # 0..6 x 0..4, its tail to -2 between 2 and 4, its tower to 6 from 0 to 4, less what is never gone round.
            assert all(area(p) > 0 for p, h in rings if not h) and sum(area(p) for p, _ in rings) > 0


def test_repaired_polygons_are_valid(spark):
    """Random stars: repairing again changes nothing, and points agree with the winding number."""
    rng = random.Random(5)
    polygons = {k: [[(rng.randrange(20), rng.randrange(20)) for _ in range(7)]] for k in range(12)}
    fixed = d.repair(frame(spark, polygons)).cache()
    again = d.measures(d.net_edges(d.inside_rings(fixed), ["poly_id"]), ["poly_id"])
    first = {r.poly_id: r.area for r in d.measures(d.repaired(frame(spark, polygons)), ["poly_id"]).collect()}
    assert {r.poly_id: r.area for r in again.collect()} == pytest.approx(first)
    rings = rings_of(fixed, "poly_id")
    for k, (ring,) in polygons.items():
        for _ in range(40):
            px, py = rng.random() * 20, rng.random() * 20
            assert (winding(ring, px, py) != 0) == (sum(winding(p, px, py) for p, _ in rings.get(k, [])) == 1)


def winding(points, px, py):
    n = 0
    for (x, y), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        if min(y, y2) <= py < max(y, y2) and x + (py - y) / (y2 - y) * (x2 - x) > px:
            n += 1 if y < y2 else -1
    return n


def test_no_pairing_of_all_edges(spark):
    table = frame(spark, {k: [square(2 * k, 0, 3)] for k in range(20)})
    plan = d.split(d.inside_left(table), ["poly_id"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_areas_agree_with_centroids(spark):
    table = frame(spark, {3: BAD[3][0]})
    assert centroids(table).first()["area"] == d.measures(d.inside_left(table), ["poly_id"]).first()["area"]


def test_nothing(spark):
    empty = spark.createDataFrame([], VERTEX)
    assert d.repair(empty).count() == 0
    assert d.dissolve(empty, spark.createDataFrame([], "poly_id long, g int"), "g").count() == 0
    assert d.repaired(empty).select(F.count("*")).first()[0] == 0


def test_rings_and_places_in_one_doubling(spark, monkeypatch):
    """A ring of four edges takes two rounds and one that finds nothing new, beside the two tables it starts from."""
    stored = []
    real = d.materialize
    monkeypatch.setattr(d, "materialize", lambda frame: stored.append(1) or real(frame))
    corners = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]
    rows = [(k, *a, *b) for k in range(3) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    rings = d.chain(spark.createDataFrame(rows, "key int, x double, y double, x2 double, y2 double"), ["key"])
    assert len(stored) <= 5
    for _, ring in rings.toPandas().sort_values("seq").groupby("key"):
        assert ring.seq.tolist() == [0, 1, 2, 3] and not ring.hole.any()
        places = [corners.index(p) for p in zip(ring.x, ring.y, strict=True)]
        assert [(p - places[0]) % 4 for p in places] == [0, 1, 2, 3]
